"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so a signature of 2k values costs k hash evaluations. Values are banded; documents
that share a band are candidates; every link is confirmed on the whole sets. The bands are
as long as leaves a pair at the bound a chance of ``MISSED`` to share none.

No group is expanded into all pairs. Equal sets become one class. In each band bucket the
member with most candidate company is the hub and every member is compared with it. Members
that end in another component than the hub are then compared with the members of other
components, except where what is known of both from the hub rules a link out: their overlaps
with it and the shingles that one of its members alone has. So no link between candidates is lost.

Rows: null and empty texts and texts without words have an empty set and link with nothing;
so do rows with a null id. Repeated rows get equal results. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.bitmaps import bitmap, may_hold
from cohortlake.llm.components import connected_components
from cohortlake.llm.words import free_name, in_chunks, mix, shingle_sets
from cohortlake.session import materialize

PERMUTATIONS = 60
MISSED = 1e-6
MEMBERS_PER_TASK_GROUP = 256
BLOCK = 1 << 18


def min_max_signature(values: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """``(sets, 2 * permutations)``: minima, then maxima. ``values``: flat non-empty sets."""
    factor = mix(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    out = np.empty((len(counts), 2 * permutations), np.uint64)
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        # A block of sets whose hashes stay in the processor's cache.
        base = ends[begin] - counts[begin]
        end = max(begin + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part, at = values[base : ends[end - 1]], (ends[begin:end] - counts[begin:end] - base)
        for k in range(permutations):
            hashed = part * factor[k]
            out[begin:end, k] = np.minimum.reduceat(hashed, at)
            out[begin:end, permutations + k] = np.maximum.reduceat(hashed, at)
        begin = end
    return out


def band_rows(percent: int, permutations: int = PERMUTATIONS) -> int:
    """Most values per band such that a pair at the bound shares no band with a chance of ``MISSED`` at most."""
    values, fitting = 2 * permutations, [1]
    for rows in range(2, values + 1):
        if values % rows == 0 and (1 - (percent / 100) ** rows) ** (values // rows) <= MISSED:
            fitting.append(rows)
    return max(fitting)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; bands differ by their number."""
    bands = signature.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r : bands * rows : rows])
    return key


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sketches(df: DataFrame, id_col: str, text: str, width: int, per_band: int) -> DataFrame:
    """``id, n_shingles, digest, bands`` of each row; digest and bands are null for an empty set."""

    def sketch(batches):
        for batch in batches:
            ids, texts = batch.column(0), _bytes_of(batch.column(1))
            for part in in_chunks(texts, 2 << 20):
                values, counts = shingle_sets(texts[part], width)
                full = counts > 0
                keys = iter(band_keys(min_max_signature(values, counts[full]), per_band).astype(np.int64))
                sets = iter(np.split(values, np.cumsum(counts[full])[:-1]))
                digests = [hashlib.blake2b(next(sets).tobytes(), digest_size=16).digest() if f else None for f in full]
                bands = [next(keys) if f else None for f in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, part.stop - part.start).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "digest", "bands"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "id long, n_shingles long, digest binary, bands array<long>")


def _overlaps(width: int):
    """For partitions sorted by hub: the hub's set stays while its members stream past."""

    def run(batches):
        current, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, salts, roles, ids = (batch.column(i).to_pylist() for i in range(4))
            texts = _bytes_of(batch.column(4))
            found: list[tuple] = []
            for part in in_chunks(texts, 2 << 20):
                values, counts = shingle_sets(texts[part], width)
                sets = np.split(values, np.cumsum(counts)[:-1])
                for i, members in zip(range(part.start, part.stop), sets, strict=True):
                    if roles[i] == 0:
                        current, hub_set = (hubs[i], salts[i]), members
                    elif current == (hubs[i], salts[i]) and len(hub_set):
                        at = np.minimum(np.searchsorted(hub_set, members), len(hub_set) - 1)
                        both = int((hub_set[at] == members).sum())
                        outside = members[hub_set[at] != members].astype(np.int64)
                        found.append((hubs[i], ids[i], both, len(hub_set) + len(members) - both, len(members), outside))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.list_(pa.int64()))],
                ["a", "b", "shared", "joint", "size", "outside"],
            )

    return run


def confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Exact intersection and union size of each pair ``(a, b)``, the size of b's set and its shingles outside a's.

    ``texts``: ``id, text``, ids unique.

    A hub with many members is spread over several groups, its text repeated in each.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK_GROUP).cast("int").alias("parts"))
    hubs = materialize(sizes, "hubs")
    members = (
        pairs.join(hubs, "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(texts, F.col("b") == texts["id"])
        .select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
    )
    heads = (
        hubs.join(texts, F.col("a") == texts["id"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("a", "salt", F.lit(0).alias("role"), "id", "text")
    )
    groups = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")
    return groups.mapInArrow(
        _overlaps(width), "a long, b long, shared long, joint long, size long, outside array<long>"
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``id, n_shingles, component, kept`` for each row.

    Links: 100 * |intersection| >= ``percent`` * |union| of the sets of ``width``-word shingles.
    ``component``: the smallest id reachable by links, itself included (the id itself without any).
    """
    rows = materialize(sketches(df, id_col, text, width, band_rows(percent)), "sketches")
    filled = rows.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = materialize(
        filled.groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("first")).select("digest", "first.*"), "classes"
    )
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key"), "members")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = materialize(
        members.join(materialize(company, "company"), "id")
        .groupBy("key")
        .agg(F.max(F.struct("company", -F.col("id"))).alias("best"))
        .select("key", (-F.col("best.col2")).alias("hub")),
        "hubs",
    )
    placed = materialize(members.join(hubs, "key").select("key", "id", "hub"), "placed")
    pairs = materialize(
        placed.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs"
    )
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    # A bitmap of fixed size keeps nearly all other texts where they are; the join and the grouping share one shuffle by id.
    candidate = may_hold(bitmap(wanted.select(F.xxhash64("id"))), F.xxhash64("id"))
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where(candidate).hint("merge")
    # Rows that repeat an id repeat its text; the smallest stands for them.
    texts = materialize(whole.join(wanted, "id").groupBy("id").agg(F.min("text").alias("text")), "texts")
    tested = materialize(confirm(pairs, texts, width), "tested")
    linked = F.col("shared") * 100 >= F.col("joint") * percent
    links = tested.where(linked).select("a", "b")
    labels = connected_components(links)
    crossing = _crossing(tested, labels, percent)
    if not crossing.isEmpty():
        more = materialize(confirm(crossing, texts, width).where(linked).select("a", "b"), "links")
        labels = connected_components(links.unionByName(more))
    class_of = classes.select("digest", F.col("id").alias("first_id")).join(
        labels.withColumnRenamed("id", "first_id"), "first_id", "left"
    )
    placed_rows = rows.join(
        materialize(class_of.select("digest", F.coalesce("component", "first_id").alias("component")), "labels"),
        "digest",
        "left",
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return placed_rows.select(
        "id",
        "n_shingles",
        component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _crossing(tested: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one hub's members in different components that may still link, written down.

    They cover all pairs of a bucket, whose members all met its hub. They share at most the smaller of their
    two overlaps with the hub, and of the shingles outside the hub only such as more than one
    member of the hub has. Pairs that cannot reach ``percent`` so are left out.
    """
    known = tested.select(F.col("a").alias("hub"), F.col("b").alias("id"), "shared", "size", "outside")
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("main"))
    named = materialize(
        known.join(labels, "id", "left")
        .join(of_hub, "hub", "left")
        .withColumns({"component": F.coalesce("component", "id"), "main": F.coalesce("main", "hub")}),
        "named",
    )
    mixed = named.where("component <> main").select("hub").distinct()
    inside = named.join(mixed, "hub", "left_semi")
    alone = (
        inside.select("hub", "id", F.explode("outside").alias("shingle"))
        .groupBy("hub", "shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .where("n = 1")
        .groupBy("hub", "id")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    common = F.col("size") - F.col("shared") - F.coalesce("alone", F.lit(0))
    stats = materialize(
        inside.drop("outside").join(alone, ["hub", "id"], "left").withColumn("common", common).drop("alone"), "stats"
    )
    open_rows = (F.col("component") != F.col("main")) & (
        (F.col("shared") + F.col("common")) * 100 >= F.col("size") * percent
    )
    x, y = stats.where(open_rows).alias("x"), stats.alias("y")
    most = F.least("x.shared", "y.shared") + F.least("x.common", "y.common")
    possible = most * 100 >= (F.col("x.size") + F.col("y.size") - most) * percent
    found = x.join(y, F.col("x.hub") == F.col("y.hub")).where(
        (F.col("x.component") != F.col("y.component")) & possible
    )
    pairs = found.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    return materialize(pairs, "crossing")


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of the table with one row left of each group of near-duplicates.

    Rows with a null id stay. Of rows that repeat an id, the one of the smallest values stays.
    """
    found = materialize(near_duplicates(df, id_col, text, width, percent), "near-duplicates")
    gone = found.where("NOT kept").select(F.col("id").alias(id_col)).distinct()
    again = materialize(
        found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "again"
    )
    left = _without(df, gone, id_col)
    if again.isEmpty():
        return left
    others = [F.struct(*df.columns).alias("row")]
    once = left.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min(others[0]).alias("row")).select("row.*")
    return _without(left, again, id_col).unionByName(once)


def _without(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in ``gone``; the table is shuffled by id once at any size of ``gone``, null ids by all columns."""
    names = free_name(df, "gone_null", "gone_key")
    lost, key = names["gone_null"], names["gone_key"]
    keyed = df.withColumns({lost: F.col(id_col).isNull(), key: F.coalesce(F.col(id_col).cast("long"), F.xxhash64(*df.columns))})
    listed = gone.select(F.lit(False).alias(lost), F.col(id_col).cast("long").alias(key))
    return keyed.hint("merge").join(listed, [lost, key], "left_anti").select(df.columns)
