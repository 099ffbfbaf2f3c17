"""Benchmark passages in documents: a prefix-filtered join on word shingles.

A window is ``width`` consecutive words of an item, or all words of a shorter item. A document
that holds a window holds all its shingles (``shingle`` words, fewer for shorter windows), so one
of them is prefix enough: the one that is rarest in the documents. Documents are joined with
the windows on that shingle alone; the place of the shingle in the document and in the window
gives the only place where the window can stand (it must not begin before the first word nor end
after the last), and there the words themselves are compared.

Texts are read twice where they lie and never shuffled: once to count the benchmark's shingles, once
to find the chosen ones. What is sent to the tasks is a bitmap of fixed size; what it lets
through by chance falls out in the join.

Rows: null texts and texts without words have no words; items without words or with a null id are
left out. Repeated rows get equal results, an item of several rows has the windows of all.
Texts are read whole. An empty benchmark hits nothing, an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.words import _BYTE_VALUE, _FOLD, in_chunks, mix, segment_hashes
from cohortlake.operators.skew import join_null_safe, skew_join
from cohortlake.session import materialize

BITMAP_BITS = 22
WINDOW_ROWS = 20_000

# Letters, digits and everything beyond ASCII belong to words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of some texts: bytes with A-Z lowered, the bounds of each word, words per text."""

    def __init__(self, texts: list[bytes]):
        self.flat = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        inside = _IN_WORD[self.flat]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))
        self.first = np.cumsum(self.counts) - self.counts

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and the first words whose text has so many."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = segment_hashes(_BYTE_VALUE[self.flat], self.starts, self.ends)
        padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
        out = np.full(len(hashes), width, np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(hashes)])
        left = np.repeat(self.first + self.counts, self.counts) - np.arange(len(hashes))
        return out.astype(np.int64), np.flatnonzero(left >= width)

    def joined(self, begin: int, end: int) -> str:
        """Words ``begin`` to ``end`` with one blank between them."""
        return b" ".join(self.flat[s:e].tobytes() for s, e in zip(self.starts[begin:end], self.ends[begin:end], strict=True)).decode(
            "utf-8", "replace"
        )


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.int64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.int64(64 - bits)) & mask


class Bitmap:
    """Two bits for each hash it was given, in ``2 ** bits``; lets through all of them and few others."""

    def __init__(self, hashes: DataFrame, bits: int = BITMAP_BITS):
        column, mask = F.col(hashes.columns[0]), F.lit((1 << bits) - 1).cast("long")
        low, high = column.bitwiseAND(mask), F.shiftrightunsigned(column, 64 - bits).bitwiseAND(mask)
        # At most 2 ** bits rows reach the driver, whatever the table holds.
        found = hashes.select(F.explode(F.array(low.cast("int"), high.cast("int"))).alias("slot")).distinct().toArrow()
        table = np.zeros(1 << bits, bool)
        table[found.column(0).to_numpy()] = True
        self.bits, self.packed = bits, np.packbits(table).tobytes()

    def table(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.packed, np.uint8)).view(bool)


def item_windows(items: DataFrame, id_col: str, text: str, width: int, shingle: int) -> DataFrame:
    """``item_id, words, shingles``: each window of each item, words joined by blanks, shingle hashes in order."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0), _bytes_of(batch.column(1))
            for part in in_chunks(texts):
                words = Words(texts[part])
                owner, joined, hashes = [], [], []
                by_width = {}
                for i in range(part.stop - part.start):
                    n, first = int(words.counts[i]), int(words.first[i])
                    long, own = min(n, width), min(n, shingle)
                    if not n:
                        continue
                    if own not in by_width:
                        by_width[own] = words.shingles(own)[0]
                    for begin in range(first, first + n - long + 1):
                        owner.append(part.start + i)
                        joined.append(words.joined(begin, begin + long))
                        hashes.append(by_width[own][begin : begin + long - own + 1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array(joined, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["item_id", "words", "shingles"],
                )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item_id {kind}, words string, shingles array<long>")


def _count_shingles(bitmap: Bitmap, widths: list[int]):
    def run(batches):
        table = bitmap.table()
        for batch in batches:
            texts = _bytes_of(batch.column(0))
            for part in in_chunks(texts):
                words = Words(texts[part])
                for width in widths:
                    hashes, at = words.shingles(width)
                    low, high = _slots(hashes[at], bitmap.bits)
                    found, n = np.unique(hashes[at][table[low] & table[high]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["shingle", "n"])

    return run


def _find_shingles(bitmap: Bitmap, widths: list[int], width: int, shingle: int):
    """Each document with its number of words and, of each shingle let through, the words around it."""

    def run(batches):
        table = bitmap.table()
        kind = pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("around", pa.string())])
        for batch in batches:
            ids, content, texts = batch.column(0), batch.column(1), _bytes_of(batch.column(2))
            for part in in_chunks(texts):
                words = Words(texts[part])
                met: list[list] = [[] for _ in range(part.stop - part.start)]
                for own in widths:
                    # A shingle below the usual width is a whole window.
                    reach = width if own == shingle else own
                    hashes, at = words.shingles(own)
                    low, high = _slots(hashes[at], bitmap.bits)
                    for k in at[table[low] & table[high]].tolist():
                        i = int(np.searchsorted(words.first + words.counts, k, "right"))
                        begin = max(int(words.first[i]), k - reach + own)
                        end = min(int(words.first[i] + words.counts[i]), k + reach)
                        met[i].append(
                            {"shingle": int(hashes[k]), "place": k - int(words.first[i]), "before": k - begin, "around": words.joined(begin, end)}
                        )
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, size),
                        content.slice(part.start, size),
                        pa.array(words.counts, pa.int64()),
                        pa.array(met, pa.list_(kind)),
                    ],
                    ["id", "content", "n_words", "met"],
                )

    return run


def contamination(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """``id, content, n_words, n_hit, places, items`` for each row of ``documents``.

    ``content`` is a hash of the text, ``places`` the ``(start, length)`` of each window found,
    ``items`` the ids of the items they belong to, in order as strings.
    """
    held = materialize(item_windows(items, item_id, item_text, width, shingle), "item-windows")
    windows = materialize(
        held.groupBy("words").agg(F.first("shingles").alias("shingles"))
        .select("words", "shingles", (F.size(F.split("words", " "))).alias("length"), F.xxhash64("words").alias("window")),
        "windows",
    )
    widths = sorted(r[0] for r in windows.select(F.least("length", F.lit(shingle))).distinct().collect())
    rows = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    every = windows.select("window", "words", "length", F.posexplode("shingles").alias("offset", "shingle"))
    counted = rows.select("text").mapInArrow(
        _count_shingles(Bitmap(every.select("shingle")), widths), "shingle long, n long"
    )
    often = materialize(counted.groupBy("shingle").agg(F.sum("n").alias("n")), "often")
    ranked = every.join(often, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A window with a shingle that no document has stands nowhere.
    rarest = F.min(F.struct("n", "shingle", "offset")).alias("best")
    chosen = materialize(
        ranked.groupBy("words", "window", "length").agg(rarest).where("best.n > 0").select(
            "words", "window", "length", "best.shingle", "best.offset"
        ),
        "chosen",
    )
    kind = rows.schema["id"].dataType.simpleString()
    scanned = materialize(
        rows.mapInArrow(
            _find_shingles(Bitmap(chosen.select("shingle")), widths, width, shingle),
            f"id {kind}, content long, n_words long, "
            "met array<struct<shingle: long, place: long, before: int, around: string>>",
        ),
        "scanned",
    )
    met = scanned.select("id", "content", "n_words", F.inline("met"))
    joined = skew_join(met, chosen, ["shingle"], broadcast_rows=WINDOW_ROWS)
    start, inner = F.col("place") - F.col("offset"), F.col("before") - F.col("offset")
    possible = joined.where((inner >= 0) & (start + F.col("length") <= F.col("n_words")))
    there = F.slice(F.split("around", " "), inner + 1, F.col("length"))
    found = materialize(
        possible.where(F.array_join(there, " ") == F.col("words"))
        .select("id", "content", "window", start.alias("start"), F.col("length").cast("long").alias("length"))
        .distinct(),
        "found",
    )
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["start"] + x["length"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["length"] - F.greatest(acc["upto"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    # A document's places are bounded by its words.
    hit = found.groupBy("id", "content").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places")
    ).withColumn("n_hit", covered)
    owners = held.select(F.xxhash64("words").alias("window"), "words", "item_id").groupBy("window", "item_id").agg(F.count(F.lit(1)).alias("n"))
    ids = F.col("item_id").cast("string")
    of_items = (
        skew_join(found.select("id", "content", "window").distinct(), owners.drop("n"), ["window"], broadcast_rows=WINDOW_ROWS)
        .groupBy("id", "content")
        .agg(F.array_sort(F.collect_set(ids)).alias("items"))
    )
    results = materialize(join_null_safe(hit, materialize(of_items, "items"), ["id", "content"], "left"), "hits")
    return join_null_safe(scanned.drop("met"), results, ["id", "content"], "left").select(
        "id",
        "content",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("places", F.array().cast("array<struct<start: long, length: long>>")).alias("places"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
