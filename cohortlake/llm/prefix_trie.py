"""The trie of conversation prefixes, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Turns are hashed where they lie (128 bits of role and text); a
sequence is the sum of its turns' hashes with their places, so running sums name all prefixes and texts
are never shuffled. A node is known by its smallest member and its depth.

The tour goes down and up each edge: an enter and an exit arc for each node, children in order of their
smallest members. Links of the tour (arc to next arc) carry the weight of the node they enter. They are
dealt by ranges of node, so stretches of the tour lie together; each task ranks its stretches by pointer jumping over
arrays, block by block, and only a stretch's ends go on. Those are ranked by pointer jumping over joins, in the
logarithm of their number of rounds. A subtree's leaves and savings are differences of prefix sums at its two arcs.

No conversation, node or family of siblings needs one task: positions, running sums and sibling order come
from ``ranks``. The digest of a node's ends joins runs of at most ``RUN`` ids, of which one task reads the joined runs in order.

Rows: rows with a null conversation are left out. Turns of equal number are in order of role, then of their hashes;
repeated rows are turns of their own. A conversation whose base has no rows only loses its own
first turns; it may end without turns, at the root. Texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ranks import running_total, with_position
from cohortlake.operators.skew import skew_join
from cohortlake.session import materialize, shuffle_width

BLOCK = 1 << 18
RUN = 4096
ENTER, EXIT = 0, 1
PREFIX = ["depth", "h0", "h1", "h2", "h3"]
LINK_SCHEMA = (
    "conv long, depth long, kind int, head_conv long, head_depth long, head_kind int, leaves long, saved long, "
    "next_conv long, next_depth long, next_kind int, all_leaves long, all_saved long"
)


def _words_of(first: Column, second: Column) -> dict[str, Column]:
    """Two 64-bit hashes as four numbers below 2 ** 32, so that sums of them do not overflow."""
    low = F.lit((1 << 32) - 1).cast("long")
    return {
        "h0": first.bitwiseAND(low),
        "h1": F.shiftrightunsigned(first, 32),
        "h2": second.bitwiseAND(low),
        "h3": F.shiftrightunsigned(second, 32),
    }


def rebuilt_turns(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, block: int, heads: int
) -> tuple[DataFrame, DataFrame]:
    """``conv, depth, a, b, chars`` of each rebuilt turn (two hashes, code points), and ``conv, turns`` of each conversation.

    The first ``h`` turns of conversation ``c`` come from conversation ``c - c % block``, with
    ``h`` the checksum of ``c``'s decimal digits modulo ``heads``; its own turns follow after as many.
    """
    who, said = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    conv = F.col(conversation).cast("long")
    rows = materialize(
        df.where(F.col(conversation).isNotNull()).select(
            conv.alias("conv"),
            F.col(turn).alias("turn"),
            who.alias("role"),
            F.xxhash64(who, said).alias("a"),
            F.xxhash64(F.lit(1), said, who).alias("b"),
            F.char_length(said).cast("long").alias("chars"),
        ),
        "turns",
    )
    # Null turns first, as in any ascending order of Spark.
    placed = materialize(with_position(rows, ["conv"], [F.col(c) for c in ("turn", "role", "a", "b")], "place"), "placed")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("long")
    whole = placed.groupBy("conv").agg(F.max("place").alias("own")).withColumn("h", h)
    based = whole.withColumn("base", F.col("conv") - F.col("conv") % block)
    # A base has fewer turns here than ``heads``, a block fewer conversations than twice its length.
    first = placed.where(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "a", "b", "chars")
    size = first.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(
        based.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))).drop("n"), "known"
    )
    borrowed = known.join(first, "base").where("place <= taken").select("conv", F.col("place").alias("depth"), "a", "b", "chars")
    moved = known.where("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("shift"), "own")
    kept = placed.withColumn("h", h).where("place > h")
    own = skew_join(kept, materialize(moved, "moved"), ["conv"], "left", rows="own").select(
        "conv", (F.col("place") - F.coalesce("shift", F.lit(0))).alias("depth"), "a", "b", "chars"
    )
    turns = F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))
    return materialize(borrowed.unionByName(own), "rebuilt"), known.select("conv", turns.alias("turns"))


def _digest_ends(batches):
    """SHA-256 over the runs of each node, which come in order."""
    current, digest = None, None
    for batch in batches:
        found = []
        for *key, run in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)), strict=True):
            if key != current:
                if current is not None:
                    found.append((*current, digest.hexdigest()))
                current, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(run.encode())
        yield _digest_batch(found)
    if current is not None:
        yield _digest_batch([(*current, digest.hexdigest())])


def _digest_batch(found) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())], [*PREFIX, "ends_sha256"]
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """Of each node (its ``PREFIX`` columns) the SHA-256 of its ends' ids in order, joined by commas."""
    placed = with_position(ends, PREFIX, [F.col("conv")], "place")
    run = ((F.col("place") - 1) / RUN).cast("long").alias("run")
    runs = placed.groupBy(*PREFIX, run).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = runs.repartition(*PREFIX).sortWithinPartitions(*PREFIX, "run")
    return ordered.mapInArrow(_digest_ends, "depth long, h0 long, h1 long, h2 long, h3 long, ends_sha256 string")


def trie_nodes(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, block: int, heads: int
) -> DataFrame:
    """``conv, depth, parent, n_convs, n_children, chars, ends_sha256`` of each node, the root included."""
    turns, convs = rebuilt_turns(df, conversation, turn, role, text, block, heads)
    place = F.col("depth")
    named = turns.select(
        "conv", "depth", "chars", *[c.alias(n) for n, c in _words_of(F.xxhash64(place, "a", "b"), F.xxhash64("b", place, "a")).items()]
    ).withColumns({f"own{i}": F.col(f"h{i}") for i in range(4)})
    sums = running_total(named, ["conv"], [F.col("depth")], **{f"h{i}": F.col(f"h{i}") for i in range(4)})
    prefixes = materialize(sums, "prefixes")
    # A prefix without its last turn is its parent's.
    above = [F.col("depth") - 1, *[F.col(f"h{i}") - F.col(f"own{i}") for i in range(4)]]
    nodes = materialize(
        prefixes.groupBy(*PREFIX).agg(
            F.min("conv").alias("conv"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("chars").alias("chars"),
            F.min(F.struct(*[c.alias(n) for n, c in zip(PREFIX, above, strict=True)])).alias("above"),
        ),
        "nodes",
    )
    convs = materialize(convs, "conversations")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in PREFIX], "conv", "n_convs", zero.alias("chars"))
    families = materialize(
        nodes.groupBy(*[F.col("above")[c].alias(c) for c in PREFIX]).agg(F.count(F.lit(1)).alias("n_children")), "families"
    )
    tops = nodes.drop("above").unionByName(root)
    parents = materialize(
        tops.join(families, PREFIX).select(
            *[F.col(c).alias(f"above_{c}") for c in PREFIX], F.col("conv").alias("parent"), "n_children"
        ),
        "parents",
    )
    flat = nodes.select(*PREFIX, "conv", "n_convs", "chars", *[F.col("above")[c].alias(f"above_{c}") for c in PREFIX])
    children = skew_join(flat, parents, [f"above_{c}" for c in PREFIX], rows="n_children").select(
        *PREFIX, "conv", "n_convs", "chars", "parent"
    )
    every = children.unionByName(root.withColumn("parent", F.lit(None).cast("long")))
    last = prefixes.join(convs.withColumnRenamed("turns", "depth"), ["conv", "depth"], "left_semi").select("conv", *PREFIX)
    turnless = convs.where("turns = 0").select("conv", *[zero.alias(c) for c in PREFIX])
    digests = _end_digests(materialize(last.unionByName(turnless), "ends"))
    none = hashlib.sha256().hexdigest()
    return materialize(
        every.join(families, PREFIX, "left").join(digests, PREFIX, "left").select(
            "conv", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        ),
        "trie",
    )


def tour_links(nodes: DataFrame) -> DataFrame:
    """``conv, depth, kind`` of each arc but the last, the arc after it (``next_``), ``leaves``, ``saved`` of the node it enters.

    ``nodes``: as ``trie_nodes`` gives them.
    """
    inner = nodes.where("parent IS NOT NULL")
    placed = materialize(with_position(inner, ["parent", "depth"], [F.col("conv")], "place"), "siblings")
    before = placed.select("parent", "depth", (F.col("place") + 1).alias("place"), F.col("conv").alias("elder"))
    youngest = materialize(
        placed.groupBy("parent", "depth").agg(F.max_by("conv", "place").alias("conv")).select(
            "conv", "depth", F.lit(True).alias("youngest")
        ),
        "youngest",
    )
    lined = placed.join(before, ["parent", "depth", "place"], "left").join(youngest, ["conv", "depth"], "left")
    zero = F.lit(0).cast("long")
    enter, leave = F.lit(ENTER), F.lit(EXIT)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("chars")

    def link(conv, depth, kind, next_conv, next_depth, next_kind, leaves, saves):
        names = ("conv", "depth", "kind", "next_conv", "next_depth", "next_kind", "leaves", "saved")
        values = (conv, depth, kind, next_conv, next_depth, next_kind, leaves, saves)
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    conv, depth, parent = F.col("conv"), F.col("depth"), F.col("parent")
    down = F.when(F.col("elder").isNull(), link(parent, depth - 1, enter, conv, depth, enter, leaf, saved)).otherwise(
        link(F.col("elder"), depth, leave, conv, depth, enter, leaf, saved)
    )
    up = F.when(F.col("youngest"), link(conv, depth, leave, parent, depth - 1, leave, zero, zero))
    turned = F.when(F.col("n_children") == 0, link(conv, depth, enter, conv, depth, leave, zero, zero))
    links = lined.select(F.explode(F.array_compact(F.array(down, up, turned))).alias("l")).select("l.*")
    alone = nodes.where("parent IS NULL AND n_children = 0").select(turned.alias("l")).select("l.*")
    return links.unionByName(alone)


def _rank_stretches(batches):
    """Of each link the head of its stretch within the block, and the weights between: links met before it, its own left out."""
    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= BLOCK:
            yield _rank_block(pa.Table.from_batches(waiting))
            waiting, held = [], 0
    if held:
        yield _rank_block(pa.Table.from_batches(waiting))


def _rank_block(links: pa.Table) -> pa.RecordBatch:
    arc = np.stack([links.column(c).to_numpy().astype(np.int64) for c in ("conv", "depth", "kind")], 1)
    after = np.stack([links.column(c).to_numpy().astype(np.int64) for c in ("next_conv", "next_depth", "next_kind")], 1)
    n = len(arc)
    _, code = np.unique(np.concatenate([arc, after]), axis=0, return_inverse=True)
    code = code.ravel()
    at = np.full(int(code.max()) + 1, -1)
    at[code[:n]] = np.arange(n)
    following = at[code[n:]]  # the link of the next arc, if it is here
    before = np.full(n, -1)
    before[following[following >= 0]] = np.flatnonzero(following >= 0)
    weights = np.stack([links.column(c).to_numpy().astype(np.int64) for c in ("leaves", "saved")], 1)
    head = np.where(before >= 0, before, np.arange(n))
    gone = np.where(before[:, None] >= 0, weights[np.maximum(before, 0)], 0)
    # Pointer jumping towards the head; a stretch has no circle, as the tour has none.
    while True:
        further = head[head]
        if (further == head).all():
            break
        gone = gone + np.where((further != head)[:, None], gone[head], 0)
        head = further
    total = gone + weights
    tail = np.flatnonzero(following < 0)
    last = np.full(n, -1)
    last[head[tail]] = tail
    heads = last >= 0
    columns = [*arc.T, *arc[head].T, *gone.T]
    ends = [*after[last].T, *total[last].T]
    arrays = [pa.array(c) for c in columns] + [pa.array(c, mask=~heads) for c in ends]
    names = [f.split()[0] for f in LINK_SCHEMA.split(", ")]
    ints = {"kind", "head_kind", "next_kind"}
    return pa.RecordBatch.from_arrays([a.cast(pa.int32()) if c in ints else a for a, c in zip(arrays, names, strict=True)], names)


def rank_tour(links: DataFrame) -> DataFrame:
    """``conv, depth, kind, leaves, saved`` of each arc: the weights of all links of the tour before it."""
    spark = links.sparkSession
    stored = materialize(links, "links")
    dealt = stored.repartitionByRange(shuffle_width(spark), "conv", "depth").sortWithinPartitions("conv", "depth", "kind")
    stretches = materialize(dealt.mapInArrow(_rank_stretches, LINK_SCHEMA), "stretches")
    arc, head, after = (["conv", "depth", "kind"], ["head_conv", "head_depth", "head_kind"], ["next_conv", "next_depth", "next_kind"])
    ends = stretches.where("all_leaves IS NOT NULL").select(
        *head, *after, F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved")
    )
    # Each stretch learns the weights from its head to the tour's end; after each round it sees twice as far.
    ends = materialize(ends, "ends")
    while True:
        seen = ends.select(
            *[F.col(h).alias(n) for h, n in zip(head, after, strict=True)],
            *[F.col(n).alias(f"far_{n}") for n in after],
            F.col("leaves").alias("more_leaves"),
            F.col("saved").alias("more_saved"),
        )
        zero = F.lit(0).cast("long")
        ends = materialize(
            ends.join(seen, after, "left").select(
                *head,
                *[F.col(f"far_{n}").alias(n) for n in after],
                (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
            ),
            "ends",
        )
        if ends.where("next_conv IS NOT NULL").isEmpty():
            break
    # The first link's stretch sees the whole tour.
    whole = ends.agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
    sizes = stretches.groupBy(*head).agg(F.count(F.lit(1)).alias("stretch_rows"))
    begun = ends.join(sizes, head).select(*head, F.col("leaves").alias("left_leaves"), F.col("saved").alias("left_saved"), "stretch_rows")
    met = skew_join(stretches.select(*arc, *head, "leaves", "saved"), materialize(begun, "begun"), head, rows="stretch_rows")
    total = met.withColumn("_whole", whole.select(F.struct("*")).scalar())
    return total.select(
        *arc,
        (F.col("_whole.leaves") - F.col("left_leaves") + F.col("leaves")).alias("leaves"),
        (F.col("_whole.saved") - F.col("left_saved") + F.col("saved")).alias("saved"),
    )


def prefix_trie(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = 100,
    heads: int = 6,
) -> DataFrame:
    """``conv, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    ``conv``: its smallest member. ``saved_tokens``: over its subtree, code points of a node's last text for
    each member but one. ``ends_sha256``: of the ids of the conversations that end there.
    """
    nodes = trie_nodes(df, conversation, turn, role, text, block, heads)
    ranked = materialize(rank_tour(tour_links(nodes)), "ranked")
    total = F.lit(0).cast("long")
    arcs = ranked.groupBy("conv", "depth").agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}_{kind}")
            for kind in (ENTER, EXIT)
            for c in ("leaves", "saved")
        ]
    )
    # The root's exit is the tour's end and has no link: the sums there are those of all nodes.
    saved = (F.col("n_convs") - 1) * F.col("chars")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    below = nodes.where("parent IS NOT NULL").agg(F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved"))
    joined = nodes.join(arcs, ["conv", "depth"]).withColumn("_all", below.select(F.struct("*")).scalar())
    at_exit = {c: F.coalesce(f"{c}_{EXIT}", F.coalesce(f"_all.{c}", total)) for c in ("leaves", "saved")}
    return joined.select(
        "conv",
        "depth",
        "parent",
        "n_convs",
        "n_children",
        (at_exit["leaves"] - F.col(f"leaves_{ENTER}") + leaf).alias("n_leaves"),
        (at_exit["saved"] - F.col(f"saved_{ENTER}") + saved).alias("saved_tokens"),
        "ends_sha256",
    )
