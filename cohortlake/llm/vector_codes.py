"""Product codes of vectors, exact, with a GNAT over the entries of each codebook.

Components become integers, ``floor(scale * x)``; vectors are cut into equal parts, and each part
position has a codebook, which starts as the parts of the vectors of smallest ids. A round assigns
every part to its nearest entry and moves the entries to the floor of their parts' means.

The nearest entry is searched in a GNAT (geometric near-neighbour access tree). A node has split
points, each with a child that holds the entries nearest to it; for each split point and child it
stores the range of their distances. A query's distance to a split point, with the best distance
so far, rules out each child whose range it misses strictly. Distances in these tests are roots, so they
are rounded outwards; what decides is integer: squared distances of all entries that are not ruled
out, the lowest index first at ties.

A task adds up the parts of each entry it meets, so what is shuffled and what reaches the driver
(one row for each entry) is bounded by the codebooks and not by the table. All parts of a node go
through the tree together, as arrays.

Rows: vectors that are null or hold null or non-finite components are left out. Shorter vectors are
filled up with zeros to the longest one's length and that to a multiple of the parts. Rows with a null
id are coded but start no entry; of rows that repeat an id the smallest vector starts one. Equal rows get
equal codes. With fewer ids than entries the codebooks are smaller. Components of any finite size are exact (Python's
integers where 64-bit floats would round); errors beyond a long become the largest long. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.words import slices
from cohortlake.operators.skew import attach_stats
from cohortlake.session import materialize

SPLITS = 16
LEAF = 16
SLACK = 2.0**-48
BATCH = 1 << 18
LARGEST = (1 << 63) - 1
# Scaled components beyond it count as not finite: their squares are.
FINITE = 1e150


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``(rows of x, rows of y)``, exact: 64-bit floats that hold integers, or Python's integers."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x.dot(y.T)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


class Gnat:
    """Nearest entry of a codebook; ``entries``: integers, one row each."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries, self.splits, self.leaf = entries, splits, leaf
        self.tested = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray):
        """``(split ids, ranges' lower bounds, upper bounds, children)``, or the members of a leaf."""
        if len(members) <= self.leaf:
            return members
        points = self.entries[members]
        # Split points far from each other: each the farthest from those before it.
        chosen = [0]
        nearest = squared_distances(points, points[:1])[:, 0]
        while len(chosen) < self.splits and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared_distances(points, points[chosen[-1:]])[:, 0])
        if len(chosen) == 1:  # all entries are equal
            return members
        distance = squared_distances(points, points[chosen])
        owner = distance.astype(object).argmin(1) if distance.dtype == object else distance.argmin(1)
        owner[chosen] = np.arange(len(chosen))
        rest = np.ones(len(members), bool)
        rest[chosen] = False
        low, high, children = np.full((len(chosen),) * 2, np.inf), np.full((len(chosen),) * 2, -np.inf), []
        root = _roots(distance)
        for j in range(len(chosen)):
            inside = rest & (owner == j)
            children.append(self._node(members[inside]) if inside.any() else None)
            if inside.any():
                low[:, j] = root[inside].min(0) * (1 - SLACK)
                high[:, j] = root[inside].max(0) * (1 + SLACK)
        return members[chosen], low, high, children

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lowest at ties, and the squared distance."""
        best = np.full(len(parts), np.inf) if parts.dtype != object else np.array([None] * len(parts), object)
        index = np.full(len(parts), len(self.entries))
        if len(parts):
            self._visit(self.root, np.arange(len(parts)), parts, best, index)
        return index, best

    def _meet(self, ids: np.ndarray, at: np.ndarray, parts, best, index) -> np.ndarray:
        """Compares parts with entries in integers; the squared distances."""
        ids = np.sort(ids)
        distance = squared_distances(parts[at], self.entries[ids])
        self.tested += distance.size
        closest = distance.argmin(1)
        found, known = distance[np.arange(len(at)), closest], index[at] < len(self.entries)
        if parts.dtype == object:
            better = np.array([not k or f < b or (f == b and c < i) for k, f, b, c, i in zip(known, found, best[at], ids[closest], index[at], strict=True)], bool)
        else:
            better = (found < best[at]) | ((found == best[at]) & (ids[closest] < index[at]))
        best[at[better]], index[at[better]] = found[better], ids[closest][better]
        return distance

    def _visit(self, node, at: np.ndarray, parts, best, index) -> None:
        if isinstance(node, np.ndarray):
            self._meet(node, at, parts, best, index)
            return
        splits, low, high, children = node
        order = np.argsort(splits)
        distance = np.empty((len(at), len(splits)))
        distance[:, order] = _roots(self._meet(splits, at, parts, best, index))
        below, above = distance * (1 - SLACK), distance * (1 + SLACK)
        home = distance.argmin(1)
        # Each part's nearest child first: it shrinks the distance that rules out the others.
        for own in (True, False):
            for j, child in enumerate(children):
                if child is None:
                    continue
                here = np.flatnonzero((home == j) == own)
                if not own and len(here):
                    reach = _roots(best[at[here]])[:, None] * (1 + SLACK)
                    gap = np.maximum(below[here] - high[:, j], low[:, j] - above[here])
                    here = here[~(gap > reach + SLACK * (above[here] + high[:, j])).any(1)]
                if len(here):
                    self._visit(child, at[here], parts, best, index)


def _exact(largest: float, length: int) -> bool:
    """Whether squared distances of such components are exact in 64-bit floats."""
    return 4.0 * max(1, length) * largest * largest < 2.0**52


class Codebooks:
    """The entries of all part positions and the trees over them."""

    def __init__(self, books: list[np.ndarray], exact: bool):
        self.exact = exact
        self.books = books
        self.trees = [Gnat(book) for book in books]

    def rows(self, column: pa.Array, length: int) -> np.ndarray:
        """Vectors as one row each, filled up with zeros."""
        lengths = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        if (lengths == length).all():
            out = values.reshape(len(lengths), length)
        else:
            out = np.zeros((len(lengths), length))
            out[np.arange(length)[None, :] < lengths[:, None]] = values
        return out if self.exact else np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)

    def assign(self, vectors: np.ndarray):
        """For each part position: its parts, their entries and squared distances."""
        width = vectors.shape[1] // len(self.books)
        for p, tree in enumerate(self.trees):
            parts = vectors[:, p * width : (p + 1) * width]
            yield parts, *tree.nearest(parts)


def _blocks(batches, length: int):
    for batch in batches:
        for part in slices([length] * batch.num_rows, BATCH):
            yield batch.slice(part.start, part.stop - part.start)


def _sum_parts(books: Codebooks, length: int):
    """``part, entry, n, sums``: what a task's parts add to each entry."""

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for block in _blocks(batches, length):
            for p, (parts, index, _) in enumerate(books.assign(books.rows(block.column(0), length))):
                order = np.argsort(index, kind="stable")
                entries, begin = np.unique(index[order], return_index=True)
                # Sums of integers below 2 ** 26, at most BATCH at once, are exact.
                added = np.add.reduceat(parts[order], begin, axis=0) if len(entries) else []
                n = np.diff(np.r_[begin, len(order)])
                for e, k, row in zip(entries.tolist(), n.tolist(), added, strict=True):
                    held = sums.setdefault((p, e), [0, [0] * len(row)])
                    held[0] += k
                    held[1] = [a + int(b) for a, b in zip(held[1], row, strict=True)]
        keys = list(sums)
        yield _sums_batch(keys, [sums[k] for k in keys])

    return run


def _sums_batch(keys, held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([n for n, _ in held], pa.int64()),
            pa.array([[str(x) for x in row] for _, row in held], pa.list_(pa.string())),
        ],
        ["part", "entry", "n", "sums"],
    )


def _add_sums(batches):
    """The sums of each entry; all rows of an entry are in one partition, one from each task before."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for p, e, n, row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            held = sums.setdefault((p, e), [0, [0] * len(row)])
            held[0] += n
            held[1] = [a + int(b) for a, b in zip(held[1], row, strict=True)]
    keys = list(sums)
    yield _sums_batch(keys, [sums[k] for k in keys])


def _moved(books: list[np.ndarray], sums: list) -> list[list[list[int]]]:
    """Floors of the means; entries without parts stay."""
    out = [[[int(x) for x in entry] for entry in book] for book in books]
    for row in sums:
        out[row["part"]][row["entry"]] = [int(x) // row["n"] for x in row["sums"]]
    return out


def _code_rows(books: Codebooks, length: int):
    names = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for block in _blocks(batches, length):
            codes, error = np.full(block.num_rows, ""), np.zeros(block.num_rows, object)
            for _, index, squares in books.assign(books.rows(block.column(2), length)):
                codes = np.char.add(codes, names[index])
                error = error + np.array([int(x) for x in squares], object)
            capped = [min(int(x), LARGEST) for x in error]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(codes.tolist(), pa.string()), pa.array(capped, pa.int64())],
                ["id", "label", "code", "error"],
            )

    return run


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``id, label, code, error, label_error`` for each vector that is whole, and the codebooks.

    ``code``: two hex digits for each part (so at most 256 entries). ``error``: squared distances added
    over the parts; ``label_error``: errors added over equal labels. Codebooks: part, entry, components.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * float(scale)) <= FINITE, F.lit(False)))
    scaled = F.transform(vector, lambda x: _floor(x.cast("double") * float(scale)))
    rows = materialize(
        df.where(F.col(vector).isNotNull() & whole).select(
            F.col(id_col).alias("id"), F.col(label).alias("label"), scaled.alias("whole")
        ),
        "vectors",
    )
    shape = rows.agg(
        F.max(F.size("whole")).alias("length"),
        F.max(F.array_max(F.transform("whole", F.abs))).alias("largest"),
    ).first()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if shape["length"] is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    length = -(-shape["length"] // parts) * parts
    exact = _exact(shape["largest"] or 0.0, length)
    first = (
        rows.where("id IS NOT NULL").groupBy("id").agg(F.min("whole").alias("whole")).orderBy("id").limit(entries).collect()
    )
    padded = [[int(x) for x in r["whole"]] + [0] * (length - len(r["whole"])) for r in first]
    if not padded:  # no row has an id: one entry of zeros
        padded = [[0] * length]
    width = length // parts
    books = [[v[p * width : (p + 1) * width] for v in padded] for p in range(parts)]
    kind = float if exact else object

    def trees() -> Codebooks:
        return Codebooks([np.array(book, kind).reshape(len(book), width) for book in books], exact)

    for _ in range(rounds):
        added = (
            rows.select("whole")
            .mapInArrow(_sum_parts(trees(), length), "part int, entry int, n long, sums array<string>")
            .repartition("part", "entry")
            .mapInArrow(_add_sums, "part int, entry int, n long, sums array<string>")
        )
        # One row for each entry: parts * entries at most.
        books = _moved(books, added.collect())
    coded = materialize(
        rows.mapInArrow(_code_rows(trees(), length), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes"
    )
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    return attach_stats(coded, ["label"], label_error=total), books


def _floor(x):
    """Largest integer not above ``x``, as a double of any size."""
    bound = float(1 << 53)
    return F.when(F.abs(x) >= bound, x).otherwise(F.floor(F.when(F.abs(x) < bound, x)).cast("double"))


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in order of part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
