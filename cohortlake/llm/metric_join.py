"""Exact range join of vectors by cosine, in cells of a metric space.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Every vector belongs
to the cell of its nearest pivot. It also visits a cell whose dividing plane it may reach
across: by the triangle inequality a partner at distance r in cell p forces
``d(x, p)^2 - d(x, own)^2 <= 2 r d(p, own)``. A pair of two cells meets in the lower one, so each
pair meets exactly once. A large cell is cut into tiles; tiles join independently, each in
bounded memory. Candidates are found in single precision with a margin, then decided in double.

Equal vectors form one class with a weight. Tiles add up link counts and join their links into
stars, so nothing grows with the square of a group but arithmetic.

The length of a vector is part of its cell's name, so vectors of all lengths go through one placement and one join
of tiles. Only lengths with vectors for two tiles or more have pivots; the vectors of any other length are one cell.

Rows: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
lengths do not link. Rows with a null id link with nothing. Repeated rows count as links of each other; rows that share an
id but not a vector each have their own links. A cosine equal to the bound is a link. An empty table gives an empty one. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.components import connected_components, forest
from cohortlake.session import materialize

TILE = 4096
MAX_PIVOTS = 512
CELLS = 1 << 16
BATCH = 1024
MARGIN = 1e-4


def _units(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _pack(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, unit``: valid vectors scaled to length one, as packed doubles; ``unit`` null otherwise."""

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) if v and None not in v else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                x = x / top if 0 < top < np.inf else np.zeros(0)
                norm = np.sqrt(x @ x)
                out.append((x / norm).astype("<f8").tobytes() if norm > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "unit"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(pack, "id long, unit binary")


def _place(pivots: dict[int, np.ndarray], radius: float):
    """Each vector's cells: its own first, then those it visits (with a lower number only).

    ``pivots``: by the bytes of a vector; a length without pivots is one cell. A cell's name is those
    bytes times ``CELLS`` plus its number.
    """
    between = {n: np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)) for n, p in pivots.items()}

    def cells_of(packed, length):
        """Places in the list and cells: each vector's own, then its visits."""
        if length not in pivots:
            return np.arange(len(packed)), np.zeros(len(packed), np.int64)
        x, known = _units(packed), pivots[length]
        squared = np.maximum(2 - 2 * x @ known.T, 0)
        own = squared.argmin(1)
        reach = squared - squared[np.arange(len(x)), own][:, None] <= 2 * radius * between[length][own] + 1e-9
        row, cell = np.nonzero(reach & (np.arange(len(known)) < own[:, None]))
        return np.r_[np.arange(len(x)), row], np.r_[own, cell]

    def place(batches):
        for batch in batches:
            ids, packed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lengths = np.array([len(p) for p in packed], np.int64)
            for length in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == length)
                for at in range(0, len(of), BATCH):
                    some = of[at : at + BATCH]
                    row, cell = cells_of([packed[i] for i in some], length)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[some[row]], pa.int64()),
                            pa.array(length * CELLS + cell, pa.int64()),
                            pa.array((np.arange(len(row)) >= len(some)).astype(np.int32)),
                        ],
                        ["id", "cell", "visits"],
                    )

    return place


def _tile_links(cosine: float):
    """Joins each tile: home vectors stay, then tile-mates and visitors stream past in batches."""

    def run(batches):
        tile, home = None, None

        def finish():
            ids, _, weights, label, count = home
            moved = label != np.arange(len(ids))
            hit = (count > 0) | moved
            return ids[hit], count[hit], ids[label[hit]]

        for batch in batches:
            cells, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            roles, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            weights, packed = batch.column(4).to_numpy(), batch.column(5).to_pylist()
            out = []
            cut = np.flatnonzero((np.diff(cells) != 0) | (np.diff(tiles) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(ids)], strict=True):
                here = (cells[a], tiles[a])
                if here != tile:
                    if home is not None:
                        out.append(finish())
                    tile, home = here, None
                x = _units(packed[a:b])
                if roles[a] == 0:
                    if home is None:
                        home = (ids[a:b], x, weights[a:b], np.arange(b - a), np.zeros(b - a, np.int64))
                    else:
                        n = len(home[0])
                        home = (
                            np.r_[home[0], ids[a:b]],
                            np.concatenate([home[1], x]),
                            np.r_[home[2], weights[a:b]],
                            np.arange(n + b - a),
                            np.zeros(n + b - a, np.int64),
                        )
                    continue
                if home is None:
                    continue
                for at in range(a, b, BATCH):
                    out.append(meet(home, ids[at : min(b, at + BATCH)], x[at - a : at - a + BATCH],
                                    weights[at : min(b, at + BATCH)], roles[a] == 1))
            yield record(out)
        if home is not None:
            yield record([finish()])

    def meet(home, ids, x, weights, mates):
        """Adds links to the home vectors' counts; returns the visitors' counts and a star link each."""
        own, units, own_weights, label, count = home
        near = x.astype(np.float32) @ units.astype(np.float32).T >= cosine - MARGIN
        row, col = np.nonzero(near)
        if mates:  # the tile against itself: each pair once
            later = ids[row] > own[col]
            row, col = row[later], col[later]
        exact = np.concatenate(
            [np.zeros(0, bool)]
            + [
                np.einsum("ij,ij->i", x[row[i : i + 65536]], units[col[i : i + 65536]]) >= cosine
                for i in range(0, len(row), 65536)
            ]
        )
        row, col = row[exact], col[exact]
        if not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        np.add.at(count, col, weights[row])
        gained = np.bincount(row, own_weights[col], len(ids)).astype(np.int64)
        # Union of the home labels that a row ties together, and the row itself.
        low = np.full(len(ids), len(own), np.int64)
        np.minimum.at(low, row, label[col])
        a, b = forest(label[col], len(own) + row)
        root = np.arange(len(own) + len(ids))
        root[a] = b
        label[:] = root[label]
        hit = low < len(own)
        return ids[hit], gained[hit], own[root[low[hit]]]

    def record(parts):
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "gained", "star"])

    return run


def cosine_links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``id, n_links, component, kept`` for each row.

    ``n_links`` counts other rows with cosine >= ``cosine``; ``component`` is the smallest id
    reachable by links. The pivots are the vectors with the smallest hashes, at most
    ``MAX_PIVOTS``; their choice changes the time, never the result.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    rows = materialize(_pack(df, id_col, vector), "units")
    valid = rows.where("id IS NOT NULL AND unit IS NOT NULL")
    classes = materialize(valid.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "classes")
    stars = _class_links(classes, cosine, radius)
    stars = materialize(stars, "stars")
    gained = stars.groupBy("id").agg(F.sum("gained").alias("gained"))
    labels = connected_components(stars.where("id <> star").select("id", "star"))
    class_rows = materialize(
        classes.join(gained, "id", "left").join(labels, "id", "left").select(
            "unit",
            (F.coalesce("gained", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "labels",
    )
    joined = valid.join(class_rows, "unit").select("id", "n_links", "component")
    alone = rows.where("id IS NULL OR unit IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each length with vectors for two tiles or more: those with the smallest hashes."""
    lengths = classes.groupBy(F.length("unit").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 2 * TILE)
    out = {}
    for shape in lengths.orderBy("n").toLocalIterator():
        wanted = min(MAX_PIVOTS, shape["rows"] // TILE)
        of = classes.where(F.length("unit") == shape["n"]).select("unit", F.xxhash64("unit").alias("h"))
        out[shape["n"]] = _units([bytes(r["unit"]) for r in of.orderBy("h", "unit").limit(wanted).collect()])
    return out


def _class_links(classes: DataFrame, cosine: float, radius: float) -> DataFrame:
    """Counts and star links of the classes."""
    place = _place(_pivots(classes), radius)
    placed = materialize(classes.select("id", "unit").mapInArrow(place, "id long, cell long, visits int"), "cells")
    sizes = placed.where("visits = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    spread = placed.join(materialize(sizes, "cell-sizes"), "cell").withColumn(
        "own", F.when(F.col("visits") == 0, F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).otherwise(-1)
    )
    # Role 0: the tile's home; 1: the same vectors streaming past; 2: later tiles of the cell, and visitors.
    home = spread.where("visits = 0").select("cell", F.col("own").alias("tile"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "id")
    others = spread.where("own <> 0").withColumn(
        "tile",
        F.explode(F.expr("CASE WHEN own < 0 THEN sequence(0, tiles - 1) ELSE sequence(0, own - 1) END")),
    )
    routed = home.unionByName(others.select("cell", "tile", F.lit(2).alias("role"), "id"))
    full = routed.join(classes.select("id", "weight", "unit"), "id")
    groups = (
        full.select("cell", "tile", "role", "id", "weight", "unit")
        .repartition("cell", "tile")
        .sortWithinPartitions("cell", "tile", "role", "id")
    )
    return groups.mapInArrow(_tile_links(cosine), "id long, gained long, star long")
