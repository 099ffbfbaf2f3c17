"""Connected components of a link table, by contraction and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.session import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as the given ones: each id to the smallest it reaches."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        for side in (left, right):
            np.minimum.at(fresh, side, low)
            np.minimum.at(fresh, label[side], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _contract(batches):
    """A partition's links as stars: at most one link for each id."""
    a, b, kept = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        kept += len(a[-1])
        if kept > 1_000_000:
            stars = forest(np.concatenate(a), np.concatenate(b))
            a, b, kept = [stars[0]], [stars[1]], 0
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of the links that is not its component's smallest.

    ``links``: two long columns without nulls. Each round gives every id its smallest
    neighbour as parent, passes its other neighbours to that parent, and jumps to the
    parent's parent; it ends when neither changes anything. Rounds are few (the logarithm
    of the longest chain), each is written before the next, nothing reaches the driver.
    """
    names = links.columns
    first = links.where(F.col(names[0]) != F.col(names[1])).select(
        F.greatest(*names).alias("a"), F.least(*names).alias("b")
    )
    edges = materialize(first.mapInArrow(_contract, "a long, b long"), "links")
    while True:
        parents = materialize(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        grand = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jumped = parents.join(grand, "p", "left").select(
            "a", F.coalesce("q", "p").alias("b"), F.col("q").isNotNull().alias("moved")
        )
        rest = edges.join(parents, "a").where("b <> p")
        passed = rest.select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(True).alias("moved"))
        following = materialize(jumped.unionByName(passed), "links")
        if following.where("moved").isEmpty():
            return parents.select(F.col("a").alias("id"), F.col("p").alias("component"))
        edges = following.select("a", "b")
