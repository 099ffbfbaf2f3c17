"""Byte-balanced shards by histogram sort.

Rows are ordered by a key; shard boundaries are keys. Candidate boundaries (probes) are
counted exactly, bytes below each, over all partitions at once; each round probes only the
interval that holds a boundary still out of tolerance, until every boundary is within
tolerance or no key is left inside its interval. Rows move once, by their final range.

Rows of equal key stay together, so a group larger than the tolerance shifts its boundary
to the nearer end. Null keys are not allowed; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ranks import bucket_of, with_position

PROBES = 31
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _bytes_below(rows: DataFrame, key: str, size: str, probes: list[int]) -> tuple[list[int], int]:
    """Exact bytes with a key below each probe, and in all: one small aggregate, a few hundred rows."""
    counted = rows.groupBy(bucket_of(F.col(key), probes).alias("b")).agg(F.sum(size).alias("bytes")).collect()
    by_bucket = {r["b"]: r["bytes"] for r in counted}
    below, total = [], 0
    for b in range(len(probes) + 1):
        total += by_bucket.get(b, 0)
        below.append(total)
    return below[:-1], total


def splitters(rows: DataFrame, key: str, size: str, shards: int, tolerance: float = 0.001) -> list[int]:
    """``shards - 1`` ascending boundary keys; a row belongs above a boundary when its key is not below it.

    ``tolerance``: allowed distance from the ideal, as a part of a shard.
    """
    step = (HIGHEST - LOWEST) // (PROBES * shards + 1)
    probes = [LOWEST + step * i for i in range(1, PROBES * shards + 1)]
    below, total = _bytes_below(rows, key, size, probes)
    if not total or shards == 1:
        return probes[: shards - 1]
    ideal = [total * k / shards for k in range(1, shards)]
    allowed = tolerance * total / shards
    interval = [(LOWEST, 0, HIGHEST, total)] * (shards - 1)
    final: list[int | None] = [None] * (shards - 1)
    while True:
        known = list(zip(probes, below, strict=True))
        for k in range(shards - 1):
            if final[k] is not None:
                continue
            low, low_bytes, high, high_bytes = interval[k]
            for probe, count in known:
                if low < probe < high:
                    if count <= ideal[k]:
                        low, low_bytes = probe, count
                    else:
                        high, high_bytes = probe, count
                        break
            near = (low, low_bytes) if ideal[k] - low_bytes <= high_bytes - ideal[k] else (high, high_bytes)
            if abs(near[1] - ideal[k]) <= allowed or high - low <= 1:
                final[k] = near[0]
            interval[k] = (low, low_bytes, high, high_bytes)
        if None not in final:
            return sorted(final)
        fresh = set()
        for k in range(shards - 1):
            low, _, high, _ = interval[k]
            if final[k] is None:
                fresh.update(low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1))
        probes = sorted(p for p in fresh if LOWEST < p < HIGHEST)
        below, _ = _bytes_below(rows, key, size, probes)


def shard_by_bytes(
    rows: DataFrame, key: str, size: str, order: list[str], shards: int = 8, tolerance: float = 0.001
) -> DataFrame:
    """Add ``shard`` and ``slot`` (0-based place in the shard, by key and then ``order``).

    The table is read once per round and should be written down before.
    """
    cuts = splitters(rows, key, size, shards, tolerance)
    # Equal boundaries leave a shard between them empty.
    shard = sum((F.when(F.col(key) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = with_position(rows.withColumn("shard", shard), ["shard"], [F.col(key), *[F.col(c) for c in order]], "slot")
    return placed.withColumn("slot", F.col("slot") - 1)
