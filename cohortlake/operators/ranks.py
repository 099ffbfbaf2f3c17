"""Positions, running totals and exact quantiles without one task per group.

A window over a group sorts the whole group in one task. Here the order key is
cut into buckets by split points taken from a bounded sample of keys; each
bucket gets its own offset from a small prefix sum, and only (group, bucket) is
sorted. Split points are literals in the plan, so a retried task sees the same
buckets; where they fall changes the balance, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS
from cohortlake.session import materialize, reread, shuffle_width, sized

MAX_BUCKETS = 4096
SAMPLE_PER_BUCKET = 20
SMALL_TABLE = 10_000
FAN_OUT = 64


def split_points(df: DataFrame, key: Column, buckets: int) -> list:
    """At most ``buckets - 1`` ascending key values, from a bounded sample.

    A table of fewer than ``SMALL_TABLE`` rows gets none: it fits one bucket.
    """
    wanted = max(buckets * SAMPLE_PER_BUCKET, SMALL_TABLE)
    sample = df.select(key.alias("_k")).orderBy(F.rand(16)).limit(wanted).collect()
    if len(sample) < SMALL_TABLE or buckets <= 1:
        return []
    # Plain tuples: a row's own ``in`` looks at the names of its fields.
    values = [tuple(row[0]) if isinstance(row[0], tuple) else row[0] for row in sample]
    values = sorted(v for v in values if v is not None and not (isinstance(v, tuple) and None in v))
    step = max(1, len(values) // buckets)
    cuts = []
    for value in values[step::step]:
        if not cuts or value != cuts[-1]:
            cuts.append(value)
    return cuts[: buckets - 1]


def _literal(value) -> Column:
    if isinstance(value, tuple):
        return F.struct(*[F.lit(part).alias(f"c{i}") for i, part in enumerate(value)])
    return F.lit(value)


def bucket_of(key: Column, cuts: list) -> Column:
    """How many split points lie at or below the key (two short scans)."""
    if not cuts:
        return F.lit(0)
    chunks = [cuts[i : i + FAN_OUT] for i in range(0, len(cuts), FAN_OUT)]
    arrays = [F.array(*[_literal(v) for v in chunk]) for chunk in chunks]
    if len(chunks) == 1:
        return F.size(F.filter(arrays[0], lambda s: s <= key))
    heads = F.array(*[_literal(chunk[0]) for chunk in chunks])
    coarse = F.size(F.filter(heads, lambda s: s <= key))
    fine = F.size(F.filter(F.element_at(F.array(*arrays), F.greatest(coarse, F.lit(1))), lambda s: s <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * FAN_OUT + fine)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    buckets: int | None = None,
    with_totals: bool = False,
    **measures: Column,
) -> DataFrame:
    """Inclusive running sums of the measures within the group, in key order.

    ``order`` must be unique within the group for a fixed result. With an empty
    ``group`` the running sum is over the whole table, still spread over buckets.
    ``with_totals`` adds ``<measure>_total``, the sum over the whole group.
    """
    group = list(group)
    buckets = buckets or min(MAX_BUCKETS, shuffle_width(df.sparkSession))
    order = list(order)
    key = order[0] if len(order) == 1 else F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    # Read for the cuts, for the buckets' sums and for the result.
    df = reread(df, "ordered")
    small = df.__dict__.get("_rows", SMALL_TABLE) < SMALL_TABLE
    cuts = [] if small else split_points(df, key, buckets)
    totals = [n for n in measures if with_totals]
    kept = [c for c in df.columns if c not in measures]
    if not cuts:
        one = Window.partitionBy(*(group or [F.lit(0)]))
        upto = one.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            *kept,
            *[F.sum(column).over(upto).alias(name) for name, column in measures.items()],
            *[F.sum(measures[n]).over(one).alias(f"{n}_total") for n in totals],
        )
    # The group as one struct: null groups compare equal, and the join and the
    # window below share one partitioning.
    staged = df.select(
        *kept,
        F.struct(*(group or [F.lit(0)])).alias("_group"),
        bucket_of(key, cuts).alias("_bucket"),
        *[column.alias(name) for name, column in measures.items()],
    )
    sums, held, size = sized(staged.groupBy("_group", "_bucket").agg(*[F.sum(n).alias(f"_s_{n}") for n in measures]), "bucket-sums")
    # At most MAX_BUCKETS rows per group here, whatever the group holds.
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_group",
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in totals],
    )
    if held <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    inside = (
        Window.partitionBy("_group", "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return staged.join(offsets, ["_group", "_bucket"]).select(
        *kept,
        *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(n) for n in measures],
        *[f"{n}_total" for n in totals],
    )


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "position", buckets: int | None = None
) -> DataFrame:
    """Row number within the group, as a long starting at 1."""
    return running_total(df, group, order, buckets, **{out: F.lit(1).cast("long")})


def value_counts(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group: ``ties``, count at or below, count in group."""
    group = list(group)
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # Read by the sample, the bucket sums and the result, so computed and written once.
    counts = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(count.cast("long").alias("ties")), "value-counts"
    )
    return running_total(counts, group, [F.col(value)], with_totals=True, through=F.col("ties"))


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact at any group size.

    The built-in exact percentile holds every distinct value of a group in one
    buffer. Here each distinct value learns its rank range, and a conditional
    sum picks the one or two values each quantile needs.
    """
    group = list(group)
    ranked = value_counts(df, group, value, weight)
    first, last = F.col("through") - F.col("ties"), F.col("through") - 1
    picks = []
    for name, p in probs.items():
        h = (F.col("through_total") - 1) * F.lit(float(p))
        low = F.floor(h)
        frac = h - low
        weight_here = F.when((low >= first) & (low <= last), 1 - frac).otherwise(F.lit(0.0)) + F.when(
            (low + 1 >= first) & (low + 1 <= last), frac
        ).otherwise(F.lit(0.0))
        picks.append(F.sum(F.when(weight_here != 0, F.col(value) * weight_here)).alias(name))
    return ranked.groupBy(*group).agg(*picks)


def mid_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ties and the average rank of the tie."""
    return value_counts(df, group, value).withColumn(
        "mid_rank", F.col("through") - (F.col("ties") - 1) / F.lit(2.0)
    )
