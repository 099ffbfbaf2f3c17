"""Values of a group put on its rows, and tests that keep or drop whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.ranks import exact_quantiles, running_total, with_position
from cohortlake.operators.skew import attach_stats, keep_groups, skew_join, with_one_row
from cohortlake.session import cut_lineage


def exact_kinds(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """Groups whose rows are exactly one of each named kind.

    Counting replaces sorting the kinds of a group into one text: a group with a
    kind twice, or with any other kind, is dropped either way.
    """
    test = F.count(F.lit(1)) == len(kinds)
    for k in kinds:
        test = test & (F.sum(F.when(F.col(kind) == k, 1).otherwise(0)) == 1)
    return keep_groups(df, keys, test)


def group_has_any(df: DataFrame, keys: Sequence[str], condition: Column, out: str) -> DataFrame:
    """Flag on every row: the group has at least one row meeting the condition."""
    return attach_stats(df, keys, **{out: F.bool_or(F.coalesce(condition, F.lit(False)))})


def any_replicate_hit(df: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Keep groups where the condition holds in at least one replicate."""
    return keep_groups(df, keys, F.bool_or(F.coalesce(hit, F.lit(False))))


def baseline_broadcast(
    df: DataFrame, subject: str, is_baseline: Column, value: Column, out: str, dominant_above: float
) -> DataFrame:
    """The subject's baseline value on all its rows, with detect and dominant flags.

    Fails when a subject has two different baselines.
    """
    at_baseline = F.when(is_baseline, value)
    low, high = F.min(at_baseline), F.max(at_baseline)
    checked = F.when(low == high, high).when(
        high.isNotNull(), F.raise_error(F.lit("a subject has more than one baseline value"))
    )
    return attach_stats(df, [subject], **{out: checked}).select(
        "*",
        (F.col(out) > 0).alias("detect"),
        (F.col(out) > dominant_above).alias("dominant"),
    )


def event_near_flag(
    df: DataFrame, subject: str, day: str, event: Column, condition: Column, reach: int, out: str
) -> DataFrame:
    """Event on a row with the condition within ``reach`` rows of the same subject.

    Expects one row per subject and day, so a subject's window holds at most as
    many rows as there are days. Rows never borrow from another subject.
    """
    window = Window.partitionBy(subject).orderBy(day)
    near = condition
    for step in range(1, reach + 1):
        near = near | F.coalesce(F.lag(condition, step).over(window), F.lit(False))
        near = near | F.coalesce(F.lead(condition, step).over(window), F.lit(False))
    return df.withColumn(out, event & near)


def running_breaks(df: DataFrame, cohort: str, subject: str) -> DataFrame:
    """Positions between subjects in a row of all rows of a cohort; none after the last."""
    sizes = df.groupBy(cohort, subject).agg(F.count(F.lit(1)).alias("_rows"))
    running = running_total(sizes, [cohort], [F.col(subject)], with_totals=True, _through=F.col("_rows"))
    return running.where(F.col("_through") < F.col("_through_total")).select(
        cohort, subject, (F.col("_through") + 0.5).alias("linebreak")
    )


def sequence_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str, chunk: int | None = None
) -> DataFrame:
    """Position within the group, and which chunk of a fixed length it falls in."""
    placed = with_position(df, group, order, out)
    if chunk is None:
        return placed
    return placed.withColumn("chunk", (F.floor((F.col(out) - 1) / chunk) + 1).cast("long"))


def quantile_broadcast(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact group quantiles on every row of the group."""
    return skew_join(df, cut_lineage(exact_quantiles(df, group, value, probs)), group)


def first_distinct_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense index 1..K over the sorted distinct keys."""
    return with_position(df.select(key).distinct(), [], [F.col(key)], out)


def model_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows with an integer code for the key, the row count and the number of codes."""
    index = cut_lineage(first_distinct_index(df.where(F.col(key).isNotNull()), key, out))
    coded = skew_join(df, index, [key], "left")
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    codes = index.agg(F.count(F.lit(1)).alias("k"))
    return with_one_row(with_one_row(coded, rows, "_rows"), codes, "_codes").select(
        *df.columns, out, F.col("_rows.n").alias("n"), F.col("_codes.k").alias(f"n_{key}")
    )


def center_in_group(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Value minus its group mean: a per-group vector function as an aggregate and a join."""
    staged = df.withColumn("_v", value)
    return attach_stats(staged, keys, _mean=F.avg("_v")).select(
        *df.columns, (F.col("_v") - F.col("_mean")).alias(out)
    )
