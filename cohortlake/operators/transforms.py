"""Numeric transforms of abundance tables (sample, feature, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.skew import attach_stats, keep_groups, skew_join, with_one_row
from cohortlake.session import cut_lineage


def relative_abundance(df: DataFrame, sample: str, feature: str, family: str, n: str) -> DataFrame:
    """Feature and family share of each sample's total, on every (sample, feature) row."""
    cells = df.groupBy(sample, feature, family).agg(F.sum(n).alias(n))
    by_family = cells.groupBy(sample, family).agg(F.sum(n).alias("family_n"), F.count(F.lit(1)).alias("_rows"))
    # One row per sample and family here, so this window holds a sample's families only.
    families = cut_lineage(by_family.withColumn("total", F.sum("family_n").over(Window.partitionBy(sample))))
    return skew_join(cells, families, [sample, family], rows="_rows").select(
        sample,
        feature,
        family,
        n,
        F.try_divide(n, "total").alias("feature_share"),
        F.try_divide("family_n", "total").alias("family_share"),
    )


def clr(df: DataFrame, sample: str, n: str, out: str) -> DataFrame:
    """Centred log-ratio over a sample's listed features, zeros counted as one."""
    logged = df.withColumn("_log", F.log(F.greatest(F.col(n), F.lit(1)).cast("double")))
    return attach_stats(logged, [sample], _mean=F.avg("_log")).select(
        *df.columns, (F.col("_log") - F.col("_mean")).alias(out)
    )


def impute_min(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Fill nulls in the columns with the smallest value of the source column."""
    staged = with_one_row(df, df.agg(F.min(source).alias("m")), "_low")
    return staged.select(
        *[F.coalesce(F.col(c), F.col("_low.m")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def proportion(df: DataFrame, keys: Sequence[str], part: str, whole: str, out: str) -> DataFrame:
    """Part over whole on distinct rows; null where the whole is zero."""
    return df.select(*keys, part, whole).distinct().select(*keys, F.try_divide(part, whole).alias(out))


def exp_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Point estimates and bounds to the ratio scale."""
    return df.select(*[F.exp(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def shannon(df: DataFrame, sample: str, n: str, out: str = "shannon") -> DataFrame:
    """Shannon index per sample, base e, in one aggregate: ``ln N - sum(n ln n) / N``."""
    x = F.col(n).cast("double")
    return (
        df.where(x > 0)
        .groupBy(sample)
        .agg((F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x)).alias(out))
    )


def detectable_features(df: DataFrame, feature: str, n: str) -> DataFrame:
    """Rows of features seen at least once in these samples."""
    return keep_groups(df, [feature], F.sum(n) > 0)


def floor_log(value: Column, floor: float) -> Column:
    """log10 at or above the floor, else null."""
    return F.when(value >= floor, F.log10(value))


def taxon_rollup(df: DataFrame, labels: DataFrame, sample: str, feature: str, n: str, rank: str) -> DataFrame:
    """Counts of features rolled up to a coarser label."""
    return (
        skew_join(df, labels.select(feature, rank), [feature])
        .groupBy(sample, rank)
        .agg(F.sum(n).alias(n))
    )
