"""Counts, shares, statistics, bins, densities and stratified summary tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ranks import exact_quantiles, with_position
from cohortlake.operators.ranktests import chi_square, fisher_exact, ranksum_of_counts
from cohortlake.operators.skew import join_null_safe, skew_join, with_one_row
from cohortlake.session import cut_lineage, materialize


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_distinct_where(df: DataFrame, key: str, tests: Mapping[str, Column]) -> DataFrame:
    """One row: distinct keys meeting each test on at least one row."""
    flags = df.groupBy(key).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return flags.where(F.col(key).isNotNull()).agg(*[F.count_if(F.col(n)).alias(n) for n in tests])


def share_of_total(df: DataFrame, keys: Sequence[str], count: str = "n", share: str = "share") -> DataFrame:
    """Rows per group and their share of all rows."""
    sizes = count_by(df, keys, count)
    total = sizes.agg(F.sum(count).alias("t")).scalar()
    return sizes.withColumn(share, F.col(count) / total)


def multi_stat(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Sum, smallest, largest, mean, sd, variance and exact quantiles per group."""
    moments = df.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.min(value).alias("smallest"),
        F.max(value).alias("largest"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.var_samp(value).alias("variance"),
    )
    return join_null_safe(moments, exact_quantiles(df, keys, value, dict(probs)), keys, "left")


def variance_ranked(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Variance of a statistic across replicates, largest first."""
    return df.groupBy(*keys).agg(F.var_samp(value).alias(out)).orderBy(F.desc_nulls_last(out), *keys)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of a total order (the order needs a unique last key)."""
    return df.orderBy(*order).limit(n)


def sorted_rows(df: DataFrame, order: Sequence[Column], out: str = "row") -> DataFrame:
    """Total order written down as a row number, without one sorting task."""
    return with_position(df, [], order, out)


def histogram_log10(
    df: DataFrame, keys: Sequence[str], value: str, low: float, width: float, bins: int
) -> DataFrame:
    """Counts in fixed bins of log10(value) per group, with empty bins as zero.

    Values below the first bin count in bin -1, values beyond the last in bin ``bins``;
    these two rows are there only where they hold something.
    """
    at = F.least(F.greatest(F.floor((F.log10(value) - low) / width), F.lit(-1)), F.lit(bins)).cast("int")
    filled = (
        df.where(F.col(value) > 0)
        .withColumn("bin", at)
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = df.where(F.col(value) > 0).select(*keys).distinct()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.unionByName(filled.where(~F.col("bin").between(0, bins - 1)).select(*keys, "bin"))
    return join_null_safe(grid, filled, [*keys, "bin"], "left").select(
        *keys, "bin", (F.lit(low) + F.col("bin") * width).alias("edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def density_grid(df: DataFrame, keys: Sequence[str], value: str, points: int, bins: int) -> DataFrame:
    """Gaussian kernel density per group on an even grid over the group's range.

    Values are first counted in ``bins`` narrow bins per group, so the kernel is
    summed over bounded bins whatever the group holds. Bandwidth is the usual
    ``0.9 * min(sd, IQR / 1.34) * n ** -0.2``; where that minimum is 0 it is the deviation,
    else the size of a value, else 1.
    """
    spread = exact_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    scale = F.coalesce(
        F.nullif(F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34), F.lit(0.0)),
        F.nullif(F.col("_sd"), F.lit(0.0)),
        F.nullif(F.abs("_lo"), F.lit(0.0)),
        F.lit(1.0),
    )
    shape = join_null_safe(moments.where(F.col("_n") > 0), spread, keys).select(
        *keys,
        "_n",
        "_lo",
        ((F.col("_hi") - F.col("_lo")) / bins).alias("_bin_width"),
        ((F.col("_hi") - F.col("_lo")) / (points - 1)).alias("_step"),
        (F.lit(0.9) * scale * F.pow(F.col("_n"), F.lit(-0.2))).alias("_bw"),
    )
    shape = cut_lineage(shape)
    place = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_bin_width")), F.lit(0.0))
    at = F.least(F.floor(place), F.lit(bins - 1))
    binned = (
        skew_join(df.where(F.col(value).isNotNull()), shape, keys)
        .groupBy(*keys, "_n", "_lo", "_bin_width", "_step", "_bw", at.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    center = F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_bin_width")
    x = F.col("_lo") + F.col("point") * F.col("_step")
    z = (x - center) / F.col("_bw")
    kernel = F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_bw") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("_x", x)
        .groupBy(*keys, "point", "_x")
        .agg(F.sum(kernel).alias("density"))
        .withColumnRenamed("_x", "x")
    )


def summary_by_stratum(
    df: DataFrame, stratum: str, continuous: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Table one: each variable, overall (``is_overall``) and by stratum, with missing counts and a test between strata.

    Continuous variables give count, missing count, median and quartiles; categories give a count and share of the
    non-missing per level, beside the missing count of the variable. ``level`` is null for continuous
    variables and for a categorical one without any value. Overall rows have the stratum ``overall``; a stratum
    of that name keeps rows of its own, and so do rows without a stratum.

    ``p_value`` is the variable's, the same on all its rows: the rank-sum test of two strata for numbers; for
    categories the exact test of 2x2 tables with an expected count below five, else the chi-square test. It is null
    where there are not two strata (for numbers: exactly two) or no spread. Rows without a stratum are in no test.
    """
    rows = df.withColumn("_in", F.col(stratum).cast("string"))
    parts = []
    if continuous:
        parts.append(_number_rows(_counted(rows, "double", continuous)))
    if categorical:
        parts.append(_level_rows(_counted(rows, "string", categorical)))
    return functools.reduce(DataFrame.unionByName, parts)


_SUMMARY_KEYS = ["variable", "_all", "_in"]


def _counted(rows: DataFrame, kind: str, variables: Sequence[str]) -> DataFrame:
    """``variable, _all, _in, _value, _c``: each value's count by stratum and, with ``_all``, over all rows; null values, too."""
    long = rows.select("_in", *[F.col(v).cast(kind).alias(v) for v in variables]).unpivot(
        ["_in"], list(variables), "variable", "_value"
    )
    counts = long.groupingSets(
        [["variable", "_value", "_in"], ["variable", "_value"]], "variable", "_value", "_in"
    ).agg(F.grouping("_in").cast("int").alias("_all"), F.count(F.lit(1)).alias("_c"))
    return materialize(counts.select("variable", "_all", "_in", "_value", "_c"), "value-counts")


def _sizes(counts: DataFrame) -> DataFrame:
    there, missing = F.col("_value").isNotNull(), F.col("_value").isNull()
    return counts.groupBy(*_SUMMARY_KEYS).agg(
        F.coalesce(F.sum(F.when(there, F.col("_c"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(missing, F.col("_c"))), F.lit(0)).alias("n_missing"),
    )


def _summary_columns(**columns: Column) -> list[Column]:
    numbers = {c: F.lit(None).cast("double") for c in ("median", "q1", "q3", "percent")}
    every = {"level": F.lit(None).cast("string"), "n": F.col("n"), "n_missing": F.col("n_missing"), **numbers, **columns}
    name = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("_in")).alias("stratum")
    return ["variable", (F.col("_all") == 1).alias("is_overall"), name, *[c.alias(n) for n, c in every.items()], "p_value"]


def _number_rows(counts: DataFrame) -> DataFrame:
    quartiles = exact_quantiles(counts, _SUMMARY_KEYS, "_value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="_c")
    tested = counts.where("_all = 0 AND _in IS NOT NULL AND _value IS NOT NULL")
    # The test has a name for two strata only: the smaller one is the first.
    pair = tested.groupBy("variable").agg(F.min("_in").alias("_low"), F.max("_in").alias("_high"), F.count_distinct("_in").alias("_k"))
    pair = pair.where("_k = 2")
    per_value = join_null_safe(tested, pair, ["variable"]).groupBy("variable", F.col("_value").alias("value")).agg(
        F.sum("_c").alias("ties"), F.sum(F.when(F.col("_in") == F.col("_low"), F.col("_c")).otherwise(F.lit(0))).alias("first")
    )
    p = ranksum_of_counts(per_value).select("variable", "p_value")
    joined = join_null_safe(join_null_safe(_sizes(counts), quartiles, _SUMMARY_KEYS, "left"), p, ["variable"], "left")
    return joined.select(*_summary_columns(**{c: F.col(c) for c in ("median", "q1", "q3")}))


def _level_rows(counts: DataFrame) -> DataFrame:
    levels = counts.where("_value IS NOT NULL").withColumnRenamed("_c", "_level_n")
    tested = levels.where("_all = 0 AND _in IS NOT NULL").select("variable", "_in", F.col("_value").alias("level"), F.col("_level_n").alias("n"))
    tested = materialize(tested, "tested-levels")
    general = chi_square(tested, ["variable"], "_in", "level", "n").where("dof > 0").select("variable", F.col("p_value").alias("_chi"))
    # Tables of two strata and two levels as one row.
    ends = tested.groupBy("variable").agg(
        F.min("_in").alias("_s"), F.count_distinct("_in").alias("_strata"), F.min("level").alias("_l"), F.count_distinct("level").alias("_levels")
    )
    of = lambda s, l: F.coalesce(F.sum(F.when(((F.col("_in") == F.col("_s")) == F.lit(s)) & ((F.col("level") == F.col("_l")) == F.lit(l)), F.col("n"))), F.lit(0))
    small = join_null_safe(tested, ends.where("_strata = 2 AND _levels = 2"), ["variable"]).groupBy("variable").agg(
        of(True, True).alias("a"), of(True, False).alias("b"), of(False, True).alias("c"), of(False, False).alias("d")
    )
    total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    least = F.least(F.col("a") + F.col("b"), F.col("c") + F.col("d")) * F.least(F.col("a") + F.col("c"), F.col("b") + F.col("d"))
    exact = fisher_exact(small.where(least < 5 * total), ["variable"], "a", "b", "c", "d").select("variable", F.col("p_value").alias("_fisher"))
    p = join_null_safe(general, exact, ["variable"], "left").select("variable", F.coalesce("_fisher", "_chi").alias("p_value"))
    sizes = _sizes(counts).withColumnRenamed("n", "_there")
    joined = join_null_safe(join_null_safe(sizes, levels, _SUMMARY_KEYS, "left"), p, ["variable"], "left")
    return joined.withColumn("n", F.coalesce("_level_n", F.lit(0).cast("long"))).select(
        *_summary_columns(level=F.col("_value"), percent=F.try_divide(F.col("_level_n") * 100.0, F.col("_there")))
    )


def zscore(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Centre and scale columns over the whole table; zero spread gives null."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    )
    staged = with_one_row(df, stats, "_z")
    scaled = [
        ((F.col(c) - F.col(f"_z.m_{c}")) / F.nullif(F.col(f"_z.s_{c}"), F.lit(0.0))).alias(out)
        for c, out in columns.items()
    ]
    return staged.select(*[c for c in df.columns if c not in columns.values()], *scaled)
