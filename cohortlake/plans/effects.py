"""Effect tables across cohorts and transforms, and counts of what they show."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.labels import certainty_class, matches
from cohortlake.operators.frames import member_filter, tagged_union
from cohortlake.operators.groups import any_replicate_hit
from cohortlake.operators.skew import skew_join
from cohortlake.operators.summaries import zscore
from cohortlake.operators.transforms import clr, exp_scale
from cohortlake.session import materialize


def apart(low: str, high: str) -> Column:
    """The interval does not hold zero."""
    return (F.col(low) > 0) | (F.col(high) < 0)


def with_certainty(effects: DataFrame) -> DataFrame:
    return effects.withColumn(
        "certainty", certainty_class(apart("q5", "q95"), apart("q10", "q90"), apart("q25", "q75"))
    )


def transform_effects(
    counts: DataFrame,
    outcomes: DataFrame,
    sample: str,
    feature: str,
    n: str,
    cohort: str,
    outcome: str,
    quantiles: Mapping[str, float],
    pooled: str = "Pooled",
) -> dict[str, DataFrame]:
    """Effects of each feature on a 0/1 outcome under two transforms, per cohort and pooled: ``feature, cohort`` and quantiles.

    ``Scaled``: counts centred and scaled over the table. ``CLR Transformed``: log counts less their sample's mean log;
    cells without a count are left out. One grouped pass gives the sums of both. An effect is the log odds
    ratio of one scoring step from no effect, ``cov(x, y) / (p (1 - p) var(x))``, with its standard error and normal quantiles;
    groups without spread in x or y have none. ``outcomes``: ``sample, cohort, outcome``, one row per sample.
    """
    seen = clr(skew_join(counts.where(F.col(n) > 0), outcomes, [sample]).select(sample, feature, cohort, outcome, n), sample, n, "_clr")
    cells = zscore(seen, {n: "_scaled"})
    x_of = {"Scaled": "_scaled", "CLR Transformed": "_clr"}
    named = cells.withColumn("_in", F.col(cohort).cast("string"))
    sums = named.groupingSets([[feature, "_in"], [feature]], feature, "_in").agg(
        F.when(F.grouping("_in") == 1, F.lit(pooled)).otherwise(F.col("_in")).alias("_cohort"),
        F.avg(outcome).alias("_p"),
        F.count(F.lit(1)).alias("_k"),
        *[F.covar_pop(x, outcome).alias(f"c{x}") for x in x_of.values()],
        *[F.var_pop(x).alias(f"v{x}") for x in x_of.values()],
    )
    sums = materialize(sums.drop("_in"), "transform-sums")
    tables = {}
    for form, x in x_of.items():
        curve = F.col("_p") * (1 - F.col("_p")) * F.col(f"v{x}")
        effect, error = F.col(f"c{x}") / curve, 1 / F.sqrt(F.col("_k") * curve)
        bounds = [(effect + error * F.lit(NormalDist().inv_cdf(p))).alias(q) for q, p in quantiles.items()]
        tables[form] = sums.where(curve > 0).select(feature, F.col("_cohort").alias(cohort), *bounds)
    return tables


def effect_compare(
    tables: Mapping[str, DataFrame], tag: str, feature: str, included: DataFrame, bounds: Sequence[str]
) -> DataFrame:
    """The same features' effects under several transforms, on the ratio scale.

    Keeps features certain at 10 percent in at least one table and cohort, and
    listed in ``included``.
    """
    both = member_filter(tagged_union(tables, tag), included, [feature])
    hits = any_replicate_hit(both, [feature], apart("q10", "q90"))
    return exp_scale(with_certainty(hits), bounds)


def effect_counts(effects: DataFrame, feature: str, genus: str, named: Mapping[str, str]) -> DataFrame:
    """One row: distinct features in all, certain, by direction, and protective by genus pattern."""
    down = F.col("q90") < 0
    tests = {
        "features": F.lit(True),
        "certain_10": apart("q10", "q90"),
        "certain_5": apart("q5", "q95"),
        "raising": F.col("q10") > 0,
        "lowering": down,
        **{f"lowering_{name}": down & matches(genus, pattern, ignore_case=True) for name, pattern in named.items()},
    }
    per_feature = effects.groupBy(feature).agg(*[F.bool_or(test).alias(name) for name, test in tests.items()])
    return per_feature.agg(*[F.count_if(F.col(name)).alias(name) for name in tests])


def hit_features(effects: DataFrame, feature: str) -> DataFrame:
    """Distinct features certain at 5 percent in any cohort."""
    return effects.where(apart("q5", "q95") & F.col(feature).isNotNull()).select(feature).distinct()
