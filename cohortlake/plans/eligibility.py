"""Who is in the cohort: eligibility counts by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclusion_flow(df: DataFrame, subject: str, by: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Distinct subjects per cohort, excluded by each rule, and left by all rules.

    One pass reduces the rows to one per subject with a flag per rule; counting
    flags afterwards avoids one distinct count per rule.
    """
    flags = {name: F.bool_or(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()}
    per_subject = df.groupBy(*by, subject).agg(*flags.values())
    kept = F.lit(True)
    for name in rules:
        kept = kept & ~F.col(name)
    return per_subject.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(F.col(name)).alias(name) for name in rules],
        F.count_if(kept).alias("included"),
    )
