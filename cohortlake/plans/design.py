"""From counts and subjects to the rows of a regression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.frames import feature_columns
from cohortlake.operators.groups import first_distinct_index
from cohortlake.operators.skew import attach_stats, keep_groups, skew_join
from cohortlake.operators.summaries import zscore
from cohortlake.session import materialize


def design_matrix(
    counts: DataFrame,
    outcomes: DataFrame,
    keep: Column,
    chosen: Mapping[str, str],
    sample: str = "sample",
    feature: str = "feature",
    n: str = "n",
) -> tuple[DataFrame, list[str]]:
    """Scaled, indexed rows (sample, outcome…, feature, x, total, fixed…, feature_num).

    ``outcomes`` has one row per sample and ``keep`` selects among them; ``chosen``
    features become fixed columns. Totals are those of the kept samples. Features never seen in the kept samples are
    dropped. A fixed column without spread cannot be scaled: it is dropped and
    named in the second result.
    """
    kept = skew_join(counts, outcomes.where(keep), [sample])
    with_total = attach_stats(kept, [sample], total=F.sum(n))
    rows = feature_columns(with_total, [sample], feature, n, chosen, F.lit(0).cast("long"))
    # Read for the spread, the scaling, the index and the result.
    seen = materialize(keep_groups(rows, [feature], F.sum(n) > 0).withColumnRenamed(n, "x"), "design-rows")
    spread = seen.agg(*[F.var_samp(c).alias(c) for c in chosen.values()]).first()
    flat = [c for c in chosen.values() if not spread[c]]
    scaled = zscore(
        seen.drop(*flat), {c: c for c in ["x", "total", *[c for c in chosen.values() if c not in flat]]}
    )
    index = first_distinct_index(seen, feature, "feature_num")
    return skew_join(scaled, index, [feature]), flat
