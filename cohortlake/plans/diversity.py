"""Does sample diversity differ between exposed and unexposed groups?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ranktests import wilcoxon_ranksum
from cohortlake.operators.skew import join_null_safe
from cohortlake.operators.summaries import summary_by_stratum
from cohortlake.operators.transforms import shannon


def diversity_by_exposure(counts: DataFrame, samples: DataFrame, sample: str, n: str, exposed: str) -> DataFrame:
    """Shannon index per sample, summarised overall and by exposure, with a rank-sum test."""
    diversity = shannon(counts, sample, n).join(samples.select(sample, exposed), sample)
    table = summary_by_stratum(diversity, exposed, ["shannon"], []).select(
        "variable", "stratum", "n", "median", "q1", "q3"
    )
    test = wilcoxon_ranksum(diversity, exposed, ["shannon"]).select("variable", "w", "z", "p_value")
    return join_null_safe(table, test, ["variable"])
