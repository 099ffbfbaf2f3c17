"""Abundance transforms over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import summaries as S
from cohortlake.operators import transforms as T
from cohortlake.operators.skew import skew_join
from cohortlake.registry import query
from cohortlake.sources import views as V
from cohortlake.sources.views import sql_with, table


@query(
    "relative_abundance",
    sql_with(
        "counts taxonomy",
        """
        SELECT c.sample, c.feature, t.family, c.n,
               round(c.n / sum(c.n) OVER (PARTITION BY c.sample)::DOUBLE, 6) AS feature_share,
               round(sum(c.n) OVER (PARTITION BY c.sample, t.family)
                     / sum(c.n) OVER (PARTITION BY c.sample)::DOUBLE, 6) AS family_share
        FROM counts c JOIN taxonomy t ON t.feature = c.feature""",
    ),
)
def _(spark, d):
    labels = V.taxonomy(spark, d).select("feature", "family")
    out = T.relative_abundance(skew_join(V.counts(spark, d), labels, ["feature"]), "sample", "feature", "family", "n")
    return out.select(
        "sample",
        "feature",
        "family",
        "n",
        F.round("feature_share", 6).alias("feature_share"),
        F.round("family_share", 6).alias("family_share"),
    )


@query(
    "zscore",
    sql_with(
        "design",
        """
        SELECT sample, feature, round((x - mx) / nullif(sx, 0), 6) AS x_z, round((total - mt) / nullif(st, 0), 6) AS total_z
        FROM design, (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(total) AS mt, stddev_samp(total) AS st FROM design)""",
    ),
)
def _(spark, d):
    out = S.zscore(V.design(spark, d), {"x": "x_z", "total": "total_z"})
    return out.select("sample", "feature", F.round("x_z", 6).alias("x_z"), F.round("total_z", 6).alias("total_z"))


@query(
    "clr",
    sql_with(
        "counts",
        "SELECT sample, feature, round(l - avg(l) OVER (PARTITION BY sample), 6) AS clr FROM "
        "(SELECT sample, feature, ln(greatest(n, 1)) AS l FROM counts)",
    ),
)
def _(spark, d):
    return T.clr(V.counts(spark, d), "sample", "n", "clr").select("sample", "feature", F.round("clr", 6).alias("clr"))


@query(
    "impute_min",
    sql_with(
        "subjects",
        "SELECT subject, coalesce(balance, (SELECT min(balance) FROM subjects)) AS balance FROM subjects",
    ),
)
def _(spark, d):
    return T.impute_min(V.subjects(spark, d).select("subject", "balance"), ["balance"], "balance")


@query(
    "proportion",
    sql_with(
        "design",
        "SELECT sample, feature, round(x / total::DOUBLE, 6) AS share FROM (SELECT DISTINCT sample, feature, x, total FROM design)",
    ),
)
def _(spark, d):
    out = T.proportion(V.design(spark, d), ["sample", "feature"], "x", "total", "share")
    return out.withColumn("share", F.round("share", 6))


@query(
    "exp_scale",
    sql_with(
        "effects",
        "SELECT feature, cohort, round(exp(q25), 6) AS q25, round(exp(q50), 6) AS q50, round(exp(q75), 6) AS q75 FROM effects",
    ),
)
def _(spark, d):
    kept = V.effects(spark, d).select("feature", "cohort", "q25", "q50", "q75")
    scaled = T.exp_scale(kept, ["q25", "q50", "q75"])
    return scaled.select("feature", "cohort", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query(
    "shannon",
    sql_with(
        "counts",
        "SELECT sample, round(-sum(p * ln(p)), 6) AS shannon FROM "
        "(SELECT sample, n / sum(n) OVER (PARTITION BY sample)::DOUBLE AS p FROM counts WHERE n > 0) GROUP BY sample",
    ),
)
def _(spark, d):
    return T.shannon(V.counts(spark, d), "sample", "n").withColumn("shannon", F.round("shannon", 6))


@query(
    "detectable_features",
    sql_with(
        "counts samples",
        """
        WITH c AS (SELECT c.sample, c.feature, CASE WHEN c.n > 40 THEN c.n ELSE 0 END AS n FROM counts c
                   JOIN samples s ON s.sample = c.sample WHERE s.cohort = 'pilot')
        SELECT sample, feature, n FROM c WHERE feature IN (SELECT feature FROM c GROUP BY feature HAVING sum(n) > 0)""",
    ),
)
def _(spark, d):
    pilot = V.samples(spark, d).where(F.col("cohort") == "pilot").select("sample")
    kept = V.counts(spark, d).join(pilot, "sample", "left_semi")
    seen = kept.withColumn("n", F.when(F.col("n") > 40, F.col("n")).otherwise(F.lit(0).cast("long")))
    return T.detectable_features(seen, "feature", "n")


@query(
    "floor_log_fill",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.05 THEN round(log10(l_discount), 6) END AS shade "
    "FROM lineitem",
)
def _(spark, d):
    shade = F.round(T.floor_log(F.col("l_discount"), 0.05), 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shade.alias("shade"))


@query(
    "taxon_rollup",
    sql_with(
        "counts taxonomy",
        "SELECT c.sample, t.genus, CAST(sum(c.n) AS BIGINT) AS n FROM counts c "
        "JOIN taxonomy t ON t.feature = c.feature GROUP BY ALL",
    ),
)
def _(spark, d):
    return T.taxon_rollup(V.counts(spark, d), V.taxonomy(spark, d), "sample", "feature", "n", "genus")
