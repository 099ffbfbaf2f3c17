"""Aggregations and stratified summaries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import summaries as S
from cohortlake.registry import query
from cohortlake.registry.testing import normal_tail_sql, ranksum_sql
from cohortlake.sources import views as V
from cohortlake.sources.views import sql_with, table


@query("count_by", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    return S.count_by(table(spark, d, "part"), ["p_type", "p_brand"])


@query(
    "count_distinct",
    "SELECT count(DISTINCT user_id) FILTER (event_type = 'purchase' AND value > 150) AS big_buyers, "
    "count(DISTINCT user_id) FILTER (event_type = 'error') AS with_error FROM events",
)
def _(spark, d):
    return S.count_distinct_where(
        table(spark, d, "events"),
        "user_id",
        {
            "big_buyers": (F.col("event_type") == "purchase") & (F.col("value") > 150),
            "with_error": F.col("event_type") == "error",
        },
    )


@query(
    "share_of_total",
    "SELECT p_type, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM part), 6) AS share FROM part GROUP BY p_type",
)
def _(spark, d):
    return S.share_of_total(table(spark, d, "part"), ["p_type"]).withColumn("share", F.round("share", 6))


_STATS = ["total", "smallest", "largest", "mean", "sd", "variance", "median", "q10", "q97_5"]


@query(
    "multi_stat_agg",
    """
    SELECT event_type, round(sum(x), 4) AS total, round(min(x), 4) AS smallest, round(max(x), 4) AS largest,
           round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(var_samp(x), 4) AS variance,
           round(median(x), 4) AS median, round(quantile_cont(x, 0.1), 4) AS q10,
           round(quantile_cont(x, 0.975), 4) AS q97_5
    FROM (SELECT event_type, ln(value) AS x FROM events) GROUP BY event_type""",
)
def _(spark, d):
    logged = table(spark, d, "events").select("event_type", F.log("value").alias("x"))
    out = S.multi_stat(logged, ["event_type"], "x", {"median": 0.5, "q10": 0.1, "q97_5": 0.975})
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in _STATS])


@query(
    "var_ranked",
    "SELECT l_suppkey, l_returnflag, round(var_samp(ln(l_extendedprice)), 6) AS spread FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.log("l_extendedprice").alias("x"))
    ranked = S.variance_ranked(rows, ["l_suppkey", "l_returnflag"], "x", "spread")
    return ranked.withColumn("spread", F.round("spread", 6))


@query(
    "top_n_sorted",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return S.top_n(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 100)


@query(
    "sort_rows",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS row FROM orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")]
    return S.sorted_rows(rows, order).select("o_orderkey", "row")


@query(
    "histogram_log10",
    """
    SELECT g.event_type, CAST(b AS INTEGER) AS bin, round((-1 + b * 0.25)::DOUBLE, 6) AS edge, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT event_type FROM events WHERE value > 0) g CROSS JOIN range(-1, 21) r(b) LEFT JOIN (
        SELECT event_type, CAST(greatest(-1, least(20, floor((log10(value) + 1) / 0.25))) AS INTEGER) AS bin, count(*) AS n
        FROM events WHERE value > 0 GROUP BY ALL) c ON c.event_type = g.event_type AND c.bin = b
    WHERE b BETWEEN 0 AND 19 OR n > 0""",
)
def _(spark, d):
    out = S.histogram_log10(table(spark, d, "events"), ["event_type"], "value", -1.0, 0.25, 20)
    return out.withColumn("edge", F.round("edge", 6))


@query(
    "density_grid",
    """
    WITH v AS (SELECT event_type, log10(value) AS x FROM events WHERE value > 0),
    s AS (SELECT event_type, count(*) AS n, min(x) AS lo, (max(x) - min(x)) / 512 AS bin_width,
                 (max(x) - min(x)) / 63 AS step,
                 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34)
                     * pow(count(*), -0.2) AS bw
          FROM v GROUP BY event_type),
    b AS (SELECT v.event_type, least(floor((x - lo) / bin_width), 511) AS bin, count(*) AS c
          FROM v JOIN s ON s.event_type = v.event_type GROUP BY ALL)
    SELECT s.event_type, CAST(i AS INTEGER) AS point, round(lo + i * step, 6) AS x,
           round(sum(c * exp(-pow((lo + i * step - (lo + (bin + 0.5) * bin_width)) / bw, 2) / 2)
                     / (n * bw * sqrt(2 * pi()))), 6) AS density
    FROM s JOIN b ON b.event_type = s.event_type CROSS JOIN range(64) r(i)
    GROUP BY s.event_type, i, lo, step""",
)
def _(spark, d):
    logged = table(spark, d, "events").where(F.col("value") > 0).select("event_type", F.log10("value").alias("v"))
    out = S.density_grid(logged, ["event_type"], "v", 64, 512)
    return out.select("event_type", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query(
    "specimen_inventory",
    sql_with(
        "paired subjects",
        "SELECT kind, count(*) AS specimens, count(DISTINCT subject) AS subjects FROM paired "
        "WHERE subject IN (SELECT subject FROM subjects WHERE stratum) GROUP BY kind",
    ),
)
def _(spark, d):
    from cohortlake.operators.frames import member_filter

    included = V.subjects(spark, d).where("stratum")
    specimens = member_filter(V.paired(spark, d), included, ["subject"]).select("subject", "day", "kind").distinct()
    per_subject = specimens.groupBy("kind", "subject").agg(F.count(F.lit(1)).alias("k"))
    return per_subject.groupBy("kind").agg(F.sum("k").alias("specimens"), F.count(F.lit(1)).alias("subjects"))


_CONTINUOUS = ["n_orders", "spend", "balance"]
_CATEGORICAL = ["last_status", "segment"]


def summary_sql(continuous, categorical) -> str:
    """Every variable overall and by stratum, with its test: normal law by the error function's series, chi-square of even degrees by its finite sum."""
    numbers = " UNION ALL ".join(f"SELECT '{c}' AS variable, stratum, all_rows, CAST({c} AS DOUBLE) AS v FROM both_strata" for c in continuous)
    levels = " UNION ALL ".join(f"SELECT '{c}' AS variable, stratum, all_rows, CAST({c} AS VARCHAR) AS level FROM both_strata" for c in categorical)
    return f"""
    WITH both_strata AS (
        SELECT * EXCLUDE (stratum), CAST(stratum AS VARCHAR) AS stratum, FALSE AS all_rows FROM subjects
        UNION ALL SELECT * EXCLUDE (stratum), 'overall', TRUE FROM subjects),
    num AS ({numbers}), cat AS ({levels}),
    long AS (SELECT variable, stratum = 'true' AS grp, v FROM num WHERE NOT all_rows),
    {ranksum_sql("long", "grp")},
    p_num AS (SELECT variable, {normal_tail_sql('z')} AS p FROM ranksum),
    cell AS (SELECT variable, stratum, level, count(*)::DOUBLE AS n FROM cat WHERE NOT all_rows AND level IS NOT NULL GROUP BY ALL),
    chi AS (SELECT variable, sum(n) AS total, any_value(k) AS k, any_value(r) AS r, sum(n * n / (row_n * col_n)) AS s FROM (
        SELECT *, sum(n) OVER (PARTITION BY variable, stratum) AS row_n, sum(n) OVER (PARTITION BY variable, level) AS col_n,
               (SELECT count(DISTINCT level) FROM cell c WHERE c.variable = cell.variable) AS k,
               (SELECT count(DISTINCT stratum) FROM cell c WHERE c.variable = cell.variable) AS r FROM cell) GROUP BY variable),
    p_cat AS (SELECT variable, exp(-x / 2) * list_sum(list_transform(range(dof // 2), lambda i: pow(x / 2, i) / gamma(i + 1))) AS p
              FROM (SELECT variable, total * (s - 1) AS x, CAST((k - 1) * (r - 1) AS BIGINT) AS dof FROM chi)),
    sized AS (SELECT variable, stratum, all_rows, count(level) AS whole, count(*) - count(level) AS n_missing FROM cat GROUP BY ALL),
    l AS (SELECT variable, stratum, all_rows, level, count(*) AS n FROM cat WHERE level IS NOT NULL GROUP BY ALL)
    SELECT num.variable, all_rows AS is_overall, stratum, CAST(NULL AS VARCHAR) AS level, count(v) AS n, count(*) - count(v) AS n_missing,
           round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3,
           CAST(NULL AS DOUBLE) AS percent, round(any_value(p), 6) AS p_value
    FROM num LEFT JOIN p_num ON p_num.variable = num.variable GROUP BY num.variable, stratum, all_rows
    UNION ALL
    SELECT z.variable, z.all_rows, z.stratum, level, coalesce(n, 0), n_missing, NULL, NULL, NULL, round(n * 100.0::DOUBLE / whole, 6), round(p, 6)
    FROM sized z LEFT JOIN l ON l.variable = z.variable AND l.stratum = z.stratum AND l.all_rows = z.all_rows
    LEFT JOIN p_cat ON p_cat.variable = z.variable"""


@query("summary_by_stratum", sql_with("subjects", summary_sql(_CONTINUOUS, _CATEGORICAL)))
def _(spark, d):
    out = S.summary_by_stratum(V.subjects(spark, d), "stratum", _CONTINUOUS, _CATEGORICAL)
    rounded = ("median", "q1", "q3", "percent", "p_value")
    return out.select("variable", "is_overall", "stratum", "level", "n", "n_missing", *[F.round(c, 6).alias(c) for c in rounded])
