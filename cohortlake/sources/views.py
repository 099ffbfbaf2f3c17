"""Stand-in views: the driver tables seen as counts, subjects, trees and draws.

Each view exists twice, as a DataFrame here and as SQL text in ``VIEW_SQL`` for
the checking side, under the same name and with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.ranks import exact_quantiles, with_position
from cohortlake.session import cut_lineage

FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"))
        .agg(F.sum("l_quantity").cast("long").alias("n"))
    )


def counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature"))
        .agg(F.sum("l_quantity").cast("long").alias("n"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("sample"),
            F.when(F.col("s_suppkey") % 5 == 0, "pilot").otherwise("validation").alias("cohort"),
            (F.col("s_acctbal") > 4500).alias("exposed"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
        )
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("feature"),
        F.concat("p_type", F.lit("/"), "p_brand").alias("genus"),
        F.col("p_type").alias("family"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    family, genus = F.col("p_type"), F.concat("p_type", F.lit("/"), "p_brand")
    none = F.lit(None).cast("string")
    no_tip = F.lit(None).cast("long")
    tips = part.select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("node"),
        genus.alias("parent"),
        (F.lit(0.01) + (F.col("p_partkey") % 97) / 1000.0).alias("length"),
        F.col("p_partkey").alias("tip"),
    )
    genera = part.select(genus.alias("node"), family.alias("parent"), F.lit(0.2).alias("length"), no_tip.alias("tip"))
    families = part.select(
        family.alias("node"), F.lit("root").alias("parent"), F.lit(0.5).alias("length"), no_tip.alias("tip")
    )
    root = spark.range(0, 1, 1, 1).select(
        F.lit("root").alias("node"), none.alias("parent"), F.lit(0.0).alias("length"), no_tip.alias("tip")
    )
    return tips.union(genera.distinct()).union(families.distinct()).union(root)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("o_totalprice").alias("spend"),
            F.max_by("o_orderstatus", "o_orderkey").alias("last_status"),
            F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("stratum"),
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("subject"),
            F.coalesce("stratum", F.lit(False)).alias("stratum"),
            F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
            F.round("spend", 2).alias("spend"),
            F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("balance"),
            F.coalesce("last_status", F.lit("none")).alias("last_status"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def _day() -> F.Column:
    return F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date")).alias("day")


def _k() -> F.Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("click", "purchase"))
        .groupBy(F.col("user_id").alias("subject"), _day(), F.col("event_type").alias("kind"))
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("subject"), _day())
        .agg(F.max("value").alias("peak"), F.bool_or(F.col("event_type") == "error").alias("hit"))
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("param"),
        (F.col("event_id") % 4).cast("int").alias("chain"),
        "event_id",
        (F.log("value") - 3.0).alias("draw"),
    )
    placed = with_position(rows, ["param", "chain"], [F.col("event_id")], "iter")
    # Stands for a stored table, which its readers go over several times.
    return cut_lineage(placed.select("param", "chain", "iter", "draw"))


# Slopes' offsets per feature (fixed values).
SLOPE_OFFSETS = {"click": 0.1, "view": 0.2, "purchase": -0.1, "signup": -0.2, "error": 0.0}


def joint_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of all parameters of a model at once: a slope per event type, intercept, total, fixed slope, sigma."""
    level = F.log("value") - 3.0
    event = F.col("event_id")
    values = {
        **{name: level / 4.0 + offset for name, offset in SLOPE_OFFSETS.items()},
        "alpha": level / 2.0 - 0.2,
        "b_total": (F.col("user_id") % 10) / 20.0,
        "b_third": (event % 7 - 3) / 10.0,
        "sigma": 1.0 + (event % 5) / 10.0,
    }
    rows = F.array(*[F.struct(F.lit(name).alias("param"), v.alias("draw")) for name, v in values.items()])
    return table(spark, sf_dir, "events").select(
        (event % 4).cast("int").alias("chain"), (F.floor(event / 4) + 1).cast("long").alias("iter"), F.inline(rows)
    )


def sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 4).cast("int").alias("chain"),
        (F.floor(F.col("event_id") / 4) + 1).cast("long").alias("iter"),
        (_k() > 97).cast("int").alias("divergent"),
        F.least(F.lit(10), F.floor(_k() / 10) + 1).cast("int").alias("treedepth"),
        F.col("value").alias("energy"),
    )


# Quantile columns of a draws summary (fixed values).
QUANTILES = {
    "q2_5": 0.025,
    "q5": 0.05,
    "q10": 0.1,
    "q20": 0.2,
    "q25": 0.25,
    "q40": 0.4,
    "q50": 0.5,
    "q60": 0.6,
    "q75": 0.75,
    "q80": 0.8,
    "q90": 0.9,
    "q95": 0.95,
    "q97_5": 0.975,
}


def effect_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws per (feature, cohort), shifted by feature so that some are certain."""
    step = F.floor(_k() / 10)
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("_"), step.cast("string")).alias("feature"),
        F.col("event_type").alias("genus"),
        F.element_at(
            F.array(F.lit("Pilot"), F.lit("Validation"), F.lit("Pooled")), (F.col("user_id") % 3 + 1).cast("int")
        ).alias("cohort"),
        ((F.log("value") - 3.0) / 4.0 + (step - 5) * 0.25).alias("draw"),
    )


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(effect_draws(spark, sf_dir), ["feature", "genus", "cohort"], "draw", QUANTILES)


# Features of ``counts_dense`` that enter as fixed columns (fixed values).
FIXED_FEATURES = {"Brand#1": "fix_1", "Brand#2": "fix_2", "Brand#3": "fix_3"}


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = counts_dense(spark, sf_dir)
    per_sample = dense.groupBy("sample").agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("n"))), F.lit(0)).alias(c) for f, c in FIXED_FEATURES.items()],
    )
    outcome = samples(spark, sf_dir).select("sample", "cohort", F.col("exposed").cast("int").alias("y"))
    return (
        dense.where(~F.col("feature").isin(*FIXED_FEATURES))
        .join(per_sample, "sample")
        .join(outcome, "sample")
        .select("sample", "cohort", "feature", F.col("n").alias("x"), "total", "y", *FIXED_FEATURES.values())
    )


def coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slope per feature from its digits."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("double")
    return (
        table(spark, sf_dir, "part")
        .select("p_brand")
        .distinct()
        .select(F.col("p_brand").alias("term"), (number / 25.0 - 0.5).alias("value"))
    )


def hs_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of scale-mixture draws: one row per (chain, iter, kind, feature)."""
    kinds = {"click": "beta", "view": "lambda", "purchase": "tau", "signup": "c2", "error": "c2"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("event_id") % 4).cast("int").alias("chain"),
            F.floor(F.col("event_id") / 400).cast("long").alias("iter"),
            (F.col("user_id") % 3).cast("int").alias("feature"),
            kind[F.col("event_type")].alias("kind"),
        )
        .agg(F.avg(F.log("value")).alias("level"))
        .select(
            "chain",
            "iter",
            "feature",
            "kind",
            F.when(F.col("kind") == "beta", F.col("level") - 3.0).otherwise(F.exp(F.col("level") / 4.0)).alias("draw"),
        )
    )


_DAY = f"CAST(CAST(ts AS DATE) - DATE '{FIRST_DAY}' AS INTEGER)"
_K = r"CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)"

VIEW_SQL = {
    "counts": """
        SELECT l_suppkey AS sample, l_partkey AS feature, CAST(sum(l_quantity) AS BIGINT) AS n
        FROM lineitem GROUP BY ALL""",
    "counts_dense": """
        SELECT l_suppkey AS sample, p_brand AS feature, CAST(sum(l_quantity) AS BIGINT) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "samples": """
        SELECT s_suppkey AS sample,
               CASE WHEN s_suppkey % 5 = 0 THEN 'pilot' ELSE 'validation' END AS cohort,
               s_acctbal > 4500 AS exposed, n_name AS nation, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "taxonomy": """
        SELECT p_partkey AS feature, p_type || '/' || p_brand AS genus, p_type AS family FROM part""",
    "tree": """
        SELECT 't' || p_partkey AS node, p_type || '/' || p_brand AS parent,
               CAST(0.01 AS DOUBLE) + (p_partkey % 97) / CAST(1000 AS DOUBLE) AS length, p_partkey AS tip FROM part
        UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_type, CAST(0.2 AS DOUBLE), CAST(NULL AS BIGINT) FROM part
        UNION ALL SELECT DISTINCT p_type, 'root', CAST(0.5 AS DOUBLE), CAST(NULL AS BIGINT) FROM part
        UNION ALL SELECT 'root', CAST(NULL AS VARCHAR), CAST(0 AS DOUBLE), CAST(NULL AS BIGINT)""",
    "subjects": """
        SELECT c_custkey AS subject, coalesce(stratum, FALSE) AS stratum,
               CAST(coalesce(k, 0) AS DOUBLE) AS n_orders, round(s, 2) AS spend,
               CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS balance,
               coalesce(last_status, 'none') AS last_status, c_mktsegment AS segment
        FROM customer LEFT JOIN (
            SELECT o_custkey, count(*) AS k, sum(o_totalprice) AS s,
                   arg_max(o_orderstatus, o_orderkey) AS last_status,
                   bool_or(o_orderpriority = '1-URGENT') AS stratum
            FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "paired": f"""
        SELECT user_id AS subject, {_DAY} AS day, event_type AS kind, round(sum(value), 2) AS value
        FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL""",
    "visits": f"""
        SELECT user_id AS subject, {_DAY} AS day, max(value) AS peak, bool_or(event_type = 'error') AS hit
        FROM events GROUP BY ALL""",
    "draws": """
        SELECT event_type AS param, CAST(event_id % 4 AS INTEGER) AS chain,
               row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id) AS iter,
               ln(value) - 3.0 AS draw
        FROM events""",
    "joint_draws": """
        SELECT param, CAST(event_id % 4 AS INTEGER) AS chain, event_id // 4 + 1 AS iter, draw FROM (
            SELECT event_id, unnest([{slopes}, 'alpha', 'b_total', 'b_third', 'sigma']) AS param,
                   unnest([{offsets}, (ln(value) - 3.0) / 2.0::DOUBLE - 0.2,
                           (user_id % 10) / 20.0::DOUBLE, (event_id % 7 - 3) / 10.0::DOUBLE,
                           1.0::DOUBLE + (event_id % 5) / 10.0::DOUBLE]) AS draw
            FROM events)""".format(
        slopes=", ".join(f"'{name}'" for name in SLOPE_OFFSETS),
        offsets=", ".join(f"(ln(value) - 3.0) / 4.0::DOUBLE + {offset}" for offset in SLOPE_OFFSETS.values()),
    ),
    "sampler": f"""
        SELECT CAST(event_id % 4 AS INTEGER) AS chain, event_id // 4 + 1 AS iter,
               CAST({_K} > 97 AS INTEGER) AS divergent,
               CAST(least(10, {_K} // 10 + 1) AS INTEGER) AS treedepth, value AS energy
        FROM events""",
    "effect_draws": f"""
        SELECT event_type || '_' || ({_K} // 10) AS feature, event_type AS genus,
               CASE user_id % 3 WHEN 0 THEN 'Pilot' WHEN 1 THEN 'Validation' ELSE 'Pooled' END AS cohort,
               (ln(value) - 3.0) / 4.0 + ({_K} // 10 - 5) * 0.25 AS draw
        FROM events""",
    "effects": """
        SELECT feature, genus, cohort, """
    + ", ".join(f"quantile_cont(draw, {p}) AS {name}" for name, p in QUANTILES.items())
    + """
        FROM effect_draws GROUP BY ALL""",
    "design": """
        SELECT d.sample, cohort, d.feature, d.n AS x, total, CAST(exposed AS INTEGER) AS y, fix_1, fix_2, fix_3
        FROM counts_dense d
        JOIN (SELECT sample, CAST(sum(n) AS BIGINT) AS total,
                     coalesce(max(n) FILTER (feature = 'Brand#1'), 0) AS fix_1,
                     coalesce(max(n) FILTER (feature = 'Brand#2'), 0) AS fix_2,
                     coalesce(max(n) FILTER (feature = 'Brand#3'), 0) AS fix_3
              FROM counts_dense GROUP BY sample) p ON p.sample = d.sample
        JOIN samples s ON s.sample = d.sample
        WHERE d.feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3')""",
    "coefs": r"""
        SELECT DISTINCT p_brand AS term,
               CAST(regexp_extract(p_brand, '(\d+)', 1) AS DOUBLE) / 25.0 - 0.5 AS value
        FROM part""",
    "hs_draws": """
        SELECT chain, iter, feature, kind,
               CASE WHEN kind = 'beta' THEN level - 3.0 ELSE exp(level / 4.0) END AS draw
        FROM (SELECT CAST(event_id % 4 AS INTEGER) AS chain, event_id // 400 AS iter,
                     CAST(user_id % 3 AS INTEGER) AS feature,
                     CASE event_type WHEN 'click' THEN 'beta' WHEN 'view' THEN 'lambda'
                                     WHEN 'purchase' THEN 'tau' ELSE 'c2' END AS kind,
                     avg(ln(value)) AS level
              FROM events GROUP BY ALL)""",
}

_NEEDS = {"effects": ["effect_draws"], "design": ["counts_dense", "samples"]}


def sql_with(views: str, body: str) -> str:
    """Prefix a query with the named views (and those they need) as CTEs."""
    ordered: list[str] = []
    for name in views.split():
        for wanted in [*_NEEDS.get(name, []), name]:
            if wanted not in ordered:
                ordered.append(wanted)
    text = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {text},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {text},\n{body[len('WITH '):]}"
    return f"WITH {text}\n{body}"
