"""Projections, filters, joins, reshapes and labels over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import labels as L
from cohortlake.operators import frames as O
from cohortlake.operators import groups as G
from cohortlake.operators.skew import keep_groups, skew_join
from cohortlake.plans.eligibility import exclusion_flow
from cohortlake.registry import query
from cohortlake.sources import views as V
from cohortlake.sources.views import sql_with, table

# --- B: projections, filters, predicates ---------------------------------------------------


@query(
    "select_pattern",
    "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
def _(spark, d):
    return O.select_matching(
        table(spark, d, "orders"), ["o_custkey"], ["order"], drop=["o_orderdate"], everything=False
    )


@query(
    "filter_regex",
    "SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(lower(p_name), 'ring|bolt') "
    "AND NOT regexp_matches(p_type, '^S')",
)
def _(spark, d):
    part = table(spark, d, "part")
    return part.where(L.matches("p_name", "RING|BOLT", ignore_case=True) & ~L.matches("p_type", "^S")).select(
        "p_partkey", "p_name", "p_type"
    )


@query(
    "member_filter",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN "
    "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)",
)
def _(spark, d):
    keys = (
        table(spark, d, "orders")
        .where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
        .select(F.col("o_custkey").alias("c_custkey"))
    )
    return O.member_filter(table(spark, d, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query(
    "nonmember_filter",
    sql_with(
        "subjects",
        "SELECT s.subject, s.balance FROM subjects s "
        "WHERE NOT EXISTS (SELECT 1 FROM subjects t WHERE t.balance > 0 AND t.balance = s.balance)",
    ),
)
def _(spark, d):
    subjects = V.subjects(spark, d)
    positive = subjects.where(F.col("balance") > 0)
    return O.nonmember_filter(subjects, positive, ["balance"]).select("subject", "balance")


@query(
    "case_relabel",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' "
    "WHEN o_totalprice > 400000 THEN 'large' ELSE o_orderpriority END AS label FROM orders",
)
def _(spark, d):
    label = (
        F.when(F.col("o_orderstatus") == "F", "finished")
        .when(F.col("o_orderpriority") == "1-URGENT", "urgent")
        .when(F.col("o_totalprice") > 400000, "large")
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query(
    "rename_pattern",
    "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier",
)
def _(spark, d):
    return O.rename_matching(table(spark, d, "supplier"), "^s_", "")


@query("distinct_rows", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _(spark, d):
    return O.distinct_rows(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("drop_missing", sql_with("subjects", "SELECT * FROM subjects WHERE balance IS NOT NULL AND spend IS NOT NULL"))
def _(spark, d):
    return O.drop_missing(V.subjects(spark, d), ["balance", "spend"])


@query(
    "mutate_across",
    "SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, round(c_acctbal / 1000, 5) AS c_acctbal, "
    "upper(c_mktsegment) AS c_mktsegment FROM customer",
)
def _(spark, d):
    scaled = O.mutate_across(table(spark, d, "customer"), lambda c: F.round(c / 1000, 5), containing=["acct"])
    return O.mutate_across(scaled, F.upper, types=["string"])


@query(
    "filter_group_agg",
    "SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey IN "
    "(SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 30 * count(*))",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return keep_groups(rows, ["l_partkey"], F.sum("l_quantity") > 30 * F.count(F.lit(1)))


@query(
    "positive_log",
    "SELECT c_custkey, round(ln(c_acctbal), 6) AS log_balance FROM customer WHERE c_acctbal > 0",
)
def _(spark, d):
    logged = O.positive_log(table(spark, d, "customer"), {"c_acctbal": "log_balance"})
    return logged.select("c_custkey", F.round("log_balance", 6).alias("log_balance"))


@query(
    "exclusion_flow",
    sql_with(
        "subjects",
        """
        SELECT segment, count(*) AS candidates,
               count(*) FILTER (last_status = 'F') AS excluded_prior,
               count(*) FILTER (balance IS NULL OR n_orders < 5) AS excluded_no_sample,
               count(*) FILTER (NOT (last_status = 'F') AND NOT (balance IS NULL OR n_orders < 5)) AS included
        FROM subjects GROUP BY segment""",
    ),
)
def _(spark, d):
    return exclusion_flow(
        V.subjects(spark, d),
        "subject",
        ["segment"],
        {
            "excluded_prior": F.col("last_status") == "F",
            "excluded_no_sample": F.col("balance").isNull() | (F.col("n_orders") < 5),
        },
    )


# --- C: joins ------------------------------------------------------------------------------


@query(
    "join_dictionary",
    sql_with(
        "counts taxonomy",
        "SELECT c.sample, c.feature, c.n, t.genus, t.family FROM counts c LEFT JOIN taxonomy t ON t.feature = c.feature",
    ),
)
def _(spark, d):
    return O.join_dictionary(V.counts(spark, d), V.taxonomy(spark, d), ["feature"])


@query(
    "join_right_keep",
    "SELECT o_custkey, o_orderkey, c_mktsegment FROM (SELECT * FROM customer WHERE c_acctbal > 0) "
    "RIGHT JOIN orders ON c_custkey = o_custkey",
)
def _(spark, d):
    attributes = (
        table(spark, d, "customer")
        .where(F.col("c_acctbal") > 0)
        .select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    )
    facts = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return O.join_right_keep(attributes, facts, ["o_custkey"])


@query(
    "join_composite",
    sql_with(
        "paired visits",
        "SELECT p.subject, p.day, p.kind, p.value, v.peak FROM paired p "
        "LEFT JOIN visits v ON v.subject = p.subject AND v.day = p.day AND v.peak = p.value",
    ),
)
def _(spark, d):
    peaks = V.visits(spark, d).select("subject", "day", F.col("peak").alias("value"), "peak")
    return skew_join(V.paired(spark, d), peaks, ["subject", "day", "value"], "left")


@query(
    "lookup_map",
    "SELECT event_id, 'V' || (user_id % 5) AS code, r_name AS label FROM events "
    "LEFT JOIN region ON r_regionkey = user_id % 5",
)
def _(spark, d):
    names = table(spark, d, "region").select(
        F.concat(F.lit("V"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("label")
    )
    coded = table(spark, d, "events").select(
        "event_id", F.concat(F.lit("V"), (F.col("user_id") % 5).cast("string")).alias("code")
    )
    return skew_join(coded, names, ["code"], "left")


@query(
    "cross_grid",
    "SELECT DISTINCT s.s_suppkey AS sample, p.p_brand AS feature FROM supplier s, (SELECT DISTINCT p_brand FROM part) p",
)
def _(spark, d):
    return O.key_grid(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")),
        table(spark, d, "part").select(F.col("p_brand").alias("feature")),
    )


# --- E: windows and group tests ------------------------------------------------------------


@query(
    "event_near_flag",
    sql_with(
        "visits",
        """
        SELECT subject, day, peak, hit,
               hit AND (fever OR coalesce(lag(fever, 1) OVER w, FALSE) OR coalesce(lag(fever, 2) OVER w, FALSE)
                        OR coalesce(lead(fever, 1) OVER w, FALSE) OR coalesce(lead(fever, 2) OVER w, FALSE)) AS near
        FROM (SELECT *, peak > 100 AS fever FROM visits) WINDOW w AS (PARTITION BY subject ORDER BY day)""",
    ),
)
def _(spark, d):
    return G.event_near_flag(V.visits(spark, d), "subject", "day", F.col("hit"), F.col("peak") > 100, 2, "near")


@query(
    "baseline_broadcast",
    sql_with(
        "visits",
        """
        SELECT v.subject, v.day, b.base, b.base > 0 AS detect, b.base > 50 AS dominant
        FROM visits v JOIN (SELECT subject, max(CASE WHEN day = 0 THEN peak END) AS base
                            FROM visits GROUP BY subject) b ON b.subject = v.subject""",
    ),
)
def _(spark, d):
    return G.baseline_broadcast(
        V.visits(spark, d).select("subject", "day", "peak"), "subject", F.col("day") == 0, F.col("peak"), "base", 50
    ).drop("peak")


@query(
    "running_breaks",
    sql_with(
        "visits",
        """
        SELECT cohort, subject, CAST(through AS DOUBLE) + 0.5 AS linebreak FROM (
            SELECT cohort, subject, sum(k) OVER (PARTITION BY cohort ORDER BY subject) AS through,
                   sum(k) OVER (PARTITION BY cohort) AS all_rows
            FROM (SELECT subject % 2 AS cohort, subject, count(*) AS k FROM visits GROUP BY ALL))
        WHERE through < all_rows""",
    ),
)
def _(spark, d):
    visits = V.visits(spark, d).select((F.col("subject") % 2).alias("cohort"), "subject", "day")
    return G.running_breaks(visits, "cohort", "subject")


@query(
    "sequence_in_group",
    """
    SELECT event_type, event_id, rn AS iter, CAST((rn - 1) // 500 + 1 AS BIGINT) AS chunk FROM (
        SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn
        FROM events)""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    placed = G.sequence_in_group(rows, ["event_type"], [F.col("value"), F.col("event_id")], "iter", 500)
    return placed.drop("value")


@query(
    "complete_pairs_filter",
    sql_with(
        "paired",
        """
        SELECT subject, day, kind, value FROM paired WHERE (subject, day) IN (
            SELECT (subject, day) FROM paired GROUP BY subject, day
            HAVING string_agg(kind, ' ' ORDER BY kind) = 'click purchase')""",
    ),
)
def _(spark, d):
    return G.exact_kinds(V.paired(spark, d), ["subject", "day"], "kind", ["click", "purchase"])


@query(
    "group_has_any",
    """
    SELECT event_id, user_id, any_big FROM events JOIN (
        SELECT user_id AS u, bool_or(event_type = 'purchase' AND value > 200) AS any_big FROM events GROUP BY u)
    ON u = user_id""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    big = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    return G.group_has_any(rows, ["user_id"], big, "any_big").select("event_id", "user_id", "any_big")


@query(
    "any_replicate_hit",
    sql_with(
        "effects",
        """
        SELECT feature, cohort, round(q50, 6) AS q50 FROM effects WHERE feature IN (
            SELECT feature FROM effects GROUP BY feature HAVING bool_or(q25 > 0 OR q75 < 0))""",
    ),
)
def _(spark, d):
    effects = V.effects(spark, d).select("feature", "cohort", F.round("q50", 6).alias("q50"), "q25", "q75")
    return G.any_replicate_hit(effects, ["feature"], (F.col("q25") > 0) | (F.col("q75") < 0)).drop("q25", "q75")


@query(
    "quantile_broadcast",
    """
    SELECT event_id, event_type, xpos, ypos FROM events JOIN (
        SELECT event_type AS t, round(quantile_cont(value, 0.2), 6) AS xpos, round(quantile_cont(value, 0.8), 6) AS ypos
        FROM events GROUP BY t) ON t = event_type""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    out = G.quantile_broadcast(rows, ["event_type"], "value", {"xpos": 0.2, "ypos": 0.8})
    return out.select("event_id", "event_type", F.round("xpos", 6).alias("xpos"), F.round("ypos", 6).alias("ypos"))


@query(
    "first_distinct_index",
    "SELECT l_partkey AS feature, row_number() OVER (ORDER BY l_partkey) AS feature_num "
    "FROM (SELECT DISTINCT l_partkey FROM lineitem)",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"))
    return G.first_distinct_index(rows, "feature", "feature_num")


# --- F: reshape ----------------------------------------------------------------------------


@query(
    "pivot_kinds",
    sql_with(
        "paired",
        "SELECT subject, day, max(value) FILTER (kind = 'click') AS click, "
        "max(value) FILTER (kind = 'purchase') AS purchase FROM paired GROUP BY subject, day",
    ),
)
def _(spark, d):
    return O.pivot_kinds(V.paired(spark, d), ["subject", "day"], "kind", "value", ["click", "purchase"])


@query(
    "feature_columns",
    sql_with(
        "counts_dense",
        """
        SELECT c.sample, c.feature, c.n, coalesce(fix_1, 0) AS fix_1, coalesce(fix_2, 0) AS fix_2,
               coalesce(fix_3, 0) AS fix_3
        FROM counts_dense c LEFT JOIN (
            SELECT sample, max(n) FILTER (feature = 'Brand#1') AS fix_1, max(n) FILTER (feature = 'Brand#2') AS fix_2,
                   max(n) FILTER (feature = 'Brand#3') AS fix_3
            FROM counts_dense WHERE feature IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY sample) w
        ON w.sample = c.sample WHERE c.feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3')""",
    ),
)
def _(spark, d):
    return O.feature_columns(
        V.counts_dense(spark, d), ["sample"], "feature", "n", V.FIXED_FEATURES, F.lit(0).cast("long")
    )


@query(
    "presence_matrix",
    sql_with(
        "counts",
        "SELECT sample, feature, CAST(n > 60 AS INTEGER) AS present FROM counts "
        "WHERE feature IN (SELECT feature FROM counts WHERE n > 60)",
    ),
)
def _(spark, d):
    return O.presence_rows(V.counts(spark, d), "feature", "n", 60).select("sample", "feature", "present")


@query(
    "unpivot_long",
    """
    SELECT l_orderkey, l_partkey, 'l_tax' AS measure, l_tax AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, 'l_discount', l_discount FROM lineitem""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    return O.unpivot_long(rows, ["l_orderkey", "l_partkey"], ["l_tax", "l_discount"], "measure", "amount")


@query(
    "complete_grid",
    sql_with(
        "counts taxonomy",
        """
        WITH g AS (SELECT c.sample, t.genus, CAST(sum(c.n) AS BIGINT) AS n FROM counts c
                   JOIN taxonomy t ON t.feature = c.feature GROUP BY ALL)
        SELECT s.sample, k.genus, coalesce(g.n, 0) AS n
        FROM (SELECT DISTINCT sample FROM g) s, (SELECT DISTINCT genus FROM g) k
        LEFT JOIN g ON g.sample = s.sample AND g.genus = k.genus""",
    ),
)
def _(spark, d):
    genera = (
        V.counts(spark, d)
        .join(V.taxonomy(spark, d), "feature")
        .groupBy("sample", "genus")
        .agg(F.sum("n").alias("n"))
    )
    return O.complete_grid(genera, ["sample"], ["genus"], "n", 0)


@query(
    "nest_apply",
    "SELECT event_id, user_id, round(ln(value) - m, 6) AS centered FROM events JOIN "
    "(SELECT user_id AS u, avg(ln(value)) AS m FROM events GROUP BY u) ON u = user_id",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    out = G.center_in_group(rows, ["user_id"], F.log("value"), "centered")
    return out.select("event_id", "user_id", F.round("centered", 6).alias("centered"))


@query(
    "value_grid",
    "SELECT CAST(i AS INTEGER) AS point, round(lo + i * (hi - lo) / 99, 6) AS x FROM "
    "(SELECT min(value) AS lo, max(value) AS hi FROM events), range(100) r(i)",
)
def _(spark, d):
    grid = O.value_grid(table(spark, d, "events"), "value", 100, "x")
    return grid.select("point", F.round("x", 6).alias("x"))


@query(
    "model_index",
    sql_with(
        "counts_dense",
        "SELECT sample, feature, CAST(dense_rank() OVER (ORDER BY feature) AS BIGINT) AS feature_num, "
        "(SELECT count(*) FROM counts_dense) AS n, (SELECT count(DISTINCT feature) FROM counts_dense) AS n_feature "
        "FROM counts_dense",
    ),
)
def _(spark, d):
    return G.model_index(V.counts_dense(spark, d).select("sample", "feature"), "feature", "feature_num")


# --- G: labels -----------------------------------------------------------------------------


@query(
    "label_compose",
    sql_with(
        "subjects",
        "SELECT subject, segment || ' ' || coalesce(CAST(balance > 0 AS VARCHAR), 'NA') || ' (' || last_status || ')' "
        "AS label FROM subjects",
    ),
)
def _(spark, d):
    label = L.compose("segment", F.lit(" "), F.col("balance") > 0, F.lit(" ("), "last_status", F.lit(")"))
    return V.subjects(spark, d).select("subject", label.alias("label"))


@query(
    "extract_species",
    "SELECT p_partkey, 'Part ' || coalesce(nullif(regexp_extract(p_name, 'ring|bolt|widget', 0), ''), "
    "'- kind unresolved') AS label FROM part",
)
def _(spark, d):
    kind = L.extract_first("p_name", "ring|bolt|widget", "- kind unresolved")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("Part "), kind).alias("label"))


@query(
    "extract_cohort",
    sql_with(
        "samples",
        "SELECT sample, nullif(regexp_extract(cohort || '_' || sample, 'pilot|validation', 0), '') AS cohort FROM samples",
    ),
)
def _(spark, d):
    identity = F.concat("cohort", F.lit("_"), F.col("sample").cast("string"))
    return V.samples(spark, d).select("sample", L.extract_first(identity, "pilot|validation").alias("cohort"))


@query(
    "pad_label",
    "SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 2 THEN CAST(s_suppkey AS VARCHAR) "
    "ELSE lpad(CAST(s_suppkey AS VARCHAR), 2, '0') END AS label FROM supplier",
)
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", L.pad_left("s_suppkey", 2).alias("label"))


@query(
    "clean_label",
    "SELECT p_partkey, regexp_replace(p_name, ' ring| bolt|^small ', '', 'g') AS label FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", L.strip_patterns("p_name", [" ring", " bolt", "^small "]).alias("label"))


@query(
    "parse_number",
    r"SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '-?\d+(\.\d+)?', 0), '') AS DOUBLE) AS num FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", L.first_number("p_brand").alias("num"))


def _signif_sql(x: str, digits: int) -> str:
    p = f"pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round({x} * {p}) / {p} END"


def _text_sql(x: str) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(30,10)) AS VARCHAR), '\.?0+$', '')"


@query(
    "interval_label",
    sql_with(
        "effects",
        "SELECT feature, cohort, "
        + " || ".join(
            [
                _text_sql(_signif_sql("exp(q50)", 2)),
                "' ('",
                _text_sql(_signif_sql("exp(q25)", 2)),
                "' - '",
                _text_sql(_signif_sql("exp(q75)", 2)),
                "')'",
            ]
        )
        + " AS label FROM effects",
    ),
)
def _(spark, d):
    label = L.interval_label(F.exp("q50"), F.exp("q25"), F.exp("q75"), 2)
    return V.effects(spark, d).select("feature", "cohort", label.alias("label"))


@query(
    "axis_label",
    "SELECT event_type, 'PCoA Axis.' || length(event_type) || ' (' || "
    + _text_sql("round(count(*) / (SELECT count(*)::DOUBLE FROM events), 3) * 100")
    + " || '% variance)' AS label FROM events GROUP BY event_type",
)
def _(spark, d):
    events = table(spark, d, "events")
    sizes = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / events.agg(F.count(F.lit(1)).alias("t")).scalar()
    axis = F.concat(F.lit("Axis."), F.length("event_type").cast("string"))
    return sizes.select("event_type", L.axis_label(axis, share).alias("label"))


@query(
    "hit_category",
    sql_with(
        "effects",
        "SELECT feature, cohort, CASE WHEN q5 > 0 OR q95 < 0 THEN '< 0.05' WHEN q10 > 0 OR q90 < 0 THEN '< 0.1' "
        "WHEN q25 > 0 OR q75 < 0 THEN '< 0.25' ELSE '>= 0.25' END AS certainty FROM effects",
    ),
)
def _(spark, d):
    def apart(low, high):
        return (F.col(low) > 0) | (F.col(high) < 0)

    certainty = L.certainty_class(apart("q5", "q95"), apart("q10", "q90"), apart("q25", "q75"))
    return V.effects(spark, d).select("feature", "cohort", certainty.alias("certainty"))


@query(
    "bool_to_num",
    sql_with("samples", "SELECT sample, CAST(exposed AS INTEGER) AS exposed FROM samples"),
)
def _(spark, d):
    flags = V.samples(spark, d).select("sample", "exposed")
    return O.mutate_across(flags, lambda c: c.cast("int"), types=["boolean"])


@query(
    "threshold_flag",
    "SELECT event_id, value >= 100.4 AS fever, value > 100.0 / 3 AS dominant FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", (F.col("value") >= 100.4).alias("fever"), (F.col("value") > 100.0 / 3).alias("dominant")
    )
