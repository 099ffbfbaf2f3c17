"""Group tests, fits and scoring over the test tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from cohortlake.operators import fits as M
from cohortlake.operators import frames as O
from cohortlake.operators import groups as G
from cohortlake.operators import ranktests as R
from cohortlake.plans.design import design_matrix
from cohortlake.plans.diversity import diversity_by_exposure
from cohortlake.plans.effects import effect_compare, effect_counts, transform_effects
from cohortlake.registry import query
from cohortlake.sources import views as V
from cohortlake.sources.views import sql_with, table


def _round(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def normal_tail_sql(z: str) -> str:
    """Two-sided tail of the normal law by the series of the error function, apart from the library's own expression."""
    term = f"exp((2 * i + 1) * ln(abs({z}) / sqrt(2.0::DOUBLE)) - lgamma(i + 1.5::DOUBLE))"
    series = f"exp(-pow({z}, 2) / 2) * list_sum(list_transform(range(0, 200), lambda i: {term}))"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE WHEN abs({z}) > 8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {series}) END"


def ranksum_sql(rows: str, group: str) -> str:
    """Rank-sum statistics per variable of a (variable, group, v) row source."""
    return f"""
    ranked AS (SELECT variable, {group} AS grp, v,
                      rank() OVER (PARTITION BY variable ORDER BY v)
                      + (count(*) OVER (PARTITION BY variable, v) - 1) / 2.0::DOUBLE AS r,
                      count(*) OVER (PARTITION BY variable, v) AS ties
               FROM {rows} WHERE v IS NOT NULL AND {group} IS NOT NULL),
    ranksum AS (
        SELECT variable, n1, n2, w, (shift - sign(shift) * 0.5::DOUBLE) / sigma AS z FROM (
            SELECT variable, n1, n2, w, w - n1 * n2 / 2.0::DOUBLE AS shift,
                   sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma
            FROM (SELECT variable, count(*) FILTER (NOT grp) AS n1, count(*) FILTER (grp) AS n2,
                         sum(r) FILTER (NOT grp) - count(*) FILTER (NOT grp) * (count(*) FILTER (NOT grp) + 1) / 2.0::DOUBLE AS w,
                         sum(ties::DOUBLE * ties - 1) AS t
                  FROM ranked GROUP BY variable)))"""


@query(
    "wilcoxon_ranksum",
    sql_with(
        "subjects",
        """
        WITH long AS (SELECT 'n_orders' AS variable, stratum, n_orders AS v FROM subjects
                      UNION ALL SELECT 'spend', stratum, spend FROM subjects
                      UNION ALL SELECT 'balance', stratum, balance FROM subjects),"""
        + ranksum_sql("long", "stratum")
        + f"""
        SELECT variable, n1 AS n_first, n2 AS n_second, round(w, 6) AS w, round(z, 6) AS z,
               round({normal_tail_sql('z')}, 6) AS p_value FROM ranksum""",
    ),
)
def _(spark, d):
    out = R.wilcoxon_ranksum(V.subjects(spark, d), "stratum", ["n_orders", "spend", "balance"])
    return _round(out, 6, "w", "z", "p_value")


@query(
    "diversity_by_exposure",
    sql_with(
        "counts samples",
        """
        WITH h AS (SELECT sample, -sum(p * ln(p)) AS v FROM
                     (SELECT sample, n / sum(n) OVER (PARTITION BY sample)::DOUBLE AS p FROM counts WHERE n > 0)
                   GROUP BY sample),
        long AS (SELECT 'shannon' AS variable, exposed, v FROM h JOIN samples s ON s.sample = h.sample),"""
        + ranksum_sql("long", "exposed")
        + f"""
        SELECT s.variable, s.stratum, s.n, s.median, s.q1, s.q3, round(w, 6) AS w, round(z, 6) AS z,
               round({normal_tail_sql('z')}, 6) AS p_value
        FROM (SELECT variable, stratum, count(*) AS n, round(median(v), 6) AS median,
                     round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3
              FROM (SELECT variable, CAST(exposed AS VARCHAR) AS stratum, v FROM long
                    UNION ALL SELECT variable, 'overall', v FROM long) GROUP BY variable, stratum) s
        JOIN ranksum r ON r.variable = s.variable""",
    ),
)
def _(spark, d):
    out = diversity_by_exposure(V.counts(spark, d), V.samples(spark, d), "sample", "n", "exposed")
    return _round(out, 6, "median", "q1", "q3", "w", "z", "p_value")


_TABLES = """
    SELECT l_partkey AS part, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a,
           count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b,
           count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c,
           count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d
    FROM lineitem GROUP BY l_partkey"""


@query(
    "fisher_exact_2x2",
    f"""
    WITH t AS ({_TABLES}),
    k AS (SELECT part, a, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n,
                 unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t),
    p AS (SELECT part, k, a,
                 lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)
                 - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1) AS lp FROM k)
    SELECT part, round(least(1.0::DOUBLE, sum(exp(p.lp)) FILTER (p.lp <= o.lp + 1e-7)), 6) AS p_value
    FROM p JOIN (SELECT part AS q, lp FROM p WHERE k = a) o ON o.q = p.part GROUP BY part""",
)
def _(spark, d):
    returned, finished = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    tables = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("part"))
        .agg(
            F.count_if(returned & finished).alias("a"),
            F.count_if(returned & ~finished).alias("b"),
            F.count_if(~returned & finished).alias("c"),
            F.count_if(~returned & ~finished).alias("d"),
        )
    )
    return _round(R.fisher_exact(tables, ["part"], "a", "b", "c", "d"), 6, "p_value")


@query(
    "chi_square_rxc",
    sql_with(
        "subjects",
        """
        WITH c AS (SELECT 'last_status' AS variable, stratum, last_status AS level, count(*) AS n FROM subjects GROUP BY ALL
                   UNION ALL SELECT 'segment', stratum, segment, count(*) FROM subjects GROUP BY ALL),
        r AS (SELECT variable, stratum, sum(n) AS k FROM c GROUP BY ALL),
        l AS (SELECT variable, level, sum(n) AS k FROM c GROUP BY ALL),
        t AS (SELECT variable, sum(n) AS k FROM c GROUP BY ALL),
        s AS (SELECT r.variable, sum(pow(coalesce(c.n, 0) - r.k * l.k / t.k::DOUBLE, 2) / (r.k * l.k / t.k::DOUBLE)) AS x,
                     CAST((count(DISTINCT r.stratum) - 1) * (count(DISTINCT l.level) - 1) AS BIGINT) AS dof
              FROM r JOIN l ON l.variable = r.variable JOIN t ON t.variable = r.variable
              LEFT JOIN c ON c.variable = r.variable AND c.stratum = r.stratum AND c.level = l.level GROUP BY r.variable)
        SELECT variable, round(x, 6) AS statistic, dof,
               round(exp(-x / 2) * list_sum(list_transform(range(dof // 2), lambda i: pow(x / 2, i) / gamma(i + 1))), 6) AS p_value
        FROM s""",
    ),
)
def _(spark, d):
    subjects = V.subjects(spark, d)
    cells = (
        subjects.unpivot(["stratum"], ["last_status", "segment"], "variable", "level")
        .groupBy("variable", "stratum", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _round(R.chi_square(cells, ["variable"], "stratum", "level", "n"), 6, "statistic", "p_value")


_LOG_PAIRS = """
    lp AS (SELECT subject, subject % 5 AS arm, ln(click) AS x, ln(purchase) AS y FROM (
        SELECT subject, day, max(value) FILTER (kind = 'click') AS click, max(value) FILTER (kind = 'purchase') AS purchase
        FROM paired GROUP BY subject, day) WHERE click > 0 AND purchase > 0)"""


def _log_pairs(spark, d):
    paired = G.exact_kinds(V.paired(spark, d), ["subject", "day"], "kind", ["click", "purchase"])
    wide = O.pivot_kinds(paired, ["subject", "day"], "kind", "value", ["click", "purchase"])
    logged = O.positive_log(wide, {"click": "x", "purchase": "y"})
    return logged.select("subject", (F.col("subject") % 5).alias("arm"), "x", "y")


@query(
    "linear_fit",
    sql_with(
        "paired",
        "WITH "
        + _LOG_PAIRS
        + """
        SELECT arm, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
               round(regr_r2(y, x), 6) AS r2
        FROM (SELECT CAST(arm AS VARCHAR) AS arm, x, y FROM lp UNION ALL SELECT 'overall', x, y FROM lp) GROUP BY arm""",
    ),
)
def _(spark, d):
    return _round(M.linear_fit(_log_pairs(spark, d), "arm", "x", "y"), 6, "slope", "intercept", "r2")


@query(
    "fit_ribbon",
    sql_with(
        "paired draws",
        "WITH "
        + _LOG_PAIRS
        + """,
        e AS (SELECT min(x) AS lo, max(x) AS hi FROM lp),
        k AS (SELECT a.draw AS intercept, b.draw AS slope FROM draws a JOIN draws b
              ON b.chain = a.chain AND b.iter = a.iter WHERE a.param = 'click' AND b.param = 'view'),
        f AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 99 AS gx,
                     intercept + slope * (lo + i * (hi - lo) / 99) AS fit FROM k, e, range(100) r(i)),
        w AS (SELECT unnest([0.95::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE]) AS width),
        q AS (SELECT point, gx, median(fit) AS m, quantile_cont(fit, [0.025, 0.1, 0.25]) AS l,
                     quantile_cont(fit, [0.975, 0.9, 0.75]) AS u FROM f GROUP BY point, gx)
        SELECT point, round(exp(gx), 6) AS x, width, round(exp(m), 6) AS value,
               round(exp(CASE width WHEN 0.95 THEN l[1] WHEN 0.8 THEN l[2] ELSE l[3] END), 6) AS lower,
               round(exp(CASE width WHEN 0.95 THEN u[1] WHEN 0.8 THEN u[2] ELSE u[3] END), 6) AS upper
        FROM q, w""",
    ),
)
def _(spark, d):
    draws = V.draws(spark, d)
    intercept = draws.where(F.col("param") == "click").select("chain", "iter", F.col("draw").alias("intercept"))
    slope = draws.where(F.col("param") == "view").select("chain", "iter", F.col("draw").alias("slope"))
    ribbon = M.fit_ribbon(_log_pairs(spark, d), "x", intercept.join(slope, ["chain", "iter"]))
    return _round(ribbon, 6, "x", "value", "lower", "upper")


@query(
    "partial_pool_effects",
    sql_with(
        "design",
        """
        SELECT feature, n, round(sxy / nullif(sxx, 0), 8) AS slope, round(sxy / (sxx + 1), 8) AS shrunk FROM (
            SELECT feature, count(*) AS n, covar_pop(total / 1000.0::DOUBLE, x / 100.0::DOUBLE) * count(*) AS sxy,
                   var_pop(x / 100.0::DOUBLE) * count(*) AS sxx FROM design GROUP BY feature)""",
    ),
)
def _(spark, d):
    rows = V.design(spark, d).select("feature", (F.col("x") / 100.0).alias("x"), (F.col("total") / 1000.0).alias("y"))
    return _round(M.partial_pool_effects(rows, "feature", "x", "y"), 8, "slope", "shrunk")


def _scaled_design(spark, d):
    return V.design(spark, d).select(
        "sample",
        "feature",
        "y",
        (F.col("x") / 500.0).alias("x"),
        (F.col("total") / 20000.0).alias("total"),
        (F.col("fix_1") / 500.0).alias("fix_1"),
        (F.col("fix_2") / 500.0).alias("fix_2"),
        (F.col("fix_3") / 500.0).alias("fix_3"),
    )


def _newton_sql(fixed, steps: int, penalty: float) -> str:
    """Newton steps on the whole fit, one CTE each: the slopes are taken out, the rest is solved by elimination."""
    k = len(fixed) + 1
    z = [*fixed, "1.0::DOUBLE"]
    ridge = [f"{penalty}::DOUBLE" if j < len(fixed) else "0.0::DOUBLE" for j in range(k)]
    out = [
        "rows_of AS MATERIALIZED (SELECT feature, x / 500.0::DOUBLE AS x, y, total / 20000.0::DOUBLE AS total, "
        "fix_1 / 500.0::DOUBLE AS fix_1, fix_2 / 500.0::DOUBLE AS fix_2, fix_3 / 500.0::DOUBLE AS fix_3, "
        "count(*) OVER ()::DOUBLE AS n FROM design)",
        "slope_0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS b FROM design)",
        f"shared_0 AS (SELECT [{', '.join(['0.0::DOUBLE'] * k)}] AS g)",
    ]
    for i in range(steps):
        eta = " + ".join(["b * x", *[f"g[{j + 1}] * {v}" for j, v in enumerate(z)]])
        mean = lambda v: f"sum({v} / n)"
        squares = [f"[{', '.join(mean(f'w * {u} * {v}') for v in z)}]" for u in z]
        out.append(
            f"""sums_{i} AS MATERIALIZED (SELECT feature, any_value(b) AS b, {mean('x * r')} + {penalty} * any_value(b) AS pull,
            {mean('x * x * w')} + {penalty} AS curve, [{', '.join(mean(f'x * w * {v}') for v in z)}] AS c,
            [{', '.join(mean(f'r * {v}') for v in z)}] AS q, [{', '.join(squares)}] AS m
            FROM (SELECT *, p - y AS r, p * (1 - p) AS w FROM (
                SELECT t.*, b, 1 / (1 + exp(-({eta}))) AS p FROM rows_of t JOIN slope_{i} s ON s.feature = t.feature, shared_{i}))
            GROUP BY feature)"""
        )
        lines = []
        for u in range(k):
            cells = [
                f"sum(m[{u + 1}][{v + 1}] - c[{u + 1}] * c[{v + 1}] / curve) + {ridge[u] if u == v else '0.0::DOUBLE'}" for v in range(k)
            ]
            cells.append(f"-(sum(q[{u + 1}] - c[{u + 1}] * pull / curve) + {ridge[u]} * any_value(g[{u + 1}]))")
            lines.append(f"[{', '.join(cells)}]")
        solved = f"SELECT [{', '.join(lines)}] AS a FROM sums_{i}, shared_{i}"
        for u in range(1, k + 1):
            solved = (
                f"SELECT list_transform(a, lambda line, pos: CASE WHEN pos = {u} THEN list_transform(line, lambda v: v / line[{u}]) "
                f"ELSE list_transform(line, lambda v, j: v - line[{u}] / a[{u}][{u}] * a[{u}][j]) END) AS a FROM ({solved})"
            )
        out.append(f"move_{i} AS MATERIALIZED (SELECT list_transform(a, lambda line: line[{k + 1}]) AS d FROM ({solved}))")
        out.append(f"shared_{i + 1} AS MATERIALIZED (SELECT list_transform(g, lambda v, j: v + d[j]) AS g FROM shared_{i}, move_{i})")
        out.append(
            f"slope_{i + 1} AS MATERIALIZED (SELECT feature, b + (-pull - list_inner_product(c, d)) / curve AS b FROM sums_{i}, move_{i})"
        )
    return ",\n".join(out)


_NEWTON_STEPS = 10


@query(
    "logistic_effects",
    sql_with(
        "design",
        "WITH "
        + _newton_sql(["total", "fix_1", "fix_2", "fix_3"], _NEWTON_STEPS, 0.01)
        + f"""
        SELECT feature AS term, round(b, 5) AS value FROM slope_{_NEWTON_STEPS}
        UNION ALL SELECT unnest(['total', 'fix_1', 'fix_2', 'fix_3', 'intercept']), round(unnest(g), 5) FROM shared_{_NEWTON_STEPS}""",
    ),
)
def _(spark, d):
    out = M.logistic_effects(_scaled_design(spark, d), "feature", "x", "y", ["total", "fix_1", "fix_2", "fix_3"])
    return _round(out, 5, "value")


@query(
    "linear_predictor",
    sql_with(
        "design coefs",
        """
        SELECT sample, feature, round(eta, 6) AS eta, round(1 / (1 + exp(-eta)), 6) AS prob FROM (
            SELECT d.sample, d.feature, coalesce(c.value, 0) * (x / 500.0::DOUBLE) - 0.25::DOUBLE
                   + 0.5::DOUBLE * (total / 20000.0::DOUBLE) + 0.2::DOUBLE * (fix_1 / 500.0::DOUBLE)
                   - 0.3::DOUBLE * (fix_2 / 500.0::DOUBLE) AS eta
            FROM design d LEFT JOIN coefs c ON c.term = d.feature)""",
    ),
)
def _(spark, d):
    fixed = {"total": 0.5, "fix_1": 0.2, "fix_2": -0.3}
    out = M.linear_predictor(_scaled_design(spark, d), V.coefs(spark, d), "feature", "x", fixed, -0.25)
    return _round(out.select("sample", "feature", "eta", "prob"), 6, "eta", "prob")


_OUTCOMES = """
    o AS (SELECT event_type AS feature, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) / 30.0::DOUBLE AS x,
                 (user_id % 4) / 4.0::DOUBLE AS total, CAST(event_id % 3 = 0 AS INTEGER) AS third,
                 CAST(value > 35 AS INTEGER) AS y FROM events),
    shared AS (SELECT chain, iter, max(draw) FILTER (param = 'alpha') AS alpha, max(draw) FILTER (param = 'b_total') AS b_total,
                      max(draw) FILTER (param = 'b_third') AS b_third, max(draw) FILTER (param = 'sigma') AS sigma
               FROM joint_draws GROUP BY chain, iter)"""
_FIXED = {"b_total": "total", "b_third": "third"}


def _outcomes(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit(V.FIRST_DAY).cast("date")) / 30.0
    return table(spark, d, "events").select(
        F.col("event_type").alias("feature"),
        day.alias("x"),
        ((F.col("user_id") % 4) / 4.0).alias("total"),
        (F.col("event_id") % 3 == 0).cast("int").alias("third"),
        (F.col("value") > 35).cast("int").alias("y"),
    )


@query(
    "log_likelihood",
    sql_with(
        "joint_draws",
        "WITH "
        + _OUTCOMES
        + """,
        c AS (SELECT feature, x, total, third, y, count(*) AS k FROM o GROUP BY ALL)
        SELECT chain, iter, round(sum(k * (y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta))))), 4) AS log_lik
        FROM (SELECT d.chain, d.iter, k, y, draw * x + s.alpha + s.b_total * total + s.b_third * third AS eta
              FROM joint_draws d JOIN shared s ON s.chain = d.chain AND s.iter = d.iter JOIN c ON c.feature = d.param)
        GROUP BY chain, iter""",
    ),
)
def _(spark, d):
    draws = V.joint_draws(spark, d).where("param <> 'sigma'")
    out = M.log_likelihood_bernoulli(_outcomes(spark, d), draws, "feature", "x", "y", "alpha", _FIXED)
    return _round(out, 4, "log_lik")


@query(
    "log_likelihood_normal",
    sql_with(
        "joint_draws",
        "WITH "
        + _OUTCOMES
        + """,
        c AS (SELECT feature, x, total, third, y, count(*) AS k FROM o GROUP BY ALL)
        SELECT d.chain, d.iter, round(sum(k * (-ln(sigma) - 0.5 * ln(2 * pi())
                   - pow(y - s.alpha - draw * x - s.b_total * total - s.b_third * third, 2) / (2 * sigma * sigma))), 4) AS log_lik
        FROM joint_draws d JOIN shared s ON s.chain = d.chain AND s.iter = d.iter JOIN c ON c.feature = d.param
        GROUP BY d.chain, d.iter""",
    ),
)
def _(spark, d):
    out = M.log_likelihood_normal(_outcomes(spark, d), V.joint_draws(spark, d), "feature", "x", "y", "alpha", "sigma", _FIXED)
    return _round(out, 4, "log_lik")


@query(
    "horseshoe_scale",
    sql_with(
        "hs_draws",
        """
        WITH w AS (SELECT chain, iter, feature, max(draw) FILTER (kind = 'beta') AS beta, max(draw) FILTER (kind = 'lambda') AS l,
                          max(draw) FILTER (kind = 'tau') * (1.0::DOUBLE / 2.0 / sqrt(100.0::DOUBLE)) AS tau,
                          max(draw) FILTER (kind = 'c2') * 4 AS c2
                   FROM hs_draws GROUP BY ALL)
        SELECT chain, iter, feature, round(tau * sqrt(c2 * l * l / (c2 + tau * tau * l * l)) * beta, 6) AS slope
        FROM w WHERE beta IS NOT NULL AND l IS NOT NULL AND tau IS NOT NULL AND c2 IS NOT NULL""",
    ),
)
def _(spark, d):
    out = M.horseshoe_scale(V.hs_draws(spark, d), ["chain", "iter", "feature"], 1, 3, 100)
    return _round(out, 6, "slope")


@query(
    "design_matrix",
    sql_with(
        "design",
        """
        WITH r AS (SELECT * FROM design WHERE cohort = 'validation' AND feature IN
                     (SELECT feature FROM design WHERE cohort = 'validation' GROUP BY feature HAVING sum(x) > 0)),
        z AS (SELECT """
        + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("x", "total", "fix_1", "fix_2", "fix_3"))
        + """ FROM r)
        SELECT sample, y, feature, """
        + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in ("x", "total", "fix_1", "fix_2", "fix_3"))
        + """, CAST(dense_rank() OVER (ORDER BY feature) AS BIGINT) AS feature_num FROM r, z""",
    ),
)
def _(spark, d):
    outcomes = V.samples(spark, d).select("sample", "cohort", F.col("exposed").cast("int").alias("y"))
    rows, _ = design_matrix(V.counts_dense(spark, d), outcomes, F.col("cohort") == "validation", V.FIXED_FEATURES)
    kept = rows.select("sample", "y", "feature", "x", "total", "fix_1", "fix_2", "fix_3", "feature_num")
    return _round(kept, 6, "x", "total", "fix_1", "fix_2", "fix_3")


_BOUNDS = ["q5", "q10", "q25", "q50", "q75", "q90", "q95"]


_PROBS = {"q5": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}


@query(
    "effect_compare",
    sql_with(
        "counts_dense samples",
        """
        WITH cells AS (
            SELECT c.sample, feature, cohort, exposed::DOUBLE AS y,
                   (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS scaled, ln(n) - avg(ln(n)) OVER (PARTITION BY c.sample) AS clr
            FROM counts_dense c JOIN samples s ON s.sample = c.sample WHERE n > 0),
        grouped AS (
            SELECT feature, coalesce(cohort, 'Pooled') AS cohort, avg(y) AS p, count(*) AS k,
                   covar_pop(scaled, y) AS c1, var_pop(scaled) AS v1, covar_pop(clr, y) AS c2, var_pop(clr) AS v2
            FROM cells GROUP BY GROUPING SETS ((feature, cohort), (feature))),
        fits AS (
            SELECT 'Scaled' AS form, feature, cohort, c1 / (p * (1 - p) * v1) AS b, 1 / sqrt(k * p * (1 - p) * v1) AS se FROM grouped WHERE p * (1 - p) * v1 > 0
            UNION ALL
            SELECT 'CLR Transformed', feature, cohort, c2 / (p * (1 - p) * v2), 1 / sqrt(k * p * (1 - p) * v2) FROM grouped WHERE p * (1 - p) * v2 > 0),
        effects AS (SELECT form, feature, cohort, """
        + ", ".join(f"b + se * {NormalDist().inv_cdf(p)!r}::DOUBLE AS {q}" for q, p in _PROBS.items())
        + """ FROM fits)
        SELECT form, feature, cohort, """
        + ", ".join(f"round(exp({q}), 6) AS {q}" for q in _BOUNDS)
        + """,
               CASE WHEN q5 > 0 OR q95 < 0 THEN '< 0.05' WHEN q10 > 0 OR q90 < 0 THEN '< 0.1'
                    WHEN q25 > 0 OR q75 < 0 THEN '< 0.25' ELSE '>= 0.25' END AS certainty
        FROM effects WHERE feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
          AND feature IN (SELECT feature FROM effects GROUP BY feature HAVING bool_or(q10 > 0 OR q90 < 0))""",
    ),
)
def _(spark, d):
    outcomes = V.samples(spark, d).select("sample", "cohort", F.col("exposed").cast("double").alias("y"))
    tables = transform_effects(V.counts_dense(spark, d), outcomes, "sample", "feature", "n", "cohort", "y", _PROBS)
    included = V.counts_dense(spark, d).where(~F.col("feature").isin(*V.FIXED_FEATURES)).select("feature").distinct()
    out = effect_compare(tables, "form", "feature", included, _BOUNDS)
    return _round(out, 6, *_BOUNDS)


@query(
    "effect_counts",
    sql_with(
        "effects",
        """
        SELECT count(DISTINCT feature) AS features, count(DISTINCT feature) FILTER (q10 > 0 OR q90 < 0) AS certain_10,
               count(DISTINCT feature) FILTER (q5 > 0 OR q95 < 0) AS certain_5,
               count(DISTINCT feature) FILTER (q10 > 0) AS raising, count(DISTINCT feature) FILTER (q90 < 0) AS lowering,
               count(DISTINCT feature) FILTER (q90 < 0 AND genus = 'click') AS lowering_click,
               count(DISTINCT feature) FILTER (q90 < 0 AND regexp_matches(genus, 'view|signup')) AS lowering_other
        FROM effects""",
    ),
)
def _(spark, d):
    return effect_counts(V.effects(spark, d), "feature", "genus", {"click": "^Click$", "other": "View|Signup"})
