"""Draw summaries, intervals and diagnostics over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions.normal import normal_quantile_sql
from cohortlake.operators import distances as D
from cohortlake.operators import posterior as K
from cohortlake.operators.frames import presence_rows
from cohortlake.operators.groups import first_distinct_index
from cohortlake.operators.ranks import exact_quantiles
from cohortlake.plans.effects import hit_features
from cohortlake.registry import query
from cohortlake.sources import views as V
from cohortlake.sources.views import QUANTILES, sql_with


def _round(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# Every draw with the length of its chain.
_CHAINS = "kept AS (SELECT *, count(*) OVER (PARTITION BY param, chain) AS len FROM draws)"


def _spread_sql(groups: str) -> str:
    """Of groups ``(param, k, mu, v)`` per parameter: groups m, draws n, pooled variance within, weighted variance between."""
    return f"""
        SELECT param, count(*) AS m, sum(k) AS n, sum(coalesce((k - 1) * v, 0)) / sum(k - 1) AS w,
               sum(k * (mu - grand) * (mu - grand)) / (sum(k) / count(*)) / nullif(count(*) - 1, 0) AS b
        FROM (SELECT *, sum(k * mu) OVER (PARTITION BY param) / sum(k) OVER (PARTITION BY param) AS grand FROM {groups})
        GROUP BY param"""


_ESS = (
    _CHAINS
    + f""",
    means AS (SELECT param, chain, avg(draw) AS mu, var_samp(draw) AS v, count(*)::DOUBLE AS k FROM kept GROUP BY ALL),
    cent AS (SELECT k.param, k.chain, k.iter, k.draw - mu AS x FROM kept k JOIN means USING (param, chain)),
    spread AS ({_spread_sql("means")}),
    acov AS (SELECT a.param, lag, sum(a.x * c.x) AS s FROM cent a CROSS JOIN range(64) l(lag)
             JOIN cent c ON c.param = a.param AND c.chain = a.chain AND c.iter = a.iter + lag GROUP BY ALL),
    rho AS (SELECT a.param, lag, CASE lag WHEN 0 THEN 1 ELSE
                1 - (w - s / n) / ((n - m) / n * w + b) END AS rho
            FROM acov a JOIN spread USING (param)),
    geyer AS (SELECT param, lag // 2 AS k, sum(rho) AS p FROM rho GROUP BY ALL HAVING count(*) = 2),
    held AS (SELECT param, min(p) OVER (PARTITION BY param ORDER BY k) AS low FROM geyer),
    ess AS (SELECT param, m, n, n / (2 * sum(low) FILTER (low > 0) - 1) AS n_eff
            FROM held JOIN spread USING (param) GROUP BY param, m, n)"""
)


def _rhat_sql(source: str, name: str) -> str:
    return f"""
    {name}_half AS (SELECT param, chain, iter > len // 2 AS h, avg(draw) AS mu, var_samp(draw) AS v, count(*)::DOUBLE AS k
                    FROM {source} GROUP BY ALL),
    {name}_spread AS ({_spread_sql(name + "_half")}),
    {name} AS (SELECT param, sqrt(((n - m) / n * w + b) / w) AS rhat FROM {name}_spread)"""


@query(
    "draw_summary",
    sql_with(
        "draws",
        "WITH "
        + _ESS
        + ","
        + _rhat_sql("kept", "scale")
        + """
        SELECT d.param, round(avg(draw), 6) AS mean, round(stddev_samp(draw), 6) AS sd,
               round(stddev_samp(draw) / sqrt(any_value(n_eff)), 6) AS se_mean, round(any_value(n_eff), 3) AS n_eff,
               round(any_value(rhat), 6) AS rhat, """
        + ", ".join(f"round(quantile_cont(draw, {p}), 6) AS {name}" for name, p in QUANTILES.items())
        + """ FROM draws d JOIN ess e ON e.param = d.param JOIN scale s ON s.param = d.param GROUP BY d.param""",
    ),
)
def _(spark, d):
    out = K.draw_summary(V.draws(spark, d), QUANTILES)
    return _round(_round(out, 6, "mean", "sd", "se_mean", "rhat", *QUANTILES), 3, "n_eff")


_WIDTHS = {
    "type_s_2_5": ("q2_5", "q97_5"),
    "type_s_5": ("q5", "q95"),
    "type_s_10": ("q10", "q90"),
    "type_s_25": ("q25", "q75"),
}


@query(
    "sign_flags",
    sql_with(
        "effects",
        "SELECT feature, cohort, "
        + ", ".join(
            f"{lo} > 0 AND {hi} > 0 AS {name}_pos, {lo} < 0 AND {hi} < 0 AS {name}_neg"
            for name, (lo, hi) in _WIDTHS.items()
        )
        + " FROM effects",
    ),
)
def _(spark, d):
    flagged = K.sign_flags(V.effects(spark, d), _WIDTHS)
    return flagged.select("feature", "cohort", *[f"{n}_{s}" for n in _WIDTHS for s in ("pos", "neg")])


@query(
    "sign_error",
    sql_with(
        "effect_draws",
        "SELECT feature, cohort, round(t, 6) AS type_s, t < 0.05 AS certain FROM (SELECT feature, cohort, "
        "least(count(*) FILTER (draw > 0), count(*) FILTER (draw < 0)) / count(*)::DOUBLE AS t "
        "FROM effect_draws GROUP BY feature, cohort)",
    ),
)
def _(spark, d):
    return _round(K.sign_error(V.effect_draws(spark, d), ["feature", "cohort"], "draw"), 6, "type_s")


@query(
    "hpdi",
    sql_with(
        "draws",
        """
        WITH o AS (SELECT param, draw, row_number() OVER w AS k, count(*) OVER (PARTITION BY param) AS n
                   FROM draws WINDOW w AS (PARTITION BY param ORDER BY draw, chain, iter)),
        s AS (SELECT a.param, a.draw AS lo, b.draw AS hi FROM o a JOIN o b ON b.param = a.param
              AND b.k = a.k + greatest(1, least(a.n - 1, CAST(round_even(a.n * 0.95::DOUBLE, 0) AS BIGINT))))
        SELECT param, round(arg_min(lo, (hi - lo, lo)), 6) AS hpdi_low, round(arg_min(hi, (hi - lo, lo)), 6) AS hpdi_high
        FROM s GROUP BY param""",
    ),
)
def _(spark, d):
    out = K.hpdi(V.draws(spark, d), ["param"], "draw", 0.95, [F.col("chain"), F.col("iter")])
    return _round(out, 6, "hpdi_low", "hpdi_high")


@query(
    "central_interval",
    sql_with(
        "draws",
        "SELECT param, round(quantile_cont(draw, 0.025), 6) AS pi_low, round(quantile_cont(draw, 0.975), 6) AS pi_high, "
        "round(median(draw), 6) AS median FROM draws GROUP BY param",
    ),
)
def _(spark, d):
    return _round(K.central_interval(V.draws(spark, d), ["param"], "draw", 0.95), 6, "pi_low", "pi_high", "median")


@query(
    "split_rhat",
    sql_with("draws", "WITH " + _CHAINS + "," + _rhat_sql("kept", "scale") + " SELECT param, round(rhat, 6) AS rhat FROM scale"),
)
def _(spark, d):
    return _round(K.split_rhat(V.draws(spark, d)), 6, "rhat")


@query(
    "rank_rhat",
    sql_with(
        "draws",
        "WITH "
        + _CHAINS
        + f""",
        p AS (SELECT param, chain, iter, len, (rank() OVER (PARTITION BY param ORDER BY draw)
                     + (count(*) OVER (PARTITION BY param, draw) - 1) / 2.0::DOUBLE - 0.375)
                     / (count(*) OVER (PARTITION BY param) + 0.25) AS p FROM kept),
        z AS (SELECT param, chain, iter, len, {normal_quantile_sql("p")} AS draw FROM p),"""
        + _rhat_sql("z", "scale")
        + " SELECT param, round(rhat, 6) AS rhat FROM scale",
    ),
)
def _(spark, d):
    return _round(K.rank_rhat(V.draws(spark, d)), 6, "rhat")


@query(
    "effective_size",
    sql_with("draws", "WITH " + _ESS + " SELECT param, m AS chains, n::BIGINT AS draws, round(n_eff, 3) AS n_eff FROM ess"),
)
def _(spark, d):
    return _round(K.effective_size(V.draws(spark, d)), 3, "n_eff")


@query(
    "diag_divergence",
    sql_with(
        "sampler",
        "SELECT CAST(sum(divergent) AS BIGINT) AS n, count(*) AS iterations, "
        "round(sum(divergent) * 100.0::DOUBLE / count(*), 6) AS percent FROM sampler",
    ),
)
def _(spark, d):
    return _round(K.divergences(V.sampler(spark, d)), 6, "percent")


@query(
    "diag_treedepth",
    sql_with(
        "sampler",
        "SELECT count(*) FILTER (treedepth = 10) AS n, count(*) AS iterations, "
        "round(count(*) FILTER (treedepth = 10) * 100.0::DOUBLE / count(*), 6) AS percent FROM sampler",
    ),
)
def _(spark, d):
    return _round(K.saturated_depth(V.sampler(spark, d)), 6, "percent")


_ENERGY = """
    energy_check AS (SELECT chain, sum(step * step) / count(*) / var_samp(energy) AS e FROM (
        SELECT chain, energy, energy - lag(energy) OVER (PARTITION BY chain ORDER BY iter) AS step FROM sampler)
        GROUP BY chain)"""


@query(
    "diag_energy",
    sql_with("sampler", "WITH " + _ENERGY + " SELECT chain, round(e, 6) AS e_bfmi, e < 0.2 AS low FROM energy_check"),
)
def _(spark, d):
    return _round(K.energy_fraction(V.sampler(spark, d)), 6, "e_bfmi")


@query(
    "diag_report",
    sql_with(
        "draws sampler",
        "WITH "
        + _ESS
        + ","
        + _rhat_sql("kept", "scale")
        + ","
        + _ENERGY
        + """
        SELECT 'n_eff' AS "check", param AS item, round(n_eff / n, 6) AS value, NOT n_eff / n < 0.001 AS ok FROM ess
        UNION ALL SELECT 'rhat', param, round(rhat, 6), NOT (rhat > 1.1 OR isnan(rhat) OR isinf(rhat)) FROM scale
        UNION ALL SELECT 'energy', CAST(chain AS VARCHAR), round(e, 6), NOT e < 0.2 FROM energy_check
        UNION ALL SELECT 'divergence', 'all', CAST(sum(divergent) AS DOUBLE), sum(divergent) = 0 FROM sampler
        UNION ALL SELECT 'treedepth', 'all', CAST(count(*) FILTER (treedepth = 10) AS DOUBLE),
                         count(*) FILTER (treedepth = 10) = 0 FROM sampler""",
    ),
)
def _(spark, d):
    return _round(K.diagnostic_report(V.draws(spark, d), V.sampler(spark, d)), 6, "value")


@query(
    "partition_divergent",
    sql_with(
        "draws sampler",
        "SELECT d.param, d.chain, d.iter, round(d.draw, 6) AS draw, s.divergent FROM draws d "
        "JOIN sampler s ON s.chain = d.chain AND s.iter = d.iter",
    ),
)
def _(spark, d):
    out = K.partition_divergent(V.draws(spark, d), V.sampler(spark, d))
    return _round(out.select("param", "chain", "iter", "draw", "divergent"), 6, "draw")


@query(
    "label_parameters",
    sql_with(
        "taxonomy",
        """
        WITH ix AS (SELECT feature, row_number() OVER (ORDER BY feature) AS feature_num FROM (SELECT DISTINCT feature FROM taxonomy))
        SELECT 'beta[' || feature_num || ']' AS parameter, feature_num, t.feature, genus, family,
               'beta[' || feature_num || ']' || chr(10) || t.feature AS param_lab
        FROM ix JOIN taxonomy t ON t.feature = ix.feature""",
    ),
)
def _(spark, d):
    labels = V.taxonomy(spark, d)
    index = first_distinct_index(labels, "feature", "feature_num")
    summary = index.select(
        F.concat(F.lit("beta["), F.col("feature_num").cast("string"), F.lit("]")).alias("parameter")
    )
    return K.label_parameters(summary, index, labels, "feature_num", "feature")


# Presence above 60 in the wide-feature table, correlated within each cohort.
_CORRELATION = """
    o AS (SELECT s.cohort, c.sample, c.feature FROM counts_dense c JOIN samples s ON s.sample = c.sample WHERE c.n > 600),
    z AS (SELECT cohort, count(*) AS n FROM samples GROUP BY cohort),
    k AS (SELECT cohort, feature, count(*) AS k FROM o GROUP BY ALL),
    j AS (SELECT x.cohort, x.feature AS fx, y.feature AS fy, count(*) AS c FROM o x JOIN o y
          ON y.cohort = x.cohort AND y.sample = x.sample AND x.feature < y.feature GROUP BY ALL),
    cor AS (SELECT a.cohort, a.feature AS feature_x, b.feature AS feature_y,
                   CASE WHEN a.k < n AND b.k < n THEN (coalesce(c, 0) * n - a.k * b.k)
                        / sqrt(a.k::DOUBLE * (n - a.k) * b.k * (n - b.k)) END AS cor
            FROM k a JOIN k b ON b.cohort = a.cohort AND a.feature < b.feature JOIN z ON z.cohort = a.cohort
            LEFT JOIN j ON j.cohort = a.cohort AND j.fx = a.feature AND j.fy = b.feature)"""


def _correlations(spark, d):
    samples = V.samples(spark, d).select("sample", "cohort")
    present = presence_rows(V.counts_dense(spark, d).join(samples, "sample"), "feature", "n", 600)
    return D.pairwise_correlation(present, "cohort", "sample", "feature", "present", samples)


@query(
    "pairwise_correlation",
    sql_with(
        "counts_dense samples",
        "WITH " + _CORRELATION + " SELECT cohort, feature_x, feature_y, round(cor, 6) + 0.0 AS cor FROM cor",
    ),
)
def _(spark, d):
    return _correlations(spark, d).withColumn("cor", F.round("cor", 6) + 0.0)


@query(
    "extreme_partners",
    sql_with(
        "counts_dense samples",
        "WITH "
        + _CORRELATION
        + """,
        both_ways AS (SELECT cohort, feature_x, feature_y, cor FROM cor UNION ALL SELECT cohort, feature_y, feature_x, cor FROM cor),
        named AS (SELECT p_brand AS feature, min(p_type) AS genus FROM part WHERE p_brand <> 'Brand#7' GROUP BY p_brand)
        SELECT cohort, feature_x, feature_y, round(cor, 6) + 0.0 AS cor, genus AS genus_y,
               coalesce(genus || chr(10) || '(' || feature_y || ')', feature_y) AS label_y
        FROM both_ways LEFT JOIN named ON named.feature = feature_y
        WHERE feature_x IN ('Brand#1', 'Brand#2') AND cor IS NOT NULL
        ORDER BY round(cor, 6), cohort, feature_x, feature_y LIMIT 20""",
    ),
)
def _(spark, d):
    targets = V.coefs(spark, d).where(F.col("term").isin("Brand#1", "Brand#2")).select(F.col("term").alias("feature_x"))
    # One brand has no genus, as some features have none.
    named = V.table(spark, d, "part").where("p_brand <> 'Brand#7'").groupBy(F.col("p_brand").alias("feature")).agg(F.min("p_type").alias("genus"))
    return K.extreme_partners(_correlations(spark, d), targets, named, "cor", 20, ["cohort"])


@query(
    "hit_features",
    sql_with("effects", "SELECT DISTINCT feature FROM effects WHERE q5 > 0 OR q95 < 0"),
)
def _(spark, d):
    return hit_features(V.effects(spark, d), "feature")


@query(
    "draw_quantiles_by_chain",
    sql_with(
        "draws",
        "SELECT param, chain, round(quantile_cont(draw, 0.5), 6) AS q50, round(quantile_cont(draw, 0.9), 6) AS q90 "
        "FROM draws GROUP BY param, chain",
    ),
)
def _(spark, d):
    out = exact_quantiles(V.draws(spark, d), ["param", "chain"], "draw", {"q50": 0.5, "q90": 0.9})
    return _round(out, 6, "q50", "q90")
