"""Log densities, logistic fits, exact tests and table one against dense or exact versions."""

import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import fits, ranktests, summaries
from cohortlake.plans.effects import transform_effects


def model_rows(rng, rows=300, features=4):
    return [
        (f"f{rng.integers(features)}", float(rng.normal()), float(rng.normal()), float(rng.integers(2)), int(rng.integers(2)))
        for _ in range(rows)
    ]


def all_draws(spark, rng, features, names, draws=60, drop=None):
    values = {p: rng.normal(0, 0.7, draws) for p in [*features, *names]}
    if "sigma" in values:
        values["sigma"] = np.abs(values["sigma"]) + 0.5
    rows = [(p, k % 3, k // 3, float(v)) for p, vs in values.items() for k, v in enumerate(vs) if (p, k) != drop]
    return values, spark.createDataFrame(rows, "param string, chain int, iter long, draw double").repartition(3)


SCHEMA = "feature string, x double, total double, third double, y int"
FIXED = {"b_total": "total", "b_third": "third"}


@pytest.mark.parametrize("tiles", [(2048, 512), (7, 4)])
def test_log_likelihood_of_the_whole_predictor(spark, monkeypatch, tiles):
    monkeypatch.setattr(fits, "TILE_CELLS", tiles[0])
    monkeypatch.setattr(fits, "TILE_DRAWS", tiles[1])
    rng = np.random.default_rng(4)
    rows = model_rows(rng) + [("f0", 0.5, 0.5, 1.0, 1)] * 200
    data = spark.createDataFrame([*rows, ("f1", None, 0.0, 0.0, 1), (None, 1.0, 0.0, 0.0, 1)], SCHEMA)
    names = ["alpha", *FIXED, "sigma"]
    v, draws = all_draws(spark, rng, [f"f{k}" for k in range(4)], names)
    slope = np.stack([v[r[0]] for r in rows], 1)
    x, total, third, y = (np.array([float(r[k]) for r in rows]) for k in range(1, 5))
    eta = slope * x + v["alpha"][:, None] + np.outer(v["b_total"], total) + np.outer(v["b_third"], third)
    want = (y * eta - np.logaddexp(0, eta)).sum(1)
    out = fits.log_likelihood_bernoulli(data, draws.where("param <> 'sigma'"), "feature", "x", "y", "alpha", FIXED)
    got = {(r.chain, r.iter): r.log_lik for r in out.collect()}
    assert got == pytest.approx({(k % 3, k // 3): want[k] for k in range(60)})
    sigma = v["sigma"][:, None]
    want = (-np.log(sigma) - 0.5 * math.log(2 * math.pi) - (y - eta) ** 2 / (2 * sigma**2)).sum(1)
    out = fits.log_likelihood_normal(data, draws, "feature", "x", "y", "alpha", "sigma", FIXED)
    got = {(r.chain, r.iter): r.log_lik for r in out.collect()}
    assert got == pytest.approx({(k % 3, k // 3): want[k] for k in range(60)})


def test_log_likelihood_shuffles_the_draws_once_however_the_cells_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = model_rows(rng)
    data = spark.createDataFrame(rows, SCHEMA)
    names = ["alpha", *FIXED]
    v, draws = all_draws(spark, rng, [f"f{k}" for k in range(4)], names)
    slope = np.stack([v[r[0]] for r in rows], 1)
    x, total, third, y = (np.array([float(r[k]) for r in rows]) for k in range(1, 5))
    eta = slope * x + v["alpha"][:, None] + np.outer(v["b_total"], total) + np.outer(v["b_third"], third)
    want = (y * eta - np.logaddexp(0, eta)).sum(1)
    monkeypatch.setattr(fits, "TILE_CELLS", 16)
    monkeypatch.setattr(fits, "TILE_DRAWS", 4)
    whole = fits.log_likelihood_bernoulli(data, draws, "feature", "x", "y", "alpha", FIXED)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    monkeypatch.setattr(fits, "SENT_CELLS", 110)
    monkeypatch.setattr(fits, "DEALT_DRAWS", 50)
    for out in (whole, fits.log_likelihood_bernoulli(data, draws, "feature", "x", "y", "alpha", FIXED)):
        got = {(r.chain, r.iter): r.log_lik for r in out.collect()}
        assert got == pytest.approx({(k % 3, k // 3): want[k] for k in range(60)})


def test_a_feature_without_draws_in_a_whole_block_of_iterations_raises(spark, monkeypatch):
    monkeypatch.setattr(fits, "TILE_DRAWS", 1)
    rng = np.random.default_rng(9)
    data = spark.createDataFrame(model_rows(rng), SCHEMA)
    _, draws = all_draws(spark, rng, [f"f{k}" for k in range(4)], ["alpha"], 12)
    block = F.pmod(F.xxhash64(F.col("chain").cast("long"), F.col("iter").cast("long")), F.lit(12))
    gone = draws.select(F.min(block)).first()[0]
    with pytest.raises(Exception, match="needs one draw"):
        fits.log_likelihood_bernoulli(data, draws.where((F.col("param") != "f1") | (block != gone)), "feature", "x", "y", "alpha").collect()


def test_constants_stand_for_parameters(spark):
    rng = np.random.default_rng(5)
    rows = model_rows(rng)
    v, draws = all_draws(spark, rng, [f"f{k}" for k in range(4)], [], 6)
    x, y = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
    eta = np.stack([v[r[0]] for r in rows], 1) * x - 0.2
    data = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r.log_lik for r in fits.log_likelihood_bernoulli(data, draws, "feature", "x", "y", -0.2).collect())
    assert got == pytest.approx(sorted((y * eta - np.logaddexp(0, eta)).sum(1)))
    got = sorted(r.log_lik for r in fits.log_likelihood_normal(data, draws, "feature", "x", "y", -0.2, 1.5).collect())
    assert got == pytest.approx(sorted((-math.log(1.5) - 0.5 * math.log(2 * math.pi) - (y - eta) ** 2 / 4.5).sum(1)))


def test_a_null_draw_makes_its_log_likelihood_null(spark):
    rng = np.random.default_rng(7)
    rows = model_rows(rng)
    data = spark.createDataFrame(rows, SCHEMA)
    _, draws = all_draws(spark, rng, [f"f{k}" for k in range(4)], ["alpha", "sigma"], 12)
    unknown = {("f2", 1, 1), ("alpha", 2, 3), ("alpha", 0, 0), ("f0", 0, 0), ("f1", 0, 0), ("f2", 0, 0), ("f3", 0, 0)}
    gone = F.concat_ws("/", "param", "chain", "iter").isin(*["/".join(map(str, u)) for u in unknown])
    holed = draws.withColumn("draw", F.when(~gone, F.col("draw")))
    for call in (
        lambda d: fits.log_likelihood_bernoulli(data, d.where("param <> 'sigma'"), "feature", "x", "y", "alpha"),
        lambda d: fits.log_likelihood_normal(data, d, "feature", "x", "y", "alpha", "sigma"),
    ):
        want, got = ({(r.chain, r.iter): r.log_lik for r in call(d).collect()} for d in (draws, holed))
        lost = {(chain, i) for _, chain, i in unknown}
        assert {k for k, v in got.items() if v is None} == lost
        assert {k: v for k, v in got.items() if k not in lost} == pytest.approx({k: v for k, v in want.items() if k not in lost})


def test_features_and_parameters_without_draws_raise(spark):
    rng = np.random.default_rng(6)
    data = spark.createDataFrame(model_rows(rng), SCHEMA)
    _, draws = all_draws(spark, rng, ["f0", "f1", "f2"], ["alpha", "sigma"], 6)
    for call in (
        lambda: fits.log_likelihood_bernoulli(data, draws.where("param <> 'sigma'"), "feature", "x", "y", "alpha"),
        lambda: fits.log_likelihood_normal(data, draws, "feature", "x", "y", "alpha", "sigma"),
    ):
        with pytest.raises(ValueError, match="f3"):
            call()
    known = data.where("feature <> 'f3'")
    with pytest.raises(ValueError, match="b_total"):
        fits.log_likelihood_normal(known, draws, "feature", "x", "y", "alpha", "sigma", {"b_total": "total"})
    for lost in ("f1", "alpha"):
        _, holed = all_draws(spark, rng, ["f0", "f1", "f2"], ["alpha", "sigma"], 6, drop=(lost, 2))
        with pytest.raises(Exception, match="needs one draw"):
            fits.log_likelihood_normal(known, holed, "feature", "x", "y", "alpha", "sigma").collect()
        with pytest.raises(Exception, match="needs one draw"):
            fits.log_likelihood_bernoulli(known, holed.where("param <> 'sigma'"), "feature", "x", "y", "alpha").collect()


def dense_logistic(x, z, y, feature, count, ridge):
    """Newton on all coefficients at once; the last column of z is the intercept."""
    design = np.hstack([np.where(feature[:, None] == np.arange(count), x[:, None], 0.0), z])
    penalty = np.r_[np.full(design.shape[1] - 1, ridge), 0.0]
    b = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ b))
        gradient = design.T @ (p - y) / len(y) + penalty * b
        b -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / len(y) + np.diag(penalty), gradient)
    return b


def test_logistic_fit_equals_a_dense_one(spark):
    rng = np.random.default_rng(8)
    n, count = 900, 40
    feature, x, t = rng.integers(0, count, n), rng.normal(0, 3, n), rng.normal(0, 1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(feature % 5 - 2) * x - t))).astype(int)
    df = spark.createDataFrame([(f"f{f:02d}", float(a), float(b), int(c)) for f, a, b, c in zip(feature, x, t, y)], "f string, x double, t double, y int")
    got = {r.term: r.value for r in fits.logistic_effects(df, "f", "x", "y", ["t"], penalty=0.003).collect()}
    want = dense_logistic(x, np.stack([t, np.ones(n)], 1), y, feature, count, 0.003)
    names = [*[f"f{k:02d}" for k in range(count)], "t", "intercept"]
    assert got == pytest.approx(dict(zip(names, want)), abs=1e-7)


def test_absolute_penalty_drops_slopes(spark):
    rng = np.random.default_rng(9)
    n = 600
    feature, x = rng.integers(0, 6, n), rng.normal(0, 1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-np.where(feature < 2, 2.0, 0.0) * x))).astype(int)
    df = spark.createDataFrame([(f"f{f}", float(a), int(c)) for f, a, c in zip(feature, x, y)], "f string, x double, y int")
    got = {r.term: r.value for r in fits.logistic_effects(df, "f", "x", "y", [], penalty=0.02, l1_share=1.0, tolerance=1e-7).collect()}
    p = 1 / (1 + np.exp(-np.array([got[f"f{f}"] for f in feature]) * x - got["intercept"]))
    assert abs((p - y).mean()) < 1e-6
    for f in range(6):
        pull = ((p - y) * x)[feature == f].sum() / n
        b = got[f"f{f}"]
        assert abs(pull + 0.02 * np.sign(b)) < 1e-6 if b else abs(pull) <= 0.02 + 1e-6
    assert got["f0"] > 0.5 and sum(not got[f"f{f}"] for f in range(2, 6)) >= 2


def exact_fisher(a, b, c, d):
    """Exact rational arithmetic by ratios from the observed cell, in 60 digits."""
    decimal.getcontext().prec = 60
    top, bottom, left = a + b, c + d, a + c
    low, high = max(0, left - bottom), min(top, left)
    weight, whole, tail, cut = decimal.Decimal(1), decimal.Decimal(0), decimal.Decimal(0), decimal.Decimal(1) + decimal.Decimal("1e-7")
    for step in (1, -1):
        k, w = a, weight
        while low <= k <= high and w > decimal.Decimal("1e-30") * max(whole, 1):
            if not (step == -1 and k == a):
                whole += w
                tail += w if w <= cut else 0
            up = decimal.Decimal((top - k) * (left - k)) / decimal.Decimal((k + 1) * (bottom - left + k + 1)) if step == 1 else None
            down = decimal.Decimal(k * (bottom - left + k)) / decimal.Decimal((top - k + 1) * (left - k + 1)) if step == -1 else None
            w *= up if step == 1 else down
            k += step
    return float(tail / whole)


@pytest.mark.parametrize(
    "cells",
    [(3, 1, 1, 3), (0, 5, 5, 0), (0, 0, 3, 4), (7, 0, 0, 0), (10, 90, 30, 70), (1, 9, 11, 3), (200, 300, 250, 260), (5, 0, 0, 9),
     (2_000, 3_000, 1_900, 3_200), (120_000, 130_000, 119_000, 131_500), (1, 999_999, 12, 999_988)],
)
def test_fisher_equals_exact_arithmetic(spark, cells):
    df = spark.createDataFrame([(1, *cells)], "k int, a long, b long, c long, d long")
    assert ranktests.fisher_exact(df, ["k"], "a", "b", "c", "d").first()["p_value"] == pytest.approx(exact_fisher(*cells), rel=1e-9)


def test_fisher_of_margins_of_a_billion(spark):
    half = 500_000_000
    tables = [(half, half, half, half), (half + 9_000, half - 9_000, half - 9_000, half + 9_000), (half + 40_000, half - 40_000, half, half)]
    df = spark.createDataFrame([(k, *map(int, t)) for k, t in enumerate(tables)], "k int, a long, b long, c long, d long")
    out = {r.k: r.p_value for r in ranktests.fisher_exact(df, ["k"], "a", "b", "c", "d").collect()}
    assert len(out) == 3 and out[0] == 1.0
    for k in (1, 2):
        a, b, c, d = tables[k]
        n = a + b + c + d
        sd = math.sqrt((a + b) * (c + d) / n * (a + c) / n * (b + d) / (n - 1))
        z = (abs(a - (a + b) * (a + c) / n) - 0.5) / sd
        assert out[k] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0), (2, None, 1, 1, 1), (3, 2, 3, 1, 4)], "k int, a long, b long, c long, d long")
    out = {r.k: r.p_value for r in ranktests.fisher_exact(df, ["k"], "a", "b", "c", "d").collect()}
    assert set(out) == {2, 3} and out[2] is None and out[3] == pytest.approx(exact_fisher(2, 3, 1, 4))


def test_table_one_counts_missing_and_keeps_a_stratum_named_overall(spark):
    rows = [("overall", 1.0, "x"), ("overall", 3.0, None), ("b", None, "y"), ("b", 5.0, "x"), (None, 7.0, "x"), ("b", 9.0, "y"), ("overall", 2.0, "x")]
    df = spark.createDataFrame(rows, "g string, v double, c string").withColumn("gone", F.lit(None).cast("string"))
    out = summaries.summary_by_stratum(df, "g", ["v"], ["c", "gone"]).collect()
    number = {(r.is_overall, r.stratum): r for r in out if r.variable == "v"}
    assert {k: (r.n, r.n_missing, r.median) for k, r in number.items()} == {
        (True, "overall"): (6, 1, 4.0), (False, "overall"): (3, 0, 2.0), (False, "b"): (2, 1, 7.0), (False, None): (1, 0, 7.0),
    }
    assert len({r.p_value for r in number.values()}) == 1
    level = {(r.is_overall, r.stratum, r.level): r for r in out if r.variable == "c"}
    assert (level[True, "overall", "x"].n, level[True, "overall", "x"].n_missing) == (4, 1)
    assert level[False, "b", "y"].percent == pytest.approx(200 / 3) and level[False, "overall", "x"].n == 2
    # Expected counts are below five: the exact test of (2, 0) against (1, 2).
    assert [r.p_value for r in level.values()] == pytest.approx([exact_fisher(2, 0, 1, 2)] * len(level))
    gone = [r for r in out if r.variable == "gone"]
    assert {(r.is_overall, r.stratum, r.level, r.n, r.n_missing, r.p_value) for r in gone} == {
        (True, "overall", None, 0, 7, None), (False, "overall", None, 0, 3, None), (False, "b", None, 0, 3, None), (False, None, None, 0, 1, None),
    }


def test_table_one_p_values_are_those_of_the_tests(spark):
    rng = np.random.default_rng(3)
    rows = [("s" + str(k % 2), float(rng.normal(k % 2, 1)), "lmn"[rng.integers(3)]) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, c string")
    out = summaries.summary_by_stratum(df, "g", ["v"], ["c"]).collect()
    want = ranktests.wilcoxon_ranksum(df.withColumn("second", F.col("g") == "s1"), "second", ["v"]).first().p_value
    assert all(r.p_value == pytest.approx(want) for r in out if r.variable == "v")
    cells = df.groupBy(F.lit("c").alias("variable"), "g", "c").agg(F.count(F.lit(1)).alias("n"))
    want = ranktests.chi_square(cells, ["variable"], "g", "c", "n").first().p_value
    assert all(r.p_value == pytest.approx(want) for r in out if r.variable == "c")


def test_effects_of_both_transforms_are_one_scoring_step(spark):
    rng = np.random.default_rng(2)
    cells = [(s, f"f{f}", int(rng.integers(1, 60) * (1 + (f == 0) * (s % 2)))) for s in range(60) for f in range(3)]
    counts = spark.createDataFrame(cells, "sample int, feature string, n long")
    outcomes = spark.createDataFrame([(s, "AB"[s % 3 == 0], float(s % 2)) for s in range(60)], "sample int, cohort string, y double")
    tables = transform_effects(counts, outcomes, "sample", "feature", "n", "cohort", "y", {"q50": 0.5, "q95": 0.95})
    n = np.array([c[2] for c in cells], float).reshape(60, 3)
    y = np.arange(60) % 2
    forms = {"Scaled": (n - n.mean()) / n.std(ddof=1), "CLR Transformed": np.log(n) - np.log(n).mean(1, keepdims=True)}
    for form, x in forms.items():
        got = {(r.feature, r.cohort): r for r in tables[form].collect()}
        assert len(got) == 9
        for cohort, rows in (("Pooled", np.arange(60)), ("B", np.arange(0, 60, 3))):
            for f in range(3):
                a, b = x[rows, f], y[rows].astype(float)
                curve = b.mean() * (1 - b.mean()) * a.var()
                effect = ((a - a.mean()) * (b - b.mean())).mean() / curve
                r = got[f"f{f}", cohort]
                assert (r.q50, r.q95 - r.q50) == pytest.approx((effect, 1.6448536269514722 / math.sqrt(len(rows) * curve)))
