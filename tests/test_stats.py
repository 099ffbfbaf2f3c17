import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import normal
from cohortlake.functions import labels as L
from cohortlake.operators import fits, frames, posterior, ranktests, summaries, transforms
from cohortlake.plans.design import design_matrix


def column(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_normal_tails_and_quantiles(spark):
    z = [0.0, 0.3, 1.0, 1.96, 3.5, 6.0]
    out = column(spark, z, "z").select("z", normal.two_sided_p("z").alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=3e-7) for r in out)
    p = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    out = column(spark, p, "p").select("p", normal.normal_quantile("p").alias("q")).collect()
    assert all(r.q == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-8) for r in out)


def test_log_factorial(spark):
    n = [0, 1, 2, 5, 9, 10, 11, 50, 1000, 10**9]
    df = spark.createDataFrame([(v,) for v in n], "n long").select("n", normal.log_factorial(F.col("n")).alias("l"))
    assert all(r.l == pytest.approx(math.lgamma(r.n + 1), rel=1e-12, abs=1e-12) for r in df.collect())


def test_chi_square_tail(spark):
    # Critical values at 5 percent (fixed values).
    rows = [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (9.487729036781154, 4), (19.67513757268249, 11)]
    df = spark.createDataFrame(rows, "s double, k long").withColumn("p", normal.chi_square_p("s", "k"))
    assert all(r.p == pytest.approx(0.05, rel=1e-6) for r in df.collect())


def test_rank_sum_with_ties(spark):
    first, second = [1, 2, 2, 3, 5, 5], [2, 4, 5, 6, 6]
    df = spark.createDataFrame([(False, float(v)) for v in first] + [(True, float(v)) for v in second], "g boolean, v double")
    out = ranktests.wilcoxon_ranksum(df, "g", ["v"]).first()
    w = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    ties = sum(t**3 - t for t in (3, 3, 2))
    sigma = math.sqrt(30 / 12 * (12 - ties / 110))
    z = (w - 15 + 0.5) / sigma
    assert (out.n_first, out.n_second, out.w) == (6, 5, w)
    assert out.z == pytest.approx(z)
    assert out.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def fisher_by_hand(a, b, c, d):
    n, r1, c1 = a + b + c + d, a + b, a + c
    weight = {k: math.comb(r1, k) * math.comb(n - r1, c1 - k) for k in range(max(0, c1 - (n - r1)), min(r1, c1) + 1)}
    return sum(w for w in weight.values() if w * 10**7 <= weight[a] * (10**7 + 1)) / math.comb(n, c1)


def test_fisher_exact(spark):
    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (40, 60, 55, 45), (7, 0, 0, 0), (900, 1000, 1100, 1000)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    out = {r.i: r.p_value for r in ranktests.fisher_exact(df, ["i"], "a", "b", "c", "d").collect()}
    assert out == pytest.approx({i: fisher_by_hand(*t) for i, t in enumerate(tables)}, rel=1e-8)


def test_clr_and_shannon(spark):
    df = spark.createDataFrame([("s", "a", 0), ("s", "b", 10), ("s", "c", 30), ("t", "a", 5)], "sample string, f string, n long")
    out = {(r["sample"], r.f): r.clr for r in transforms.clr(df, "sample", "n", "clr").collect()}
    assert sum(v for (s, _), v in out.items() if s == "s") == pytest.approx(0)
    assert out["s", "b"] == pytest.approx(math.log(10) - (math.log(10) + math.log(30)) / 3)
    h = {r["sample"]: r.shannon for r in transforms.shannon(df, "sample", "n").collect()}
    assert h == pytest.approx({"s": -(0.25 * math.log(0.25) + 0.75 * math.log(0.75)), "t": 0.0})


def test_zscore_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double")
    out = summaries.zscore(df, {"x": "x", "y": "y"}).collect()
    assert sorted(r.x for r in out) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    assert all(r.y is None for r in out)


def test_density_integrates_to_about_one(spark):
    values = np.random.default_rng(3).normal(size=800)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    out = summaries.density_grid(df, ["g"], "v", 101, 400).orderBy("point").collect()
    x, y = [r.x for r in out], [r.density for r in out]
    assert np.trapezoid(y, x) == pytest.approx(1, abs=0.02)


def test_key_grid_opens_chunks(spark, monkeypatch):
    monkeypatch.setattr(frames, "GRID_CHUNK", 3)
    left = spark.range(4).select(F.col("id").alias("a"))
    right = spark.range(10).select(F.col("id").alias("b"))
    got = frames.key_grid(left, right).collect()
    assert len(got) == 40 and {(r.a, r.b) for r in got} == {(a, b) for a in range(4) for b in range(10)}


def test_labels(spark):
    df = spark.createDataFrame([("beta[7]", None, 1), (None, "x", 123)], "t string, u string, n int")
    out = df.select(
        L.first_number("t").alias("num"),
        L.matches("t", "BETA", ignore_case=True).alias("hit"),
        L.compose("t", F.lit("/"), "u").alias("label"),
        L.pad_left("n", 2).alias("pad"),
        L.number_text(L.signif(F.col("n") / 7.0, 2)).alias("s"),
    ).collect()
    assert [tuple(r) for r in out] == [(7.0, True, "beta[7]/NA", "01", "0.14"), (None, False, "NA/x", "123", "18")]


# --- draws ---------------------------------------------------------------------------------


def ess_by_hand(chains):
    m, n = chains.shape
    centered = chains - chains.mean(axis=1, keepdims=True)
    acov = np.array([(centered[:, : n - lag] * centered[:, lag:]).sum(axis=1).mean() / n for lag in range(n)])
    within = chains.var(axis=1, ddof=1).mean()
    total = (n - 1) / n * within + chains.mean(axis=1).var(ddof=1)
    rho = 1 - (within - acov) / total
    rho[0] = 1
    low, held = math.inf, 0.0
    for k in range(n // 2):
        low = min(low, rho[2 * k] + rho[2 * k + 1])
        if low <= 0:
            break
        held += low
    return m * n / (2 * held - 1)


def ar_chains(rng, m, n, phi):
    out = np.zeros((m, n))
    noise = rng.standard_normal((m, n))
    for t in range(1, n):
        out[:, t] = phi * out[:, t - 1] + noise[:, t]
    return out


def as_draws(spark, **params):
    rows = [(p, c, t + 1, float(v)) for p, chains in params.items() for c, row in enumerate(chains) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "param string, chain int, iter long, draw double")


def test_effective_size_over_many_lags_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(posterior, "LAG_BLOCK", 50)
    rng = np.random.default_rng(9)
    slow, fast = ar_chains(rng, 3, 400, 0.97), ar_chains(rng, 3, 400, 0.1)
    out = {r.param: r.n_eff for r in posterior.effective_size(as_draws(spark, slow=slow, fast=fast), first_lags=8).collect()}
    assert out == pytest.approx({"slow": ess_by_hand(slow), "fast": ess_by_hand(fast)})


def test_rhat_of_equal_chains_is_near_one(spark):
    chain = np.random.default_rng(1).standard_normal(200)
    far = np.stack([chain, chain + 5])
    out = {r.param: r.rhat for r in posterior.split_rhat(as_draws(spark, same=np.stack([chain] * 3), far=far)).collect()}
    assert out["same"] == pytest.approx(1, abs=0.03)
    assert out["far"] > 2
    ranked = {r.param: r.rhat for r in posterior.rank_rhat(as_draws(spark, far=far)).collect()}
    assert ranked["far"] > 1.5


def dense_spread(groups):
    """Draws, groups, pooled variance within and weighted variance between; every draw counts once."""
    sizes = np.array([len(g) for g in groups], float)
    means = np.array([g.mean() for g in groups])
    grand = np.concatenate(groups).mean()
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (sizes - 1).sum()
    between = (sizes * (means - grand) ** 2).sum() / sizes.mean() / (len(groups) - 1)
    n, m = sizes.sum(), len(groups)
    return n, within, (n - m) / n * within + between


def dense_rhat(chains):
    halves = [h for c in chains for h in (c[: len(c) // 2], c[len(c) // 2 :])]
    _, within, total = dense_spread(halves)
    return math.sqrt(total / within)


def dense_ess(chains):
    n, within, total = dense_spread(chains)
    centred = [c - c.mean() for c in chains]
    longest = max(map(len, chains))
    rho = [1.0]
    for lag in range(1, longest):
        products = sum(float(c[: len(c) - lag] @ c[lag:]) for c in centred if len(c) > lag)
        rho.append(1 - (within - products / n) / total)
    low, held = math.inf, 0.0
    for k in range(longest // 2):
        low = min(low, rho[2 * k] + rho[2 * k + 1])
        if low <= 0:
            break
        held += low
    return n / (2 * held - 1)


@pytest.mark.parametrize("block", [2048, 64])
def test_no_draw_of_unequal_chains_is_dropped(spark, monkeypatch, block):
    monkeypatch.setattr(posterior, "LAG_BLOCK", block)
    rng = np.random.default_rng(block)
    params = {
        name: [ar_chains(rng, 1, n, phi)[0] + shift * k for k, n in enumerate((200, 1000, 40))]
        for name, phi, shift in (("slow", 0.97, 0.0), ("fast", 0.2, 0.0), ("apart", 0.5, 1.0))
    }
    params["odd"] = [rng.standard_normal(n) for n in (7, 1, 21)]
    df = as_draws(spark, **params)
    sizes = {r.param: r for r in posterior.effective_size(df, first_lags=8).collect()}
    assert {p: r.n_eff for p, r in sizes.items()} == pytest.approx({p: dense_ess(c) for p, c in params.items()})
    assert {p: (r.chains, r.draws) for p, r in sizes.items()} == {p: (3, sum(map(len, c))) for p, c in params.items()}
    wide = {p: c for p, c in params.items() if p != "odd"}
    scale = {r.param: r.rhat for r in posterior.split_rhat(df).collect()}
    assert {p: scale[p] for p in wide} == pytest.approx({p: dense_rhat(c) for p, c in wide.items()})
    summary = {r.param: r for r in posterior.draw_summary(df, {"q50": 0.5}).collect()}
    for p, chains in wide.items():
        every = np.concatenate(chains)
        want = (every.mean(), every.std(ddof=1), every.std(ddof=1) / math.sqrt(dense_ess(chains)), np.median(every))
        assert (summary[p]["mean"], summary[p].sd, summary[p].se_mean, summary[p].q50) == pytest.approx(want)


def test_rank_rhat_of_unequal_chains_equals_a_dense_one(spark):
    rng = np.random.default_rng(2)
    chains = [np.r_[rng.standard_normal(60), rng.standard_normal(400) + 6], rng.standard_normal(60)]
    every = np.concatenate(chains)
    ranks = every.argsort().argsort() + 1.0
    scores = np.array([statistics.NormalDist().inv_cdf(p) for p in (ranks - 0.375) / (len(every) + 0.25)])
    out = {r.param: r.rhat for r in posterior.rank_rhat(as_draws(spark, p=chains)).collect()}
    assert out["p"] == pytest.approx(dense_rhat(np.split(scores, [len(chains[0])])), rel=1e-7)


def test_hpdi_of_ten_draws(spark):
    draws = [0.0, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 5.0, 9.0]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(draws)], "param string, iter int, draw double")
    out = posterior.hpdi(df, ["param"], "draw", 0.6, [F.col("iter")]).first()
    # A gap of six places: 1.0 to 1.6 is the shortest.
    assert (out.hpdi_low, out.hpdi_high) == (1.0, 1.6)


def test_energy_steps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(posterior, "LAG_BLOCK", 7)
    energy = np.random.default_rng(5).standard_normal(50).cumsum()
    df = spark.createDataFrame([(1, i + 1, float(e)) for i, e in enumerate(energy)], "chain int, iter long, energy double")
    out = posterior.energy_fraction(df).first()
    assert out.e_bfmi == pytest.approx((np.diff(energy) ** 2).sum() / 50 / energy.var(ddof=1))


# --- fits ----------------------------------------------------------------------------------


def test_logistic_effects_gradient_is_zero(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        f = f"f{i % 5}"
        x, t = rng.standard_normal(2)
        p = 1 / (1 + math.exp(-(0.8 * (i % 5 - 2) * x + 0.5 * t - 0.2)))
        rows.append((f, float(x), float(t), int(rng.random() < p)))
    df = spark.createDataFrame(rows, "f string, x double, t double, y int")
    fitted = fits.logistic_effects(df, "f", "x", "y", ["t"], penalty=0.01)
    value = {r.term: r.value for r in fitted.collect()}
    assert set(value) == {"f0", "f1", "f2", "f3", "f4", "t", "intercept"}
    gradient = dict.fromkeys(value, 0.0)
    for f, x, t, y in rows:
        miss = 1 / (1 + math.exp(-(value[f] * x + value["t"] * t + value["intercept"]))) - y
        gradient[f] += miss * x / len(rows)
        gradient["t"] += miss * t / len(rows)
        gradient["intercept"] += miss / len(rows)
    for term in value:
        penalty = 0 if term == "intercept" else 0.01 * value[term]
        assert gradient[term] + penalty == pytest.approx(0, abs=1e-5)


def test_horseshoe_needs_sensible_expectation(spark):
    with pytest.raises(ValueError):
        fits.horseshoe_scale(spark.range(1), ["id"], 10, 10, 5)


def test_design_drops_flat_columns_and_unseen_features(spark):
    cells = [(s, f, n) for s in range(6) for f, n in (("a", s), ("b", 4), ("c", s * s), ("never", 0))]
    counts = spark.createDataFrame(cells, "sample int, feature string, n long")
    outcomes = spark.createDataFrame([(s, s % 2, "in" if s < 5 else "out") for s in range(6)], "sample int, y int, cohort string")
    rows, flat = design_matrix(counts, outcomes, F.col("cohort") == "in", {"b": "fix_b", "a": "fix_a"})
    out = rows.collect()
    assert flat == ["fix_b"] and "fix_b" not in rows.columns
    assert {r.feature for r in out} == {"c"} and {r.feature_num for r in out} == {1} and len(out) == 5
    assert sum(r.x for r in out) == pytest.approx(0)
