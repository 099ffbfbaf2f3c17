"""Counter-examples: thinned chains, far tails, constant, empty, null and single rows, doubled rows."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.labels import number_text
from cohortlake.functions.normal import chi_square_p
from cohortlake.operators import distances, fits, frames, ordination, pairs, posterior, ranktests, skew, summaries, tree


def fisher_by_hand(a, b, c, d):
    def lp(k):
        lg = math.lgamma
        return (
            lg(a + b + 1) + lg(c + d + 1) + lg(a + c + 1) + lg(b + d + 1) - lg(a + b + c + d + 1)
            - lg(k + 1) - lg(a + b - k + 1) - lg(a + c - k + 1) - lg(d - a + k + 1)
        )

    seen = lp(a)
    return sum(math.exp(lp(k)) for k in range(max(0, a - d), min(a + b, a + c) + 1) if lp(k) <= seen + 1e-7)


@pytest.mark.parametrize("cells", [(3, 7, 7, 999_983), (5, 5, 5, 999_985), (100, 2, 3, 90), (0, 0, 0, 4)])
def test_fisher_far_from_the_mean(spark, cells):
    df = spark.createDataFrame([(1, *cells)], "k int, a long, b long, c long, d long")
    p = ranktests.fisher_exact(df, ["k"], "a", "b", "c", "d").first()["p_value"]
    assert p == pytest.approx(min(1.0, fisher_by_hand(*cells)), rel=1e-5) and p > 0


@pytest.mark.parametrize(("x", "dof", "p"), [(2000.0, 2000, 0.4958), (1600.0, 1600, 0.4953), (1999.0, 1999, 0.4958), (0.0, 4, 1.0), (3.841459, 1, 0.05), (5.991465, 2, 0.05)])
def test_chi_square_tail(spark, x, dof, p):
    df = spark.createDataFrame([(x, dof)], "x double, dof long")
    assert df.select(chi_square_p("x", "dof").alias("p")).first()["p"] == pytest.approx(p, abs=2e-4)


def thinned(spark, step):
    rows = [("a", c, i * step, math.sin(i * 1.7 + c) + c * 0.1) for c in range(2) for i in range(1, 201)]
    return spark.createDataFrame(rows, "param string, chain int, iter int, draw double")


def test_only_positions_of_draws_count(spark):
    for measure in (posterior.split_rhat, posterior.rank_rhat, posterior.effective_size):
        assert measure(thinned(spark, 5)).first() == measure(thinned(spark, 1)).first()


def test_energy_steps_over_gaps(spark):
    values = [math.sin(i * 0.37) * 3 + i % 7 for i in range(4100)]
    seen = set()
    for step in (1, 10, 1000):
        df = spark.createDataFrame([(0, i * step, v) for i, v in enumerate(values)], "chain int, iter long, energy double")
        seen.add(round(posterior.energy_fraction(df).first()["e_bfmi"], 9))
    mean = sum(values) / len(values)
    var = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
    steps = sum((b - a) ** 2 for a, b in zip(values, values[1:], strict=False))
    assert seen == {round(steps / len(values) / var, 9)}


def test_effective_size_stays_positive_and_null_without_spread(spark):
    rows = [("swing", 0, i, (-1.0) ** i + 0.01 * i) for i in range(1, 41)] + [("flat", 0, i, 2.0) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "param string, chain int, iter int, draw double")
    found = {r.param: r.n_eff for r in posterior.effective_size(df).collect()}
    assert found["swing"] > 0 and found["flat"] is None


def test_interval_of_one_draw(spark):
    df = spark.createDataFrame([("one", 1, 3.0), ("two", 1, 1.0), ("two", 2, 4.0)], "p string, i int, draw double")
    got = {r.p: (r.hpdi_low, r.hpdi_high) for r in posterior.hpdi(df, ["p"], "draw", 0.9, [F.col("i")]).collect()}
    assert got == {"one": (3.0, 3.0), "two": (1.0, 4.0)}


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([("a", 1e9), ("a", 1e-9), ("a", 10.0), (None, 10.0)], "g string, v double")
    rows = summaries.histogram_log10(df, ["g"], "v", 0.0, 1.0, 3).collect()
    assert {(r.g, r.bin): r.n for r in rows if r.n} == {("a", -1): 1, ("a", 1): 1, ("a", 3): 1, (None, 1): 1}
    assert len(rows) == 8


def test_density_of_constant_and_single_groups(spark):
    df = spark.createDataFrame([("c", 2.0)] * 5 + [("s", 0.0), ("n", None), ("v", 1.0), ("v", 3.0)], "g string, v double")
    rows = summaries.density_grid(df, ["g"], "v", 8, 16).collect()
    assert {r.g for r in rows} == {"c", "s", "v"} and all(r.density is not None and r.density >= 0 for r in rows)


def test_rank_sum_without_a_test(spark):
    rows = [(True, 1.0, float(i)) for i in range(4)] + [(False, 1.0, i + 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "g boolean, same double, x double")
    found = {r.variable: r.p_value for r in ranktests.wilcoxon_ranksum(df, "g", ["same", "x"]).collect()}
    assert found["same"] is None and 0 < found["x"] <= 1
    assert ranktests.wilcoxon_ranksum(df.where("g"), "g", ["x"]).first()["p_value"] is None


def test_small_numbers_keep_their_value(spark):
    df = spark.createDataFrame([(3e-12,), (0.25,), (0.0,), (-1e-9,), (1200.0,)], "x double")
    assert [r[0] for r in df.select(number_text("x")).collect()] == ["3E-12", "0.25", "0", "-1E-9", "1200"]


def test_null_keys_in_a_complete_grid(spark):
    df = spark.createDataFrame([(None, "x", 5), ("a", "y", 1)], "l string, r string, n int")
    rows = {(r.l, r.r): r.n for r in frames.complete_grid(df, ["l"], ["r"], "n", 0).collect()}
    assert rows == {(None, "x"): 5, (None, "y"): 0, ("a", "x"): 0, ("a", "y"): 1}


def test_a_group_called_overall(spark):
    df = spark.createDataFrame([("overall", 1.0, 2.0), ("overall", 2.0, 4.0), ("b", 1.0, 0.0)] + [("b", 2.0, 1.0)] * 2, "g string, x double, y double")
    assert sorted((r.g, r.n) for r in fits.linear_fit(df, "g", "x", "y").collect()) == [("b", 3), ("overall", 2), ("overall", 5)]


def test_roots_without_a_row_and_circles(spark):
    df = spark.createDataFrame([("b", "a", 1.0), ("c", "b", 2.0)], "n string, p string, len double")
    found = {r.node: (r.depth, r.path_length) for r in tree.node_depths(df, "n", "p", "len").collect()}
    assert found == {"a": (0, 0.0), "b": (1, 1.0), "c": (2, 3.0)}
    circle = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("r", None, 0.0)], "n string, p string, len double")
    with pytest.raises(ValueError, match="circle"):
        tree.node_depths(circle, "n", "p", "len")


def test_doubled_rows_and_linear_copies(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "b", 1), ("t", "a", 1)], "s string, f string, n int")
    assert distances.jaccard_binary(df, "s", "f", "n").first()["dist"] == 0.5
    assert distances.jaccard_weighted(df, "s", "f", "n").first()["dist"] == pytest.approx(2 / 3)
    for rows in (10**6, 10**9, 10**12):
        blocks, slices = pairs.tile_plan(rows, 5000, 10, 8)
        assert blocks <= 5 or blocks == pairs.tile_plan(10**6, 5000, 10, 8)[0]
        assert 2 * rows / blocks / slices <= pairs.TILE_ROWS


def test_permanova_of_labels_and_pairs_that_differ(spark):
    points = {f"s{i}": (i % 3) * 1.0 + (i >= 6) * 2.0 + i * 0.1 for i in range(12)}
    rows = [(a, b, abs(points[a] - points[b])) for a in points for b in points if a < b]
    dist = spark.createDataFrame(rows, "a string, b string, dist double")
    labels = spark.createDataFrame([(s, int(s[1:]) >= 6) for s in points], "sample string, g boolean")
    some = labels.where("sample NOT IN ('s0', 's11')")
    inner = dist.where("a NOT IN ('s0', 's11') AND b NOT IN ('s0', 's11')")
    want = ordination.permanova(inner, some, "sample", "g", 19).first()
    assert ordination.permanova(dist, some, "sample", "g", 19).first() == want
    assert ordination.permanova(inner, labels, "sample", "g", 19).first() == want and want["samples"] == 10
    single = ordination.permanova(dist, labels.withColumn("g", F.lit(True)), "sample", "g", 9).first()
    assert single["pseudo_f"] is None


def test_salted_joins_refuse_unmatched_keyed_rows(spark):
    big = spark.range(400).withColumn("k", F.when(F.col("id") < 300, 1).otherwise(F.col("id")))
    keyed = big.select("k").distinct()
    with pytest.raises(ValueError, match="unmatched"):
        skew.skew_join(big, keyed, ["k"], "full", broadcast_rows=5)
