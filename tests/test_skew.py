import itertools

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import frames, skew


def hot_rows(spark):
    """A third of the rows under one key, one null key, the rest spread."""
    rows = [(1, i) for i in range(100)] + [(2 + i % 40, i) for i in range(190)] + [(None, i) for i in range(10)]
    return spark.createDataFrame(rows, "k int, v int")


@pytest.mark.parametrize("limit", [0, 50_000])
def test_attach_stats_same_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    df = hot_rows(spark)
    out = skew.attach_stats(df, ["k"], total=F.sum("v"), n=F.count(F.lit(1)))
    got = sorted((r.k if r.k is not None else -1, r.v, r.total, r.n) for r in out.collect())
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.v)
    expected = sorted(
        (r.k if r.k is not None else -1, r.v, sum(want[r.k]), len(want[r.k])) for r in df.collect()
    )
    assert got == expected


def test_hot_keys_are_the_large_ones(spark):
    sizes = hot_rows(spark).groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    hot = skew.hot_keys(sizes, 4).collect()
    assert [(r.k, r._salts) for r in hot] == [(1, 2)]
    even = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("_rows"))
    assert skew.hot_keys(even, 4) is None


@pytest.mark.parametrize("how,rows", [("inner", 100), ("left", 300)])
def test_salted_join_keeps_rows(spark, monkeypatch, how, rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    labels = spark.createDataFrame([(1, "hot")], "k int, label string")
    out = skew.skew_join(hot_rows(spark), labels, ["k"], how)
    assert out.count() == rows
    assert out.where("label = 'hot'").count() == 100
    assert out.columns == ["k", "v", "label"]


def test_melted_pairs_are_not_shuffled_for_their_labels(spark, monkeypatch):
    """However many labels there are, as long as their bytes fit a broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    names = [f"s{k}" for k in range(6)]
    listed = [(a, b, float(i)) for i, (a, b) in enumerate(itertools.combinations(names, 2))]
    pairs = spark.createDataFrame(listed, "a string, b string, dist double")
    labels = spark.createDataFrame([(n, f"nation {n[1:]}") for n in names[:5]] + [("s0", "twice")], "sample string, nation string")
    out = frames.matrix_melt(pairs, labels, "sample", "nation", "dist", 0.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    called = {n: [f"nation {n[1:]}"] for n in names[:5]} | {"s5": [None]}
    called["s0"].append("twice")
    square = [*listed, *[(b, a, d) for a, b, d in listed], *[(n, n, 0.0) for n in [*names[:5], "s0"]]]
    want = [(a, b, d, x, y) for a, b, d in square for x in called[a] for y in called[b]]
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in out.select("x", "y", "dist", "nation_x", "nation_y").collect()), key=order) == sorted(want, key=order)


def test_keep_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    out = skew.keep_groups(hot_rows(spark), ["k"], F.count(F.lit(1)) > 9)
    assert {r.k for r in out.select("k").distinct().collect()} == {1, None}
    assert out.count() == 110


def test_one_row_fails_on_two(spark):
    two = spark.range(2)
    with pytest.raises(Exception):
        skew.with_one_row(spark.range(3), two).collect()
