import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import groups, ranks


@pytest.fixture(params=["one bucket", "many buckets", "many buckets, no broadcast"])
def bucketed(request, monkeypatch):
    if request.param != "one bucket":
        if "no broadcast" in request.param:
            monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ranks, "SMALL_TABLE", 10)
        monkeypatch.setattr(ranks, "SAMPLE_PER_BUCKET", 8)


def skewed(spark):
    random.seed(3)
    rows = [("hot", float(random.randint(0, 30)), i) for i in range(400)]
    rows += [(f"g{i % 7}", random.random() * 50, i) for i in range(400, 700)]
    rows += [("none", None, 700)] + [(None, float(i % 9), 701 + i) for i in range(60)]
    return spark.createDataFrame(rows, "g string, v double, id int")


def test_positions_match_sorting(spark, bucketed):
    df = skewed(spark)
    placed = ranks.with_position(df, ["g"], [F.col("v"), F.col("id")]).collect()
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append((r.v is not None, r.v, r.id))
    want = {(g, key[2]): i + 1 for g, keys in by_group.items() for i, key in enumerate(sorted(keys, key=lambda k: (k[0], k[1] or 0, k[2])))}
    assert {(r.g, r.id): r.position for r in placed} == want


def test_positions_over_whole_table_with_text_key(spark, bucketed):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = groups.first_distinct_index(df, "name", "num").collect()
    assert {r.name: r.num for r in got} == {n: i + 1 for i, n in enumerate(sorted(set(names)))}


def test_two_level_buckets():
    cuts = list(range(0, 1000, 5))
    assert len(cuts) > ranks.FAN_OUT


def test_bucket_of_counts_cuts_at_or_below(spark):
    cuts = [float(c) for c in range(0, 1000, 5)]
    df = spark.range(-3, 1003).select(F.col("id").cast("double").alias("x"))
    out = df.select("x", ranks.bucket_of(F.col("x"), cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.x for c in cuts) for r in out)


def test_quantiles_match_numpy(spark, bucketed):
    df = skewed(spark)
    probs = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.8, "f": 1.0}
    got = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "v", probs).collect()}
    values = {}
    for r in df.where("v is not null").collect():
        values.setdefault(r.g, []).append(r.v)
    assert set(got) == set(values)
    for g, v in values.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(v, p))


def test_quantiles_of_whole_table(spark, bucketed):
    df = skewed(spark)
    values = [r.v for r in df.collect() if r.v is not None]
    got = ranks.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert got.m == pytest.approx(np.quantile(values, 0.5))


def test_running_breaks_leaves_out_the_last(spark, bucketed):
    rows = [("p", s, d) for s, days in ((1, 2), (2, 3), (5, 1)) for d in range(days)]
    df = spark.createDataFrame(rows, "cohort string, subject int, day int")
    got = sorted((r.subject, r.linebreak) for r in groups.running_breaks(df, "cohort", "subject").collect())
    assert got == [(1, 2.5), (2, 5.5)]


def test_baseline_conflict_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 0, 6.0)], "s int, day int, v double")
    with pytest.raises(Exception, match="more than one baseline"):
        groups.baseline_broadcast(df, "s", F.col("day") == 0, F.col("v"), "base", 0.5).collect()


def test_exact_kinds_drops_repeats_and_extras(spark):
    rows = [(1, "AN"), (1, "ET"), (2, "AN"), (2, "AN"), (2, "ET"), (3, "AN"), (4, "AN"), (4, "ET"), (4, "XX")]
    df = spark.createDataFrame(rows, "s int, kind string")
    assert {r.s for r in groups.exact_kinds(df, ["s"], "kind", ["AN", "ET"]).collect()} == {1}


def test_event_near_flag_stays_inside_the_subject(spark):
    rows = [(1, 0, False, True), (1, 1, False, False), (1, 2, True, False), (2, 0, True, False), (2, 5, True, False), (2, 9, False, False), (2, 12, False, True)]
    df = spark.createDataFrame(rows, "s int, day int, hit boolean, fever boolean")
    out = groups.event_near_flag(df, "s", "day", F.col("hit"), F.col("fever"), 2, "near").collect()
    assert {(r.s, r.day) for r in out if r.near} == {(1, 2), (2, 5)}


def test_split_points_of_composite_keys_leave_out_those_with_nulls(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL_TABLE", 1)
    rows = [(None, "root"), *[(f"p{i % 3}", f"n{i:02d}") for i in range(40)]]
    df = spark.createDataFrame(rows, "parent string, node string")
    out = ranks.with_position(df, [], [F.col("parent"), F.col("node")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r))
    assert {r.node: r.position for r in out} == {node: i for i, (_, node) in enumerate(want, 1)}
