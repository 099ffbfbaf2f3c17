"""List ranking, tip intervals, distances on trees and ordination with absent pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import distances, listrank, ordination, ranks, skew, tree
from cohortlake.session import local_session, materialize, release, sized, written  # noqa: F401


@pytest.mark.parametrize("block", [1 << 18, 16])
def test_rank_list(spark, monkeypatch, block):
    monkeypatch.setattr(listrank, "BLOCK", block)
    rng = np.random.default_rng(block)
    order = rng.permutation(300) * 7
    weights = rng.integers(0, 9, 300)
    links = [(int(a), int(b), int(w)) for a, b, w in zip(order, [*order[1:], 10_000], weights)]
    df = spark.createDataFrame(links, "item long, next long, weight long").repartition(5)
    got = {r.item: (r.before, r.total) for r in listrank.rank_list(df).collect()}
    before = np.cumsum(weights) - weights
    assert got == {int(i): (int(b), int(weights.sum())) for i, b in zip(order, before)}


@pytest.mark.parametrize("block", [1 << 18, 2])
def test_circles_and_second_lists_raise(spark, monkeypatch, block):
    monkeypatch.setattr(listrank, "BLOCK", block)
    circle = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "item long, next long, weight long")
    with pytest.raises(Exception, match="circle"):
        listrank.rank_list(circle).collect()
    assert listrank.rank_list(circle.limit(0)).count() == 0
    if block > 2:
        two = spark.createDataFrame([(1, 9, 1), (2, 8, 1)], "item long, next long, weight long")
        with pytest.raises(ValueError, match="more than one"):
            listrank.rank_list(two)


def random_tree(rng, tips):
    """Edges (node, parent, length, tip) of a tree of random shape."""
    open_nodes, edges, count = [f"t{k}" for k in range(tips)], [], 0
    tip_of = {f"t{k}": k for k in range(tips)}
    while len(open_nodes) > 1:
        some = [open_nodes.pop(rng.integers(len(open_nodes))) for _ in range(min(len(open_nodes), int(rng.integers(2, 4))))]
        name = f"n{count}"
        count += 1
        edges += [(c, name, float(rng.integers(1, 9)) / 8, tip_of.get(c)) for c in some]
        open_nodes.append(name)
    return [*edges, (open_nodes[0], None, 0.0, None)]


def above(edges):
    parent = {n: p for n, p, _, _ in edges}
    out = {}
    for n, _, _, tip in edges:
        if tip is not None:
            at, path = n, []
            while at is not None:
                path.append(at)
                at = parent.get(at)
            out[tip] = path
    return out


def dense_unifrac(counts, edges, weighted):
    paths, length = above(edges), {n: l or 0.0 for n, _, l, _ in edges}
    samples = sorted({s for s, _, _ in counts})
    mass = {s: {} for s in samples}
    whole = {s: sum(c for t, _, c in counts if t == s) for s in samples}
    seen = {f for _, f, c in counts if c}
    reach = {b: sum(b in paths[f] for f in seen) for b in length}
    for s, f, c in counts:
        for b in paths[f] if c else ():
            mass[s][b] = mass[s].get(b, 0.0) + c / whole[s]
    out = {}
    for i, a in enumerate(samples):
        for b in samples[i + 1 :]:
            x, y = mass[a], mass[b]
            every = set(x) | set(y)
            if weighted:
                up = sum(length[k] * abs(x.get(k, 0) - y.get(k, 0)) for k in every)
                down = sum(length[k] * (x.get(k, 0) + y.get(k, 0)) for k in every)
            else:
                every = {k for k in every if reach[k] < len(seen)}
                up = sum(length[k] for k in every if (k in x) != (k in y))
                down = sum(length[k] for k in every)
            out[a, b] = up / down
    return out


EDGE = "node string, parent string, length double, tip long"


@pytest.mark.parametrize("chunk", [1 << 21, 5])
def test_unifrac_equals_a_dense_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(distances, "BRANCH_CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    edges = random_tree(rng, 30)
    counts = [(s, int(f), int(rng.integers(1, 50))) for s in range(6) for f in rng.choice(28, 9, replace=False)] + [(0, 29, 0)]
    df = spark.createDataFrame(counts, "sample long, feature long, n long").repartition(3)
    table = spark.createDataFrame(edges, EDGE).repartition(2)
    for weighted, measure in ((True, distances.unifrac_weighted), (False, distances.unifrac_unweighted)):
        got = {(r.a, r.b): r.dist for r in measure(df, table, "sample", "feature", "n").collect()}
        assert got == pytest.approx(dense_unifrac([c for c in counts if c[2]], edges, weighted)), weighted


def test_unifrac_on_a_tree_as_deep_as_it_has_tips(spark):
    edges = [("i0", None, 0.0, None)]
    for k in range(400):
        edges += [(f"t{k}", f"i{k}", 0.5, k), (f"i{k + 1}", f"i{k}", 0.25, None)]
    counts = [(s, k, 1 + (k * (s + 3)) % 7) for s in range(3) for k in range(s, 400, 17 + s)]
    df = spark.createDataFrame(counts, "sample long, feature long, n long")
    got = {(r.a, r.b): r.dist for r in distances.unifrac_weighted(df, spark.createDataFrame(edges, EDGE), "sample", "feature", "n").collect()}
    assert got == pytest.approx(dense_unifrac(counts, edges, True))


def test_features_outside_the_tree(spark):
    edges = spark.createDataFrame(random_tree(np.random.default_rng(1), 8), EDGE)
    rows = [(s, f, 1 + s + f) for s in range(4) for f in range(4)]
    inside = spark.createDataFrame(rows, "sample long, feature long, n long")
    df = inside.unionByName(spark.createDataFrame([(0, 99, 50), (1, 99, 70), (2, 98, 5), (3, None, 1)], inside.schema))
    for measure in (distances.unifrac_weighted, distances.unifrac_unweighted):
        with pytest.raises(ValueError, match="3 features in 4 rows"):
            measure(df, edges, "sample", "feature", "n")
        with pytest.warns(UserWarning, match="3 features in 4 rows"):
            got = {(r.a, r.b): r.dist for r in measure(df, edges, "sample", "feature", "n", outside="drop").collect()}
        want = {(r.a, r.b): r.dist for r in measure(inside, edges, "sample", "feature", "n").collect()}
        assert got == pytest.approx(want)


def test_tip_intervals_of_forests_and_broken_trees(spark):
    rows = [("a", "lost", 1.0, 1), ("b", "lost", 1.0, 2), ("r", None, 0.0, None), ("c", "r", 2.0, 3), ("d", "r", 2.0, 4)]
    tips = spark.createDataFrame([(1,), (2,), (4,), (77,)], "tip long")
    numbers, branches = tree.tip_intervals(spark.createDataFrame(rows, EDGE), "node", "parent", "length", "tip", tips)
    number = {r.tip: r.number for r in numbers.collect()}
    assert sorted(number.values()) == [1, 2, 3] and set(number) == {1, 2, 4}
    below = {r.branch: {t for t, k in number.items() if r.first <= k <= r["last"]} for r in branches.collect()}
    assert below == {"a": {1}, "b": {2}, "lost": {1, 2}, "r": {4}, "d": {4}}
    with pytest.raises(ValueError, match="more than one row"):
        tree.tip_intervals(spark.createDataFrame([*rows, rows[0]], EDGE), "node", "parent", "length", "tip", tips)


def test_pcoa_with_absent_pairs_equals_the_full_table(spark):
    rng = np.random.default_rng(12)
    n = 70
    group = rng.integers(0, 12, n)
    near = {(i, j): 0.2 + 0.6 * rng.random() for i in range(n) for j in range(i + 1, n) if group[i] == group[j]}
    full = [(i, j, float(near.get((i, j), 1.0))) for i in range(n) for j in range(i + 1, n)]
    every = spark.createDataFrame(full, "a long, b long, dist double")
    listed = every.where("dist < 1")
    names = spark.range(n).select(F.col("id").alias("sample"))
    want, want_values = ordination.pcoa(every, 3, tolerance=1e-9)
    got, got_values = ordination.pcoa(listed, 3, tolerance=1e-9, absent=1.0, samples=names)
    coords = lambda t: {(r.sample, r.axis): r.coord for r in t.collect()}
    values = lambda t: [(r.eigenvalue, r.relative) for r in t.orderBy("axis").collect()]
    assert np.allclose(values(got_values), values(want_values), atol=1e-7)
    a, b = coords(got), coords(want)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-4
    with pytest.raises(ValueError, match="not listed"):
        ordination.pcoa(listed, 3, samples=names)
    # Dense solution.
    d = np.zeros((n, n))
    for i, j, v in full:
        d[i, j] = d[j, i] = v
    centre = np.eye(n) - 1 / n
    eigen = np.sort(np.linalg.eigvalsh(centre @ (-(d**2) / 2) @ centre))[::-1]
    assert np.allclose([v for v, _ in values(got_values)], eigen[:3], atol=1e-7)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 5_000)
    fact = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    keyed = spark.range(7).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 2_000).alias("v"))
    joined = skew.skew_join(fact, keyed, ["k"])
    assert joined.count() == 300 and "BroadcastHashJoin Inner BuildRight" not in joined._jdf.queryExecution().sparkPlan().toString()
    table, rows, size = sized(keyed)
    assert rows == 7 and size > 14_000 and sized(table)[0] is table


def test_inputs_that_cost_something_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), "id").mapInPandas(count, "g long, id long")
    assert ranks.with_position(df, ["g"], [F.col("id")], "p").count() == 20_000
    assert seen.value == 20_000
    assert skew.keep_groups(df, ["g"], F.max("id") > 0).count() == 20_000
    assert seen.value == 40_000


def test_release_deletes_what_was_written(spark):
    begun = len(written())
    kept, gone = materialize(spark.range(3), "kept"), materialize(spark.range(4), "gone")
    release(spark, written(begun), keep=kept)
    assert kept.count() == 3 and len(written()) == begun + 1
    with pytest.raises(Exception):
        gone.count()
