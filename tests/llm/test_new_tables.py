"""Vector codes, prefix tries and decontamination against plain-Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import LONG, documents, fold
from pyspark.sql import functions as F

from cohortlake.llm import decontaminate, prefix_trie, queries, vector_codes


def plain_codes(rows, entries, rounds=4):
    """rows: (id, label, vector) without nulls in vectors. Codes, errors and books by comparing everything."""
    length = -(-max(len(v) for _, _, v in rows) // 4) * 4
    whole = [[math.floor(1024 * x) for x in v] + [0] * (length - len(v)) for _, _, v in rows]
    width = length // 4
    first = {}
    for (i, _, _), v in zip(rows, whole, strict=True):
        if i is not None:
            first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in seeds] for p in range(4)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(4):
            mine = defaultdict(list)
            for v in whole:
                part = v[p * width : (p + 1) * width]
                mine[nearest(p, part)[1]].append(part)
            moved.append([[sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])])
        books = moved
    found = [[nearest(p, v[p * width : (p + 1) * width]) for p in range(4)] for v in whole]
    codes = ["".join(f"{k:02x}" for _, k in f) for f in found]
    errors = [sum(d for d, _ in f) for f in found]
    return codes, errors, books


@pytest.mark.parametrize("entries, kind", [(256, "near"), (40, "spread"), (24, "huge"), (30, "copies")])
def test_codes_equal_a_search_of_all_entries(spark, entries, kind):
    rng = random.Random(entries)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(12)]
    scale = {"huge": 3e30}.get(kind, 1.0)

    def vector():
        c = rng.choice(centres)
        # Coarse steps make many ties.
        return [round((x + rng.uniform(-0.2, 0.2)) * (16 if kind == "near" else 1000)) / (16.0 if kind == "near" else 1000.0) * scale for x in c]

    rows = [(i * 3 - 5, rng.choice([0, 1, None]), vector()) for i in range(120 if kind == "huge" else 420)]
    if kind == "copies":
        rows = [(i, l, rows[0][2]) for i, l, _ in rows[:300]] + rows[300:]
    rows += [(rows[4][0], 7, rows[9][2]), rows[7], rows[7], (None, 1, rows[2][2]), (None, None, rows[1][2][:9]), (9000, 2, [])]
    bad = [(9001, 1, None), (9002, 1, [None] * 16), (9003, 1, [float("nan")] * 16), (9004, 0, [1.0, float("inf")])]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").withColumn("Code", F.lit("x"))
    coded, books = vector_codes.compress(df.repartition(3), entries=entries)
    codes, errors, want = plain_codes(rows, entries)
    assert books == want
    largest = (1 << 63) - 1
    by_label = defaultdict(int)
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += min(e, largest)
    expected = sorted(
        (str((i, label)), c, min(e, largest), min(by_label[label], largest)) for (i, label, _), c, e in zip(rows, codes, errors, strict=True)
    )
    assert sorted((str((r.id, r.label)), r.code, r.error, r.label_error) for r in coded.collect()) == expected


def test_the_tree_rules_entries_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (16, 8))
    entries = (centres[rng.integers(0, 16, 256)] + rng.integers(-8, 9, (256, 8))).astype(float)
    parts = (entries[rng.integers(0, 256, 3000)] + rng.integers(-3, 4, (3000, 8))).astype(float)
    tree = vector_codes.Gnat(entries)
    index, squares = tree.nearest(parts)
    distance = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == distance.argmin(1)).all() and (squares == distance.min(1)).all()
    assert tree.tested < 0.3 * distance.size


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compress(df)[0].count() == 0
    alone = spark.createDataFrame([(None, None, [0.5, -0.5, 0.25, 0.1])], df.schema)
    coded, books = vector_codes.compress(alone)
    assert [r.code for r in coded.collect()] == ["00000000"] and books == [[[512]], [[-512]], [[256]], [[102]]]


def plain_trie(rows, block=100, heads=6):
    """rows: (conv, turn, role, text). Nodes by comparing whole prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(own.get(c - c % block, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out = []

    def walk(p):
        leaves, saved = (0 if children[p] else 1), (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        for x in children[p]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.append(
            (min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        )
        return leaves, saved

    if nodes:
        walk(())
    return sorted(out, key=str)


def conversations(seed, n=160):
    rng = random.Random(seed)
    said = ["hello", "what is é?", "", "x" * 40, "漢字 😀", "yes", "no"]
    rows = []
    for c in range(n):
        c = c if c < n // 2 else c + 1000
        if c % 100 == 0 and seed == 2:
            continue  # absent bases
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(said)))
    rows += [(c, None, None, None) for c in (3, 17, 18)] + [(5, 1, "user", "again")] * 2 + [(None, 1, "user", "lost")]
    return rows + [(7, 100 + t, "user", f"turn {t}") for t in range(70)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_one_of_whole_prefixes(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Depth", F.lit("x"))
    found = prefix_trie.prefix_trie(df.repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_trie([r for r in rows])


@pytest.mark.parametrize("bucketed", [False, True])
def test_hot_and_copied_conversations(spark, monkeypatch, bucketed):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1300) for t in range(4)]  # copies of one another
    rows += [(7, t, "user", f"long {t}") for t in range(900)]  # one conversation with many turns
    if bucketed:  # positions and sums by ranges, stretches in small blocks, digests in short runs
        from cohortlake.operators import ranks

        monkeypatch.setattr(ranks, "SMALL_TABLE", 50)
        monkeypatch.setattr(prefix_trie, "BLOCK", 100)
        monkeypatch.setattr(prefix_trie, "RUN", 16)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefix_trie(df).collect()
    assert len({(r.conv, r.depth) for r in found}) == len(found)
    assert sorted((tuple(r) for r in found), key=str) == plain_deep(rows)


def plain_deep(rows):
    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(5000)
    try:
        return plain_trie(rows)
    finally:
        sys.setrecursionlimit(old)


def test_turnless_conversations_end_at_the_root(spark):
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    df = spark.createDataFrame([(lost, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    (root,) = prefix_trie.prefix_trie(df).collect()
    assert tuple(root) == (lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def plain_hits(text, items, width=10):
    """items: id -> texts."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    words = cut(text)
    hit, met = set(), set()
    for i, texts in items.items():
        for t in texts:
            own = cut(t)
            size = min(width, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    met.add(str(i))
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("bits", [22, 3])
def test_contamination_equals_a_scan_of_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate.Bitmap.__init__, "__defaults__", (bits,))
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["The", "of", "ing", "x1", "Ér", "漢字", "a", "b"]) for _ in range(n))
    long = say(40)
    items = [(1, long), (2, say(12)), (3, "one"), (4, "Two-words"), (5, say(9)), (6, ""), (7, None), (8, "?!"), (10, long[5:]), (2, say(11)), (None, "lost item text"), (11, "b " * 14)]
    texts = [say(60) for _ in range(40)]
    texts += [f"start {long} end", long.upper().replace(" ", "--"), f"{say(5)} one {say(3)}", "two words", "two\nwords two", "b " * 300, None, "", "...", LONG]
    texts += [" ".join(long.split()[3:14]), " ".join(long.split()[3:12]), items[1][1] + " tail", "head " + items[4][1], " ".join(items[4][1].split()[:8])]
    texts += [texts[40]] * 30
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(40, texts[40], "x", None), (None, long, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, shingle long")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    known = defaultdict(list)
    for i, t in items:
        if i is not None:
            known[i].append(t)
    found = decontaminate.contamination(docs, bench).collect()
    assert len(found) == len(rows)
    want = sorted(((i, *plain_hits(t, known)) for i, t, *_ in rows), key=str)
    assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=str) == want


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted((r.id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, bench.limit(0)).collect()) == [(1, 3, 0), (2, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_contract_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.op11_vector_codes(spark, folder).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert queries.op12_prefix_trie(spark, folder).columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    assert queries.op13_decontamination(spark, folder).columns == [
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
    ]
