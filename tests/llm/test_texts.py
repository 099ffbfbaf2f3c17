"""Tokens, quality rules, licences and the language model against plain-Python versions."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import LONG, documents, fold, line_counts, phrase_counts, words
from pyspark.sql import functions as F

from cohortlake.llm import license_rules, line_rules, ngram_quality, piece_codec, queries, token_files, word_blocks
from cohortlake.session import fresh_path, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables():
    return piece_codec.PieceTables(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_equal_the_library(tables, library):
    rng = random.Random(5)
    parts = ["a", "b", "ab", "th", "the", " ", "  ", "\n", "é", "😀", "▁", "漢", "0", "\x00", "</s>", "<0x0A>", "\t", "\r", "==", "----", "�", "한"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 70))) for _ in range(4000)] + [LONG, "x" * 30_000, ""]
    packed = tables.encode(texts, piece_codec.WordCache())
    for text, ids, back in zip(texts, packed, tables.decode(packed), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert back == library.decode(want)


def test_any_ids_decode_as_in_the_library(tables, library):
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(3, 258)]) for _ in range(rng.randint(0, 12))]
        assert tables.decode([np.array(ids, "<u4").tobytes()]) == [library.decode(ids)]


def test_narrow_ids_are_the_same_ids(spark, tables):
    df = documents(spark).select("text")
    wide = piece_codec.code_columns(df, tables).collect()
    narrow = piece_codec.code_columns(df, tables, id_bytes=2).collect()
    for w, n in zip(wide, narrow, strict=True):
        assert np.frombuffer(w.ids, "<u4").tolist() == np.frombuffer(n.ids, "<u2").tolist() and w.decoded == n.decoded


def test_a_full_cache_changes_nothing(tables, monkeypatch):
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    want = tables.encode(texts, piece_codec.WordCache())
    cache, got = piece_codec.WordCache(), []
    monkeypatch.setattr(piece_codec, "CACHED_WORDS", 50)
    for text in texts:
        got += tables.encode([text], cache)
    assert got == want and len(cache.keys) <= 50


def test_codec_columns(spark, tables, library):
    df = documents(spark)
    coded = piece_codec.decode_column(piece_codec.encode_column(df.drop("ids"), tables), tables)
    rows = coded.collect()
    assert len(rows) == df.count() and coded.columns[:6] == df.columns[:6]
    for r in rows:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
    empty = spark.createDataFrame([], "text string")
    assert piece_codec.encode_column(empty, tables).count() == 0


def blocks(spark, files, size):
    rows = []
    for name, ids in files.items():
        data = np.array(ids, "<u4")
        rows += [(name, i // size, bytearray(data[i : i + size].tobytes())) for i in range(0, len(data), size)]
    return spark.createDataFrame(rows, "file string, block long, data binary")


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_documents_over_block_ends(spark, size):
    files = {"a": [2], "b": [5, 6], "c": [2, 2, 5, 2, 6], "d": [7] * 5 + [2, 1, 2] + [3] * 7}
    got = sorted(tuple(r) for r in token_files.count_documents(blocks(spark, files, size), 2).collect())
    assert got == [
        ("a", 0, 0, 0, True), ("b", 0, 0, 2, False), ("c", 0, 0, 0, True), ("c", 1, 1, 0, True),
        ("c", 2, 2, 1, True), ("c", 3, 4, 1, False), ("d", 0, 0, 5, True), ("d", 1, 6, 1, True), ("d", 2, 8, 7, False),
    ]


@pytest.mark.parametrize("width", [2, 4])
def test_written_files_hold_the_counts(spark, tables, library, width):
    df = documents(spark).select("text").repartition(3)
    coded = piece_codec.encode_column(df, tables, id_bytes=width)
    bare = coded.select(F.expr(f"substring(ids, {width + 1}, octet_length(ids) - {2 * width})").alias("ids"))
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(bare, "ids", path, tables.end, documents_per_file=7, id_bytes=width)
    found = token_files.count_documents(token_files.read_blocks(spark, path, 64, width), tables.end, width).collect()
    want = sorted(len(library.encode(r.text or "")) for r in df.collect())
    assert sorted(r.n_tokens for r in found) == want and all(r.closed for r in found)
    assert max(r.doc_no for r in found) == 6


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [r.text for r in documents(spark).collect()]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    texts += ["x\n#*$%&|<>\nx\n x", "a b c", "w " * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    counts = df.select("i", *[c.alias(n) for n, c in line_rules.base_counts(F.col("text")).items()]).select("*", "numbers.*")
    for r in counts.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == line_counts(texts[r.i]), texts[r.i]


def own_line(i, n=60):
    """A line that stays its own when digits become 0."""
    name = "".join("abcdefghij"[int(d)] for d in str(i))
    return " ".join(f"own{name}x{k}" for k in range(n))


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    own = own_line
    menu = " ".join(f"menu{k}" for k in range(55))
    rows = [(i, own(i) + "\n" + menu, "h") for i in range(40)]  # menu is under half of each
    rows += [(100 + i, f"{menu}\nonly {'abcde'[i]}", "h") for i in range(5)]  # nearly nothing but the menu
    rows += [(200 + i, menu + "\n" + own(7), "other") for i in range(3)]  # not frequent on its host
    rows += [(300 + i, own(999) + "\n" + menu, "h") for i in range(50)]  # copies count once
    rows += [(None, None, None), (400, "", "h"), (101, f"{menu}\nonly b", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("words", F.lit(1))
    out = {r.id: r for r in line_rules.judge(df).collect()}
    assert all(out[i].kept for i in range(40)) and all(out[200 + i].kept for i in range(3))
    assert all(out[300 + i].kept and out[300 + i].removed_words == 55 for i in range(50))
    assert out[0].removed_words == 0 and out[1].removed_words == 55  # the first document keeps the line
    assert not any(out[100 + i].kept or out[100 + i].base_failed for i in range(5))
    assert out[101].removed_words == 55 and out[400].base_failed and out[None].base_failed
    kept = line_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 93
    assert line_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [6, 22])
def test_texts_lose_their_frequent_lines(spark, bits):
    own = own_line
    menu = " ".join(f"menu{k}" for k in range(25))
    rows = [(i, f"{own(i)} a\n\n {menu.upper()}\t\n{own(100 + i)} b", "h", i) for i in range(30)]
    rows += [(0, rows[5][1], "h", 40), (50, rows[5][1], "other", 50), (5, rows[5][1], "other", 51), (None, rows[6][1], "h", 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").withColumn("clean_text", F.lit("x"))
    bare = {row: f"{own(k)} a\n\n{own(100 + k)} b" for row, k in [*((i, i) for i in range(1, 30)), (52, 6)]}
    want = {row: bare.get(row, text) for _, text, _, row in rows}
    kept = line_rules.keep_good(df, bits=bits)
    assert kept.columns == df.columns and {r.row: r.text for r in kept.collect()} == want
    judged = line_rules.judge(df.where("row < 30"), bits=bits).collect()
    assert {r.id: (r.clean_text, r.removed_words) for r in judged} == {i: (want[i], 25 if i else 0) for i in range(30)}


def test_removed_words_are_those_of_all_removed_lines(spark):
    parts = [" ".join(f"menu{p}x{k}" for k in range(20)) for p in "abc"]
    rows = [(i, "\n".join([*parts, own_line(i, 10)]), "h") for i in range(30)]
    out = {r.id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept and not any(out[i].kept for i in range(1, 30))
    assert all(out[i].removed_words == 60 and out[i].clean_text == own_line(i, 10) for i in range(1, 30))


def test_line_limits_do_not_grow_with_the_host(spark):
    menu = " ".join(f"menu{k}x" for k in range(12))
    rows = [(i, own_line(i) + ("\n" + menu if i < 20 else ""), "large") for i in range(400)]
    rows += [(1000 + i, own_line(i) + ("\n" + menu if i < 5 else ""), "small") for i in range(30)]
    rows += [(2000 + i, own_line(i) + ("\n" + menu if i < 4 else ""), "tiny") for i in range(4)]
    rows += [(3000, menu.replace("menu", "other") + "\n" + own_line(401, 52) + "\n" + menu, "large")]
    rows += [(3001, own_line(402, 45) + "\n" + menu, "large")]  # too short without the menu
    out = {r.id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in out.items() if r.removed_words} == {*range(1, 20), *range(1001, 1005), 3000, 3001}
    assert {i for i, r in out.items() if not r.kept} == {3001}


def test_given_tables_have_frequent_lines_and_depleted_documents(spark):
    judged = line_rules.judge(queries.table(spark, "/root/testdata/sf0.1", "documents")).drop("content").collect()
    assert sum(r.removed_words > 0 for r in judged) >= 1000
    assert any(not r.kept and not r.base_failed for r in judged)


def test_phrases_and_rules(spark):
    rng = random.Random(2)
    parts = [*license_rules.PHRASES, "mit", "license", "é", "apache", "2", "\n", "-", "cc by nc cc by nc", "under the"]
    texts = [rng.choice([" ", "-", ". "]).join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "...", LONG, "CC-BY-NC", "under the MIT LICENSE", "Kelvin cc by nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("label", F.lit("x"))
    for r in license_rules.scan_licenses(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrase_counts(texts[r.id], license_rules.PHRASES)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_rules.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("Released under the MIT license.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("GNU GPL version 2 or any later version", "gpl-2-or-later"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("GNU Affero General Public License v3", "agpl-3"),
        ("Mozilla Public License, v. 2.0", "mpl-2.0"),
        ("Eclipse Public License - v 2.0", "epl-2.0"),
        ("see the Boost Software License", "boost-1.0"),
        ("BSD-3-Clause", "bsd-3"),
        ("EPL-2.0", "epl-2.0"),
        ("GPLv3", "gpl-3"),
        ("SPDX-License-Identifier: GPL-2.0+", "gpl-2"),
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            "mpl-2.0",
        ),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "gpl-2-or-later",
        ),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "apache-2",
        ),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "boost-1.0"),
        (
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission.",
            "bsd-3",
        ),
        ("version 2 of the printer and 3 clauses of 2 0", ""),
        ("he was permitted to license songs with Apache drums", ""),
        ("plain words only", ""),
    ],
)
def test_labels(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_rules.scan_licenses(df).first()["labels"] == labels


def spellings(tree):
    """Every text of a parsed pattern of letters, groups, alternatives, sets and ``?``."""
    out = [""]
    for op, value in tree:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(value)]
        elif kind == "IN":
            part = [chr(v) for _, v in value]
        elif kind == "SUBPATTERN":
            part = spellings(value[3])
        elif kind == "BRANCH":
            part = [t for branch in value[1] for t in spellings(branch)]
        else:
            assert kind == "MAX_REPEAT" and value[:2] == (0, 1), kind
            part = ["", *spellings(value[2])]
        out = [a + b for a in out for b in part]
    return out


def test_every_spelling_of_a_rule_passes_its_keywords():
    keywords = {}
    for rule in license_rules.rules():
        keywords.setdefault((rule.label, rule.pattern), []).extend(rule.keyword.split("|"))
    for (label, pattern), known in keywords.items():
        for text in spellings(re._parser.parse(pattern)):
            assert any(" " + k in " " + text for k in known), (label, known, text)


def test_spellings_without_the_family_word_get_their_label(spark):
    names = {
        "FreeBSD": "bsd-2", "APL 2": "apache-2", "PSF license": "python-2.0", "ODbL": "odbl-1.0",
        "NCSA Open Source License": "ncsa", "do what the fuck you want to public license": "wtfpl",
        "CreativeML Open RAIL-M": "openrail-m", "GFDL 1.3": "fdl-1.3",
    }
    df = spark.createDataFrame([(f"Licensed under the {n}", v) for n, v in names.items()], "text string, doc_id string")
    assert {r.id: r.labels for r in license_rules.scan_licenses(df).collect()} == {v: v for v in names.values()}


def test_there_are_hundreds_of_rules():
    assert len(license_rules.rules()) > 300


def brute_model(texts):
    """Interpolated modified Kneser-Ney over words, order 3, from dictionaries."""
    marked = lambda t: ["<", "<", *words(fold(t)), ">"] if words(t) else []
    grams = {3: Counter()}
    for t in texts:
        s = marked(t)
        grams[3].update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
    for k in (2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def discounts(table):
        c = [sum(v == k for v in table.values()) for k in range(1, 5)]
        if not c[0] or not c[1]:
            return [0.5] * 3
        y = c[0] / (c[0] + 2 * c[1])
        raw = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]

    d = {k: discounts(grams[k]) for k in grams}
    totals, held = Counter(), Counter()
    for k, table in grams.items():
        for g, n in table.items():
            totals[k, g[:-1]] += n
            held[k, g[:-1]] += d[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        context = (k, g[:-1])
        if context not in totals:
            return p(g[1:])
        n = grams[k].get(g, 0)
        return (n - d[k][min(n, 3) - 1] if n else 0) / totals[context] + held[context] / totals[context] * p(g[1:])

    def perplexity(t):
        s = marked(t)
        return math.exp(-sum(math.log(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) / (len(s) - 2)) if s else None

    return perplexity


@pytest.mark.parametrize("frequent", [0, 40, ngram_quality.FREQUENT])
def test_perplexities_by_shards(spark, frequent):
    df = documents(spark).withColumn("text", F.substring("text", 1, 400))
    trusted = df.where("doc_id % 2 = 0 AND text IS NOT NULL")
    model = ngram_quality.train(trusted.select("text"))
    want = brute_model([r.text for r in trusted.collect()])
    found = ngram_quality.perplexities(df, model, "text", frequent)
    named = df.select("text", *ngram_quality.text_name("text")).distinct().join(found, ["h1", "h2"], "left").collect()
    assert len(named) == df.select("text").distinct().count()
    for r in named:
        expected = want(r.text)
        assert (r.perplexity is None) == (expected is None)
        assert expected is None or math.isclose(r.perplexity, expected, rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [0, 7])
def test_words_outside_the_codebook(spark, frequent):
    """Words that the codebook lacks are spelled out; the scores are the same."""
    df = documents(spark).withColumn("text", F.substring("text", 1, 400))
    trusted = df.where("doc_id % 3 = 0 AND text IS NOT NULL")
    model = ngram_quality.train(trusted.select("text"), frequent)
    want = brute_model([r.text for r in trusted.collect()])
    found = ngram_quality.perplexities(df, model)
    named = df.select("text", *ngram_quality.text_name("text")).distinct().join(found, ["h1", "h2"]).collect()
    assert len(named) == sum(want(r.text) is not None for r in df.select("text").distinct().collect())
    assert all(math.isclose(r.perplexity, want(r.text), rel_tol=1e-9) for r in named)


def test_model_takes_few_bytes(spark):
    """What training has written at its end, for each different 3-gram; as rows of 64-bit names it was 85 bytes."""
    rng = random.Random(11)
    known = [f"w{i}" for i in range(3000)]
    texts = [" ".join(known[min(int(rng.paretovariate(0.6)) - 1, 2999)] for _ in range(400)) for _ in range(500)]
    grams = len({g for t in texts for s in [["<", "<", *t.split(), ">"]] for g in zip(s, s[1:], s[2:], strict=False)})
    before = len(written())
    ngram_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    size = sum(f.stat().st_size for path in written(before) for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert size < 25 * grams, size / grams


def test_blocks_give_back_their_words():
    rng = np.random.default_rng(2)
    words = rng.integers(1, (1 << 64) - 1, 500, dtype=np.uint64)
    book = word_blocks.Codebook(words[:100])
    columns = [np.r_[rng.choice(words, 300), word_blocks.NOTHING] for _ in range(3)]
    counts = np.r_[rng.integers(0, 1 << 32, 300), 0]
    back, (n,), codes = book.unpack(book.pack(columns, [counts]))
    assert all((a == b).all() for a, b in zip(back, columns, strict=True)) and (n == counts).all()
    assert all(((code == 0) == ~np.isin(c, [*words[:100], 0])).all() for code, c in zip(codes, columns, strict=True))
    parts = dict(word_blocks.by_place(words, 7))
    assert sorted(np.concatenate(list(parts.values()))) == list(range(500)) and set(parts) == set(range(7))
    with pytest.raises(OverflowError):
        word_blocks.pack([np.array([1 << 32])])


def test_shuffled_words_score_worse(spark):
    """The order of words counts: known texts against their own words in another order."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    good = read("documents").join(read("labels").where("quality = 1 AND toxic = 0"), "doc_id").where("lang = 'en'")
    texts = [r.text for r in good.orderBy("doc_id").collect() if len(words(r.text)) > 50]
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    rng = random.Random(3)
    pairs = [(i, t, " ".join(rng.sample(words(t), len(words(t))))) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(pairs, "i long, text string, mixed string")
    by = {}
    for column in ("text", "mixed"):
        scored = ngram_quality.perplexities(df, model, column)
        rows = df.select("i", *ngram_quality.text_name(column)).join(scored, ["h1", "h2"]).collect()
        by[column] = {r.i: r.perplexity for r in rows}
    assert len(by["text"]) == len(by["mixed"]) == len(pairs)
    assert all(by["mixed"][i] > 3 * by["text"][i] for i in by["text"])


def test_classifier_bounds(spark):
    df = documents(spark)
    ids = df.select("doc_id")
    out = ngram_quality.classify(df, ids).collect()
    assert len(out) == df.count() and not any(r.kept for r in out if r.perplexity is None)
    none = ngram_quality.classify(df.limit(0), ids.limit(0))
    assert none.count() == 0
    untrained = ngram_quality.classify(df, ids.limit(0)).collect()
    assert len(untrained) == df.count()


def test_classifier_tells_good_from_bad(spark):
    """Held-out labels of the given tables."""
    found = queries.QUERIES["op10_ngram_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    seen = found.join(labels, "doc_id").where(held | (F.col("quality") == 0))
    rates = {r["quality"]: r["k"] for r in seen.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] >= 0.95 and rates[0] <= 0.3, rates


def test_digest_query(spark):
    rows = queries.QUERIES["op1_sentencepiece"](spark, "/root/testdata/sf0.001").limit(40).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
