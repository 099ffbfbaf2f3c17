"""The corpus pipeline as a whole, on the awkward rows and on a small table."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from cases import documents, line_counts
from pyspark.sql import functions as F

from cohortlake.llm import line_rules, minmax_dedup
from cohortlake.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs):
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, ""), name.replace(" ", "-"))
    return out


def test_stages_keep_columns_and_lose_rows_by_rule_only(spark):
    docs = documents(spark).select(*COLUMNS)
    found = stages(spark, docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(found[n].columns == COLUMNS for n in names[:-1])
    # Quality: exactly the documents that pass, whatever their nulls.
    judged = {r.id: r for r in line_rules.judge(docs).collect()}
    passed = sorted(i for i, r in judged.items() if r.kept)
    rows = {r.doc_id: r for r in docs.collect()}
    for i, r in judged.items():
        n, _, _, _, repeated = line_counts(rows[i].text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
    assert sorted({r.doc_id for r in found["quality rules"].collect()}) == passed


def test_second_stage_keeps_one_of_each_group(spark):
    docs = documents(spark).select(*COLUMNS)
    good = materialize(line_rules.keep_good(docs), "good")
    kept = minmax_dedup.drop_near_duplicates(good)
    want = {r.id for r in minmax_dedup.near_duplicates(good).collect() if r.kept}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want) and kept.columns == COLUMNS


def test_null_and_repeated_ids_pass_the_second_stage(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 2), (1, text, "en", "s", 3), (2, text, "en", "s", 4), (3, "a b", None, None, None), (3, "a b", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("gone_key", F.lit(7))
    kept = minmax_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.n_chars) for r in kept.collect()) == [("1", 3), ("3", None), ("None", 1), ("None", 2)]


def test_last_stage_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(spark).select(*COLUMNS)
    coded = corpus_pipeline.encode(spark, docs, "").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(coded) == docs.count()
    for r in coded:
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_empty_table(spark):
    docs = documents(spark).select(*COLUMNS).limit(0)
    found = stages(spark, docs)
    assert all(df.count() == 0 for df in found.values())


def test_run_releases_what_stages_left(spark, tmp_path):
    documents(spark).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() > 0 and result.columns[0] == "doc_id"
    before = len(corpus_pipeline.written())
    corpus_pipeline.run(spark, str(tmp_path))
    # Only the five results of the run and what its last stage left stay.
    assert len(corpus_pipeline.written()) - before <= 5 + len(corpus_pipeline._LEFT)
