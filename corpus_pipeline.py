"""A corpus pipeline of five of the ``llm`` operators; each stage is written and read again.

Stages: quality rules, near-duplicates (five-word shingles, similarity 0.8), secrets masked,
sources mixed, texts encoded. All but the last return the columns of ``documents``.
A stage begins by deleting what the stage before wrote on its way to its result.

Rows: a null or empty text fails the quality rules and goes. Null ids, languages and sources stay what
they are; rows that repeat an id are decided as the operators say. An empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import line_rules, minmax_dedup, mixing, piece_codec, secret_scan
from cohortlake.llm.queries import table, tokenizer_path
from cohortlake.session import materialize, release, written

# SQL has no near-duplicates with these bounds, forest or tokenizer.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; frequent lines go from the others' texts."""
    return line_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minmax_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays. The dictionary is that of the documents kept so far."""
    scanner = secret_scan.train(secret_scan.example_findings(spark), secret_scan.count_dictionary(docs))
    return secret_scan.redact(docs, scanner)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text as packed bytes, their number, and a digest of the text they decode to."""
    tables = piece_codec.PieceTables(tokenizer_path())
    coded = piece_codec.code_columns(docs.select("doc_id", "lang", "source", "text"), tables)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_LEFT: list[str] = []


def _stage(function):
    """The stage, which first releases the tables that the one before it wrote on its way."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT, keep=docs)
        begun = len(written())
        result = function(spark, docs, sf_dir)
        _LEFT[:] = written(begun)
        return result

    return run_stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("near-duplicates", _stage(near_dedup)),
    ("secrets", _stage(secrets)),
    ("mixing", _stage(mix)),
    ("encoding", _stage(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
