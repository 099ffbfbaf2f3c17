"""The registered queries of this package, over the whole of their tables.

``QUERIES`` and ``ORACLE`` have the shape of the main registry; ``__spark_entry__`` adds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import (
    decontaminate,
    license_rules,
    line_rules,
    metric_join,
    minmax_dedup,
    mixing,
    ngram_quality,
    piece_codec,
    prefix_trie,
    secret_scan,
    shards,
    token_files,
    vector_codes,
)
from cohortlake.llm.bitmaps import bitmap, may_hold
from cohortlake.llm.checking_sql import DECONTAMINATION_SQL, PREFIX_TRIE_SQL, vector_codes_sql
from cohortlake.session import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op12_prefix_trie": PREFIX_TRIE_SQL,
    "op13_decontamination": DECONTAMINATION_SQL,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer, where this machine keeps it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text they decode to, as digests."""
    tables = piece_codec.PieceTables(tokenizer_path())
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.code_columns(texts, tables)
    return coded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled good and not toxic; a bitmap of fixed size keeps most other texts out of the join."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = materialize(labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct(), "good")
    name = F.xxhash64(F.col("doc_id").cast("long"))
    possible = documents.where(may_hold(bitmap(good.select(name)), name))
    return possible.hint("merge").join(good, "doc_id", "left_semi")


def secret_scanner(spark: SparkSession, sf_dir: str) -> secret_scan.Scanner:
    """A scanner from the generated findings, with the dictionary of the trusted documents."""
    words = secret_scan.count_dictionary(trusted_documents(spark, sf_dir).select("text"))
    return secret_scan.train(secret_scan.example_findings(spark), words)


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its probability; ``core`` as a digest."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scanner(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "place", F.sha2("core", 256).alias("core_sha256"), "probability", "is_secret"
    )


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted from flat token files of the whole table."""
    tables = piece_codec.PieceTables(tokenizer_path())
    width = 2 if tables.size <= 1 << 16 else 4
    coded = piece_codec.encode_column(table(spark, sf_dir, "documents").select("text"), tables, id_bytes=width)
    bare = coded.select(F.expr(f"substring(ids, {width + 1}, octet_length(ids) - {2 * width})").alias("ids"))
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(bare, "ids", path, tables.end, id_bytes=width)
    counted = token_files.count_documents(token_files.read_blocks(spark, path, id_bytes=width), tables.end, width)
    name = F.regexp_extract("file", "part-([0-9]+).*-c([0-9]+)[.]", 1)
    part = F.regexp_extract("file", "part-([0-9]+).*-c([0-9]+)[.]", 2)
    return counted.select(
        name.cast("int").alias("writer"), part.cast("int").alias("part"), "doc_no", "first_token", "n_tokens", "closed"
    )


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "source",
        "copies",
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"),
    ).drop("row")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric_join.cosine_links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    placed = shards.shard_by_bytes(materialize(rows, "sized"), "key", "size", ["text_crc32", "doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents"))
    return judged.drop("content").withColumnRenamed("id", "doc_id")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    found = ngram_quality.classify(table(spark, sf_dir, "documents"), trusted)
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256")
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.withColumnsRenamed({"conv": "conv_id", "parent": "parent_conv_id"})


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
