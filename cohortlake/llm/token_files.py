"""Token counts from flat token files by a separator scan.

A flat file holds little-endian ids of 4 bytes, or of 2 where the vocabulary fits (``id_bytes``),
document after document, each ended by an end-of-document id; there is no index. Files are cut into fixed blocks, each block is searched
for the id at once, and a prefix scan over the blocks of a file stitches the documents that
run over block ends.

Writing goes through Spark's text writer with the bytes of the end id as line separator,
so it reaches any store Spark reaches. Reading uses the binary-file source, which holds one
file in memory: keep files small (``documents_per_file``).

Rows: a null or empty document counts 0 tokens; tokens after the last end id form a document with
``closed`` false; an empty file has no rows, an empty table no files with rows. Repeated rows are documents of their own. A
document of any length counts in full, over as many blocks as it takes. Other columns are not written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 18


def write_token_files(
    df: DataFrame, ids: str, path: str, end_id: int, documents_per_file: int = 2000, id_bytes: int = 4
) -> None:
    """Write packed ids (``id_bytes`` each, without end id; null: none) as flat files under ``path``."""
    separator = int(end_id).to_bytes(id_bytes, "little")
    if max(separator) > 127:
        raise ValueError("each byte of the end id must be below 128")
    content = F.coalesce(F.col(ids), F.lit(b"")).cast("string")
    (
        df.select(content.alias("value"))
        .write.option("lineSep", separator.decode("ascii"))
        .option("maxRecordsPerFile", documents_per_file)
        .text(path)
    )


def read_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, id_bytes: int = 4) -> DataFrame:
    """``file, block, data``: the files under ``path`` in fixed blocks."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length", "content")
    step = id_bytes * block_tokens
    # All blocks of a file are cut in one pass over its content, which is not repeated beside each block.
    cut = f"transform(sequence(0L, (length - 1) DIV {step}), b -> substring(content, CAST(b * {step} + 1 AS INT), {step}))"
    return files.select(F.col("path").alias("file"), F.posexplode(F.expr(cut)).alias("block", "data")).select(
        "file", F.col("block").cast("long").alias("block"), "data"
    )


def count_documents(blocks: DataFrame, end_id: int, id_bytes: int = 4) -> DataFrame:
    """``file, doc_no, first_token, n_tokens, closed`` of every document, from ``file, block, data``."""

    def scan(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                if len(data) % id_bytes:
                    raise ValueError("a token file is not a whole number of ids")
                tokens = np.frombuffer(data, f"<u{id_bytes}")
                rows.append((len(tokens), np.flatnonzero(tokens == end_id).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([e for _, e in rows], pa.list_(pa.int64())),
                ],
                ["file", "block", "n", "ends"],
            )

    found = blocks.select("file", "block", "data").mapInArrow(scan, "file string, block long, n long, ends array<long>")
    # Prefix scan. A file fits the binary source, so it has few blocks and its window is short.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    stitched = found.withColumn("start", start).withColumn(
        "ends", F.transform("ends", lambda e: e + F.col("start"))
    )
    stitched = stitched.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn(
        "open", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0))
    )
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    rest = F.col("start") + F.col("n")
    stitched = stitched.withColumn("last", last)
    documents = stitched.select(
        "file",
        F.explode(
            F.concat(
                F.transform(
                    "ends",
                    lambda e, i: F.struct(
                        (F.col("docs") + i).alias("doc_no"),
                        F.when(i == 0, F.col("open")).otherwise(F.try_element_at("ends", i) + 1).alias("first_token"),
                        e.alias("end"),
                        F.lit(True).alias("closed"),
                    ),
                ),
                F.when(
                    F.col("last") & (F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("open")) < rest),
                    F.array(
                        F.struct(
                            (F.col("docs") + F.size("ends")).alias("doc_no"),
                            F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("open")).alias("first_token"),
                            rest.alias("end"),
                            F.lit(False).alias("closed"),
                        )
                    ),
                ).otherwise(F.array().cast("array<struct<doc_no:bigint,first_token:bigint,end:bigint,closed:boolean>>")),
            )
        ).alias("d"),
    )
    return documents.select(
        "file", "d.doc_no", "d.first_token", (F.col("d.end") - F.col("d.first_token")).alias("n_tokens"), "d.closed"
    )
