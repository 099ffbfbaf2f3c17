"""Readers and writers: typed delimited text, globs, tee and partitioned sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlake.session import fresh_path


def _csv_options(missing: str) -> dict:
    return {"header": True, "quote": '"', "escape": '"', "nullValue": missing}


def read_typed_csv(
    spark: SparkSession, path: str, schema: StructType | str, missing: str = "NA", quoted_newlines: bool = False
) -> DataFrame:
    """Delimited text with a declared schema and a missing-value token; gz by suffix.

    ``quoted_newlines`` lets a quoted field span lines, at the price that one file
    is no longer split between tasks.
    """
    options = _csv_options(missing) | {"multiLine": quoted_newlines, "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "NA", compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists").options(**_csv_options(missing), emptyValue="")
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def scan_glob(spark: SparkSession, pattern: str, origin: str = "origin") -> DataFrame:
    """All parquet files matching a pattern as one table, with the file each row came from."""
    return spark.read.parquet(pattern).withColumn(origin, F.col("_metadata.file_path"))


def tee(df: DataFrame, path: str) -> DataFrame:
    """Write a result and go on from what was written.

    Reading it back costs a scan but neither a second computation nor executor
    memory, and the result outlives lost executors.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned_sink(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One folder per key value, read back as one table.

    Rows are spread over tasks as they come, so one large key is written by many
    tasks; each task appends at most one file per key.
    """
    df.write.mode("errorifexists").partitionBy(*keys).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def fresh(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)
