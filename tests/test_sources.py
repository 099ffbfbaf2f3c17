import pytest
from pyspark.sql import functions as F

from cohortlake import session
from cohortlake.operators import frames
from cohortlake.sources import io


def test_csv_round_trip_keeps_missing_quotes_and_newlines(spark, tmp_path):
    rows = [(1, "a,b", None, True), (2, 'say "hi"\nthere', 2.5, None), (3, None, -1.0, False)]
    df = spark.createDataFrame(rows, "id long, note string, x double, ok boolean")
    path = str(tmp_path / "out")
    io.write_csv(df, path, compression="gzip")
    back = io.read_typed_csv(spark, path, df.schema, quoted_newlines=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.dtypes == df.dtypes


def test_bad_value_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,x\n1,oops\n")
    with pytest.raises(Exception):
        io.read_typed_csv(spark, str(tmp_path / "bad.csv"), "id long, x double").collect()


def test_tee_and_partitions(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 3).alias("chain"), F.col("id").alias("v"))
    kept = io.tee(df, str(tmp_path / "tee"))
    assert kept.count() == 20 and kept.columns == df.columns
    parts = io.partitioned_sink(df, str(tmp_path / "parts"), ["chain"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(p.name for p in (tmp_path / "parts").glob("chain=*")) == ["chain=0", "chain=1", "chain=2"]


def test_glob_keeps_the_origin(spark, tmp_path):
    for name in ("one", "two"):
        spark.range(2).write.parquet(str(tmp_path / f"draws_{name}.parquet"))
    out = io.scan_glob(spark, str(tmp_path / "draws_*.parquet"))
    assert out.count() == 4 and out.select("origin").distinct().count() >= 2


def test_union_fills_missing_columns(spark):
    out = frames.tagged_union({"a": spark.range(1), "b": spark.range(1).withColumn("x", F.lit(1))}, "src")
    assert {(r.src, r.x) for r in out.collect()} == {("a", None), ("b", 1)}


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
