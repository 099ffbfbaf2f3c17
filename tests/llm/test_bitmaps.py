"""Bitmaps let through what they hold, at any number of keys, and little else while they have room."""

from pyspark.sql import functions as F

from cohortlake.llm.bitmaps import bitmap, may_hold


def test_bitmap_holds_its_keys(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for bits, others in ((6, 3000), (20, 30)):
        rows = spark.range(6000).select("id", F.xxhash64("id").alias("h"))
        let = {r.id for r in rows.where(may_hold(bitmap(keys, bits), F.col("h"), bits)).collect()}
        assert set(range(3000)) <= let and len(let) - 3000 <= others
    assert len(let) < 3030


def test_empty_bitmap_lets_nothing_through(spark):
    none = spark.range(0).select(F.xxhash64("id"))
    assert spark.range(100).where(may_hold(bitmap(none, 8), F.xxhash64("id"), 8)).isEmpty()
