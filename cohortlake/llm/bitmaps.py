"""Bitmaps of fixed size that keep rows without a partner out of a shuffle, in DataFrame functions.

Each key sets two bits of ``2 ** bits``. The bitmap lets through every key it was given and some others,
more of them the more keys it holds, so a join must follow; the answer is the same at any size. It is one row of
``2 ** bits / 8`` bytes whatever the table holds (2 MB by default), read by tasks as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import materialize

BITS = 24


def _slots(key: Column, bits: int) -> list[Column]:
    size = F.lit(1 << bits).cast("long")
    return [F.pmod(key, size), F.pmod(F.shiftrightunsigned(key, 32), size)]


def bitmap(hashes: DataFrame, bits: int = BITS) -> Column:
    """The bitmap of the table's one column of 64-bit hashes (``bits``: 6 or more). An empty table lets nothing through."""
    if bits < 6:
        raise ValueError("a bitmap has at least 64 bits")
    slots = hashes.select(F.explode(F.array(*_slots(F.col(hashes.columns[0]), bits))).alias("slot"))
    place = F.col("slot").bitwiseAND(F.lit(63).cast("long")).cast("int")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("b")
    )
    # At most 2 ** (bits - 6) rows meet in one task.
    every = hashes.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    row = every.agg(F.transform(listed, lambda x: x["b"]).alias("words"))
    return materialize(row, "bitmap").select("words").scalar()


def may_hold(words: Column, key: Column, bits: int = BITS) -> Column:
    """Whether the bitmap lets the hash through."""
    low, high = (
        F.getbit(F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        for slot in _slots(key, bits)
    )
    return F.coalesce(low & high, F.lit(False))
