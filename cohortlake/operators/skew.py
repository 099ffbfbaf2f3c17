"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import cut_lineage, reread, shuffle_width, sized

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


def with_one_row(df: DataFrame, one_row: DataFrame, name: str = "_g") -> DataFrame:
    """Attach the single row of a global aggregate as a struct column.

    A scalar subquery: evaluated once, no join, and an error if it has two rows.
    """
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; key columns come from the left."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"_r_{key}"])
        condition = part if condition is None else condition & part
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def skew_join(
    fact: DataFrame,
    keyed: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: str | None = None,
    broadcast_rows: int | None = None,
    of_pairs: bool = False,
) -> DataFrame:
    """Join a fact table to a table with few rows per key, splitting hot keys.

    The keyed table is written once, and its rows and bytes are taken from the copy. With no more than
    ``broadcast_rows`` rows (``BROADCAST_ROWS``, or less) and ``BROADCAST_BYTES`` it is broadcast, and the
    fact table stays where it is, read once. Beyond that both sides are shuffled and hot keys are split: a key is hot when it holds more than one shuffle partition's
    fair share of the rows, so there are fewer hot keys than shuffle partitions.
    Fact rows of a hot key are spread over salts and the keyed row is repeated
    once per salt. ``rows`` names a column of ``keyed`` that already holds the row
    count per key (dropped from the result); without it the keys are counted. ``of_pairs``: the fact table
    has a row for every two keys, so beside it the keyed table stays small at any number of rows and only
    ``BROADCAST_BYTES`` bounds the broadcast.
    """
    keys = list(keys)
    keyed, held, size = sized(keyed, "keyed")
    plain = keyed if rows is None else keyed.drop(rows)
    bound = BROADCAST_ROWS if broadcast_rows is None else min(broadcast_rows, BROADCAST_ROWS)
    if (of_pairs or held <= bound) and size <= BROADCAST_BYTES:
        return join_null_safe(fact, F.broadcast(plain), keys, how)
    if rows is None:
        fact = reread(fact, "fact")
        sizes = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        sizes = keyed.select(*keys, F.col(rows).alias("_rows"))
    hot = hot_keys(sizes if rows is not None else cut_lineage(sizes), shuffle_width(fact.sparkSession))
    if hot is None:
        return join_null_safe(fact, plain, keys, how)
    # Equal rows differ by the partition they are read from, which a retried task keeps.
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError("salting would repeat the keyed side's unmatched rows")
    salt = F.xxhash64(*fact.columns, F.spark_partition_id())
    salted_fact = (
        join_null_safe(fact, hot, keys, "left")
        .withColumn("_salt", F.pmod(salt, F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    salted_keyed = (
        join_null_safe(plain, hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return join_null_safe(salted_fact, salted_keyed, [*keys, "_salt"], how).drop("_salt")


def hot_keys(sizes: DataFrame, width: int) -> DataFrame | None:
    """Keys above a fair share with their number of salts, ready to broadcast; None if there are none.

    ``sizes`` has the keys and ``_rows``. At most ``width`` keys can exceed one part in
    ``width`` of all rows, which bounds what the driver sees.
    """
    shape = sizes.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("largest")).first()
    if not shape["total"] or shape["largest"] * width <= shape["total"]:
        return None
    hot = sizes.where(F.col("_rows") * width > shape["total"]).withColumn(
        "_salts", F.ceil(F.col("_rows") * width / F.lit(shape["total"])).cast("int")
    )
    found = hot.drop("_rows")
    return F.broadcast(sizes.sparkSession.createDataFrame(found.collect(), found.schema))


def attach_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Put group aggregates on every row of the group, without a window.

    A window would sort each whole group in one task; this combines map-side,
    then joins back with hot groups split. An input that is more than a scan is written
    once and read twice; the aggregate is a written table, so chained calls do not multiply the plan.
    """
    df = reread(df, "grouped")
    stats = df.groupBy(*keys).agg(
        *[column.alias(name) for name, column in aggregates.items()],
        F.count(F.lit(1)).alias("_group_rows"),
    )
    return skew_join(df, stats, keys, rows="_group_rows")


def keep_groups(df: DataFrame, keys: Sequence[str], test: Column) -> DataFrame:
    """Keep the rows of groups whose aggregate passes the test; the input is treated as in ``attach_stats``."""
    df = reread(df, "grouped")
    stats = (
        df.groupBy(*keys)
        .agg(test.alias("_pass"), F.count(F.lit(1)).alias("_group_rows"))
        .where(F.col("_pass"))
        .drop("_pass")
    )
    return skew_join(df, stats, keys, rows="_group_rows")
