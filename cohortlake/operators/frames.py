"""Selections, predicates, joins and reshapes on named tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ranks import with_position
from cohortlake.operators.skew import join_null_safe, keep_groups, skew_join, with_one_row
from cohortlake.session import cut_lineage


# --- columns -------------------------------------------------------------------------------


def select_matching(
    df: DataFrame,
    first: Sequence[str] = (),
    containing: Sequence[str] = (),
    drop: Sequence[str] = (),
    everything: bool = False,
) -> DataFrame:
    """Columns by name, then by part of a name, then all others; minus the dropped."""
    chosen = list(first)
    for text in containing:
        chosen += [c for c in df.columns if text in c and c not in chosen]
    if everything:
        chosen += [c for c in df.columns if c not in chosen]
    return df.select(*[c for c in chosen if c not in drop])


def rename_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Substitute text in column names."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def mutate_across(
    df: DataFrame,
    function: Callable[[Column], Column],
    containing: Sequence[str] = (),
    types: Sequence[str] = (),
) -> DataFrame:
    """Apply one function to the columns chosen by part of a name or by type, in one projection."""
    kinds = dict(df.dtypes)
    chosen = {c for c in df.columns if kinds[c] in types or any(t in c for t in containing)}
    return df.select(*[function(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns (all by default)."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct combinations of the columns (all by default)."""
    return (df.select(*columns) if columns else df).distinct()


def positive_log(df: DataFrame, columns: Mapping[str, str], base: float | None = None) -> DataFrame:
    """Add logarithms of columns; rows where one is not positive are dropped first."""
    keep = functools.reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns])
    log = (lambda c: F.log(c)) if base is None else (lambda c: F.log(base, c))
    return df.where(keep).select("*", *[log(F.col(c)).alias(out) for c, out in columns.items()])


# --- unions --------------------------------------------------------------------------------


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Row-bind by column name; columns a table lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Row-bind named tables with the name as a column."""
    return union_sources([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


# --- joins ---------------------------------------------------------------------------------


def member_filter(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the other table; a null key is in none."""
    return skew_join(df, keys.select(*on).dropna().distinct(), on, "left_semi")


def nonmember_filter(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the other table; rows with a null key stay."""
    return skew_join(df, keys.select(*on).dropna().distinct(), on, "left_anti")


def join_dictionary(df: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a label table with one row per key, splitting hot keys."""
    return skew_join(df, labels.distinct(), on, "left")


def join_right_keep(attributes: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep every fact row and attach the attributes, null where there are none."""
    joined = skew_join(facts, attributes, on, "left")
    return joined.select(*on, *[c for c in facts.columns if c not in on], *[c for c in attributes.columns if c not in on])


# --- reshapes ------------------------------------------------------------------------------


def pivot_kinds(df: DataFrame, ids: Sequence[str], kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """Long to wide over a fixed list of kinds."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])


def feature_columns(
    df: DataFrame,
    ids: Sequence[str],
    feature: str,
    value: str,
    chosen: Mapping[str, str],
    fill: Column | None = None,
) -> DataFrame:
    """Chosen features become columns on the rows of all other features."""
    wide = (
        df.where(F.col(feature).isin(*chosen))
        .groupBy(*ids)
        .agg(*[F.max(F.when(F.col(feature) == f, F.col(value))).alias(c) for f, c in chosen.items()])
    )
    wide = cut_lineage(wide)
    rest = df.where(~F.coalesce(F.col(feature).isin(*chosen), F.lit(False)))
    joined = skew_join(rest, wide, ids, "left")
    if fill is None:
        return joined
    return joined.select(*df.columns, *[F.coalesce(F.col(c), fill).alias(c) for c in chosen.values()])


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long, keeping the id columns."""
    return df.unpivot(list(ids), list(values), name, value)


GRID_CHUNK = 1000


def key_grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every combination of two key tables.

    The result is the product, so its size is the caller's choice. The right keys
    travel in numbered chunks of bounded arrays: each left key meets each chunk
    by chunk number and opens it in place, so no task holds more than a chunk.
    """
    numbered = with_position(right.distinct(), [], [F.struct(*right.columns)], "_at")
    chunks = (
        numbered.withColumn("_chunk", F.floor((F.col("_at") - 1) / GRID_CHUNK).cast("long"))
        .groupBy("_chunk")
        .agg(F.collect_list(F.struct(*right.columns)).alias("_keys"))
    )
    chunks = cut_lineage(chunks)
    last = chunks.agg(F.max("_chunk").alias("m"))
    spread = with_one_row(left.distinct(), last, "_last").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last.m")))
    )
    return (
        skew_join(spread, chunks, ["_chunk"], broadcast_rows=50)
        .select(*left.columns, F.explode("_keys").alias("_key"))
        .select(*left.columns, "_key.*")
    )


def complete_grid(df: DataFrame, left: Sequence[str], right: Sequence[str], value: str, fill) -> DataFrame:
    """All combinations of two key sets, with a fill value where the table has no row."""
    grid = key_grid(df.select(*left), df.select(*right))
    return (
        join_null_safe(grid, df.select(*left, *right, value), [*left, *right], "left")
        .select(*left, *right, F.coalesce(F.col(value), F.lit(fill)).alias(value))
    )


def value_grid(df: DataFrame, column: str, points: int, out: str) -> DataFrame:
    """Evenly spaced values between the smallest and the largest, as ``points`` rows."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    return (
        ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .select("point", (F.col("lo") + F.col("point") * step).alias(out))
    )


def presence_rows(df: DataFrame, feature: str, value: str, above: float) -> DataFrame:
    """Long 0/1 presence over features seen above the threshold at least once."""
    flagged = df.withColumn("present", (F.col(value) > above).cast("int"))
    return keep_groups(flagged, [feature], F.max("present") > 0)


def matrix_melt(pairs: DataFrame, labels: DataFrame, key: str, label: str, value: str, diagonal) -> DataFrame:
    """A symmetric pair table (a, b, value) as the full square (x, y, value) with labels on both sides."""
    sides = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    square = pairs.select(F.explode(sides).alias("_s"), value).select("_s.x", "_s.y", value)
    own = labels.select(F.col(key).alias("x"), F.col(key).alias("y"), F.lit(diagonal).alias(value))
    melted = square.unionByName(own)
    for side in ("x", "y"):
        named = labels.select(F.col(key).alias(side), F.col(label).alias(f"{label}_{side}"))
        melted = skew_join(melted, named, [side], "left", of_pairs=True)
    return melted
