"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target / source size.
Its whole part is taken; the fractions are rounded dependently: a pair of documents trades
mass (fraction times size) in a random direction until one fraction is 0 or 1, so the
source's words never change and every expectation holds. Bounded groups of a source round
apart; the one fraction each leaves climbs a reduction tree until one per source is left.

Choices are hashes of ids and levels, so reruns and retried tasks agree.

Rows: a null text has size 0; null sources are one source, the last in order. Rows that agree
in id, source and size are decided together. A source of size 0 has target 0. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.words import count_words, free_name, mix
from cohortlake.operators.ranks import running_total, with_position
from cohortlake.operators.skew import join_null_safe, skew_join
from cohortlake.session import materialize

GROUP_ROWS = 1024
FAN_IN = 64


def source_targets(totals: DataFrame, weights: tuple[int, ...], percent: int, ceiling: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat along the sources in code point order, null last. All sources share
    ``percent`` of all sizes by weight, but none gets more than ``ceiling`` times its size;
    what is left over is shared again by weight. Sorted by ceiling / weight, the sources at
    their ceiling come first, so running sums give the final share of a unit of weight.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = with_position(totals, [], order)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = materialize(
        placed.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
            .cast("long")
            .alias("weight"),
            (F.col("source_size") * ceiling).alias("cap"),
        ),
        "weights",
    )
    sums = running_total(
        weighted.withColumns({"own_cap": F.col("cap"), "own_weight": F.col("weight")}),
        [],
        [F.col("own_cap") / F.col("own_weight"), *order],
        with_totals=True,
        cap=F.col("cap"),
        weight=F.col("weight"),
    )
    wanted = F.col("cap_total") * percent / (100 * ceiling)
    unit = (wanted - (F.col("cap") - F.col("own_cap"))) / (F.col("weight_total") - F.col("weight") + F.col("own_weight"))
    free = F.col("own_cap") >= unit * F.col("own_weight")
    level = sums.where(free).agg(F.min_by(unit, F.struct(F.col("own_cap") / F.col("own_weight"), *order)).alias("unit"))
    return weighted.withColumn("unit", level.scalar()).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("unit") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def pivotal(keys: np.ndarray, sizes: np.ndarray, fractions: np.ndarray, level: int) -> np.ndarray:
    """Fractions after rounding all but at most one of them to 0 or 1; their mass stays the same."""
    p, s = fractions.astype(float).copy(), sizes.astype(float)
    alive = np.lexsort((s, keys))
    alive = alive[(p[alive] > 0) & (p[alive] < 1)]
    turn = 0
    while len(alive) > 1:
        even = len(alive) // 2 * 2
        i, j = alive[0:even:2], alive[1:even:2]
        gain_i = np.minimum((1 - p[i]) * s[i], p[j] * s[j])
        gain_j = np.minimum(p[i] * s[i], (1 - p[j]) * s[j])
        salt = np.uint64(level * 1_000_003 + turn)
        draw = mix(keys[i] * np.uint64(0x9E3779B97F4A7C15) + mix(keys[j] + salt)) / 2.0**64
        up = np.where(draw * (gain_i + gain_j) < gain_j, i, j)
        down = np.where(up == i, j, i)
        room, stock = (1 - p[up]) * s[up], p[down] * s[down]
        filled = room <= stock
        moved = np.where(filled, room, stock)
        p[up] = np.where(filled, 1.0, np.minimum(1.0, p[up] + moved / s[up]))
        p[down] = np.where(stock <= room, 0.0, np.maximum(0.0, p[down] - moved / s[down]))
        rest = alive[even:]
        alive = np.stack([i, j], 1).ravel()
        alive = np.r_[alive[(p[alive] > 0) & (p[alive] < 1)], rest]
        turn += 1
    return p


def _round_groups(rows: DataFrame, level: int) -> DataFrame:
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).astype(np.uint64)
        return pdf.assign(fraction=pivotal(keys, pdf["mass"].to_numpy(), pdf["fraction"].to_numpy(), level))

    return rows.groupBy("source", "part").applyInPandas(run, schema)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    ceiling: int = 2,
) -> DataFrame:
    """``id, source, size, rows, source_size, target, copies`` for each distinct (id, source, size).

    ``rows`` counts the input rows that agree in these; each of them is to be taken ``copies`` times.
    """
    sized = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"))
    units = materialize(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    totals = materialize(
        units.groupBy("source").agg(
            F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units")
        ),
        "totals",
    )
    targets = source_targets(totals.select("source", "source_size"), weights, percent, ceiling)
    known = materialize(join_null_safe(totals, targets.drop("source_size"), ["source"]), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64("id", "size")
    rows = skew_join(units, known, ["source"]).select(
        "id",
        "source",
        "size",
        "rows",
        "source_size",
        "target",
        F.floor(rate).cast("int").alias("whole"),
        (rate - F.floor(rate)).alias("fraction"),
        (F.col("size") * F.col("rows")).alias("mass"),
        key.alias("key"),
        F.pmod(F.xxhash64(key, F.lit("part")), F.ceil(F.col("units") / GROUP_ROWS)).alias("part"),
    )
    open_rows = (F.col("fraction") > 0) & (F.col("fraction") < 1) & (F.col("mass") > 0)
    rows = materialize(rows, "fractions")
    done = [rows.where(~open_rows)]
    rest, level = rows.where(open_rows), 0
    while True:
        rounded = materialize(_round_groups(rest, level), "rounded")
        done.append(rounded.where(~open_rows))
        rest = rounded.where(open_rows)
        if rest.where("part > 0").isEmpty():
            break
        rest = rest.withColumn("part", F.floor(F.col("part") / FAN_IN))
        level += 1
    # At most one fraction per source is left: the last draw.
    done.append(rest)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    draw = (F.pmod(F.xxhash64("key", F.lit("last")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    extra = F.when(draw < F.col("fraction"), 1).otherwise(0)
    return whole.select(
        "id", "source", "size", "rows", "source_size", "target", (F.col("whole") + extra).cast("int").alias("copies")
    )


def take_mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The table's rows, each as often as the mix takes it."""
    plan = materialize(mix_sources(df, id_col, source, text, **options), "mix")
    names = free_name(df, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_copy")
    chosen = plan.where("copies > 0").select(
        F.col("id").alias(names["mix_id"]),
        F.col("source").alias(names["mix_source"]),
        F.col("size").alias(names["mix_size"]),
        F.col("copies").alias(names["mix_copies"]),
    )
    same: Column = (
        F.col(id_col).eqNullSafe(F.col(names["mix_id"]))
        & F.col(source).eqNullSafe(F.col(names["mix_source"]))
        & (count_words(F.col(text)) == F.col(names["mix_size"]))
    )
    # One plan at any size: the texts are shuffled once.
    joined = df.hint("merge").join(chosen, same)
    copy = F.explode(F.sequence(F.lit(1), F.col(names["mix_copies"])))
    return joined.withColumn(names["mix_copy"], copy).select(df.columns)
