"""Posterior draws: summaries, intervals, convergence diagnostics.

Draws are long rows (param, chain, iter, draw) with ``iter`` running 1..n in each
chain of a parameter, or any other numbers in that order: only positions count. Chains may
differ in length. Every draw counts once: variances within chains are pooled over draws, means
are weighted by their draws, a chain is halved at its own middle (an odd one's middle draw
goes to the second half), and products of an autocovariance are divided by all draws. With
chains of one length these are the usual formulas.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.labels import first_number
from cohortlake.functions.normal import normal_quantile
from cohortlake.operators.ranks import exact_quantiles, running_total, value_counts, with_position
from cohortlake.operators.skew import join_null_safe, skew_join
from cohortlake.session import cut_lineage, materialize

LAG_BLOCK = 2048
FIRST_LAGS = 64


def sign_flags(df: DataFrame, widths: dict[str, tuple[str, str]]) -> DataFrame:
    """Whether each interval lies wholly above or below zero: ``<name>_pos``, ``<name>_neg``."""
    flags = []
    for name, (low, high) in widths.items():
        flags.append(((F.col(low) > 0) & (F.col(high) > 0)).alias(f"{name}_pos"))
        flags.append(((F.col(low) < 0) & (F.col(high) < 0)).alias(f"{name}_neg"))
    return df.select("*", *flags)


def sign_error(df: DataFrame, keys: Sequence[str], draw: str, limit: float = 0.05) -> DataFrame:
    """Smaller share of draws on either side of zero, and whether it is below the limit."""
    above = F.avg((F.col(draw) > 0).cast("double"))
    below = F.avg((F.col(draw) < 0).cast("double"))
    return (
        df.groupBy(*keys)
        .agg(F.least(above, below).alias("type_s"))
        .withColumn("certain", F.col("type_s") < limit)
    )


def central_interval(df: DataFrame, keys: Sequence[str], draw: str, prob: float) -> DataFrame:
    """Equal-tail interval and median."""
    return exact_quantiles(df, keys, draw, {"pi_low": (1 - prob) / 2, "pi_high": (1 + prob) / 2, "median": 0.5})


def hpdi(df: DataFrame, keys: Sequence[str], draw: str, prob: float, order: Sequence[Column]) -> DataFrame:
    """Shortest interval holding the given share of draws; the lowest of equals.

    Each sorted draw is joined to the one ``gap`` places on. ``order`` breaks ties
    between equal draws.
    """
    ranked = running_total(
        df.where(F.col(draw).isNotNull()), keys, [F.col(draw), *order], with_totals=True, _at=F.lit(1).cast("long")
    ).select(*keys, F.col(draw).alias("_draw"), "_at", F.col("_at_total").alias("_n"))
    # One draw is an interval of its own.
    gap = F.greatest(F.least(F.lit(1), F.col("_n") - 1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(prob)).cast("long")))
    low = ranked.select(*keys, F.col("_draw").alias("hpdi_low"), (F.col("_at") + gap).alias("_at"))
    high = ranked.select(*keys, F.col("_draw").alias("hpdi_high"), "_at")
    spans = join_null_safe(low, high, [*keys, "_at"])
    best = F.min(F.struct((F.col("hpdi_high") - F.col("hpdi_low")).alias("width"), "hpdi_low", "hpdi_high"))
    return spans.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.hpdi_low", "_b.hpdi_high")


def placed_draws(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, ``chain``, ``iter`` renumbered 1, 2, ... in each chain, ``length`` of the chain, ``draw``; written once."""
    ordered = draws.select(*keys, "chain", F.col("iter").alias("_iter"), "draw")
    placed = running_total(
        ordered, [*keys, "chain"], [F.col("_iter")], with_totals=True, iter=F.lit(1).cast("long")
    )
    return materialize(placed.withColumnRenamed("iter_total", "length").drop("_iter"), "placed-draws")


def _spread(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``groups``, ``draws``, ``within`` and ``between`` variance of groups ``_n, _mean, _var`` of any sizes."""
    # One row for each chain or half of one: a few per key.
    whole = Window.partitionBy(*keys)
    grand = F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)
    off = F.col("_n") * (F.col("_mean") - F.col("_grand")) * (F.col("_mean") - F.col("_grand"))
    inside = F.coalesce((F.col("_n") - 1) * F.col("_var"), F.lit(0.0))
    count = F.count(F.lit(1))
    return (
        groups.withColumn("_grand", grand)
        .groupBy(*keys)
        .agg(
            count.alias("groups"),
            F.sum("_n").alias("draws"),
            (F.sum(inside) / F.nullif(F.sum(F.col("_n") - 1), F.lit(0))).alias("within"),
            (F.sum(off) * count / F.sum("_n") / F.nullif(count - 1, F.lit(0))).alias("between"),
        )
    )


def _overall(within: Column, between: Column) -> Column:
    return (F.col("draws") - F.col("groups")) / F.col("draws") * within + between


def _rhat_of(placed: DataFrame, keys: Sequence[str], draw: str) -> DataFrame:
    half = (F.col("iter") > F.floor(F.col("length") / 2)).alias("_half")
    halves = placed.groupBy(*keys, "chain", half).agg(
        F.avg(draw).alias("_mean"), F.var_samp(draw).alias("_var"), F.count(F.lit(1)).alias("_n")
    )
    total = _overall(F.col("within"), F.col("between"))
    return _spread(halves, keys).select(*keys, F.sqrt(total / F.nullif("within", F.lit(0.0))).alias("rhat"))


def split_rhat(draws: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Potential scale reduction with every chain split at its own middle."""
    return _rhat_of(placed_draws(draws, keys), keys, "draw")


def rank_rhat(draws: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """The same on normal scores of the draws' ranks within the parameter."""
    keys = list(keys)
    placed = placed_draws(draws, keys)
    ranks = value_counts(placed, keys, "draw").select(
        *keys,
        "draw",
        (
            (F.col("through") - (F.col("ties") - 1) / 2.0 - 0.375) / (F.col("through_total") + 0.25)
        ).alias("_p"),
        F.col("ties").alias("_ties"),
    )
    scores = cut_lineage(ranks.select(*keys, "draw", normal_quantile("_p").alias("_z"), "_ties"))
    return _rhat_of(skew_join(placed, scores, [*keys, "draw"], rows="_ties"), keys, "_z")


def autocovariance(centered: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Sums of products of centred draws ``lag`` apart, for lags first..last.

    Chains are cut into blocks of ``LAG_BLOCK`` iterations. A task sees two blocks a
    fixed distance apart and correlates them; no task sees a whole chain. Of a block that
    is met from afar only the rows within reach of these lags are sent.
    """
    keys = [*keys, "chain"]
    size = LAG_BLOCK
    reach = [g for g in range(last // size + 2) if max(first, (g - 1) * size + 1) <= min(last, (g + 1) * size - 1)]
    block = F.floor((F.col("iter") - 1) / size)
    copies = F.explode(F.array(*[F.struct(F.lit(d).alias("gap"), F.lit(s).alias("late")) for d in reach for s in ((0, 1) if d else (0,))]))
    tiled = (
        centered.select(*keys, ((F.col("iter") - 1) % size).cast("int").alias("at"), block.alias("block"), "value")
        .withColumn("copy", copies)
        .select(
            *keys,
            (F.col("block") - F.when(F.col("copy.late") == 1, F.col("copy.gap")).otherwise(0)).alias("start"),
            F.col("copy.gap").alias("gap"),
            F.col("copy.late").alias("late"),
            "at",
            "value",
        )
        .where(F.col("start") >= 0)
    )
    # A lag is gap * size + (place in the later block) - (place in the earlier one).
    least = F.when(F.col("late") == 1, F.col("at") - (size - 1)).otherwise(-F.col("at"))
    nearest = F.col("gap") * size + least
    tiled = tiled.where((F.col("gap") == 0) | ((nearest <= last) & (nearest + size - 1 >= first)))
    types = ", ".join(f"`{k}` {centered.schema[k].dataType.simpleString()}" for k in keys)

    def correlate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gap = key[-1]
        early, late = np.zeros(size), np.zeros(size)
        is_late = pdf["late"].to_numpy() == 1
        at, value = pdf["at"].to_numpy(), pdf["value"].to_numpy()
        early[at[~is_late]] = value[~is_late]
        if gap:
            late[at[is_late]] = value[is_late]
        else:
            late = early
        width = 1 << (2 * size - 1).bit_length()
        product = np.fft.irfft(np.fft.rfft(late, width) * np.conj(np.fft.rfft(early, width)), width)
        lags = np.arange(max(first, (gap - 1) * size + 1, 0), min(last, (gap + 1) * size - 1) + 1)
        sums = product[(lags - gap * size) % width]
        return pd.DataFrame({**{k: [key[i]] * len(lags) for i, k in enumerate(keys)}, "lag": lags, "s": sums})

    return (
        tiled.groupBy(*keys, "start", "gap")
        .applyInPandas(correlate, f"{types}, lag int, s double")
        .groupBy(*keys, "lag")
        .agg(F.sum("s").alias("s"))
    )


def effective_size(draws: DataFrame, keys: Sequence[str] = ("param",), first_lags: int = FIRST_LAGS) -> DataFrame:
    """``chains``, ``draws`` and effective sample size ``n_eff`` from autocorrelation over chains.

    Correlations are added in pairs while the pairs stay positive, each held at
    or below the one before. Lags are worked out in growing ranges, after the first one only for
    the parameters that have not reached their end, so none is cut short.
    """
    return _effective_size(placed_draws(draws, list(keys)), list(keys), first_lags)


def _effective_size(placed: DataFrame, keys: list[str], first_lags: int = FIRST_LAGS) -> DataFrame:
    per_chain = cut_lineage(
        placed.groupBy(*keys, "chain").agg(
            F.avg("draw").alias("_mean"), F.count(F.lit(1)).alias("_n"), F.var_samp("draw").alias("_var")
        )
    )
    # Gone over once for every range of lags.
    centered = materialize(
        skew_join(placed, per_chain.drop("_var"), [*keys, "chain"], rows="_n").select(
            *keys, "chain", "iter", (F.col("draw") - F.col("_mean")).alias("value")
        ),
        "centered",
    )
    longest_chain = per_chain.groupBy(*keys).agg(F.max("_n").alias("longest"))
    spread = cut_lineage(join_null_safe(_spread(per_chain, keys), longest_chain, keys))
    longest = spread.agg(F.max("longest")).first()[0] or 0
    known, open_keys, first, last = None, None, 0, min(first_lags, longest) - 1
    # Only ever one row per (param, lag), so the union stays narrow.
    pooled = Window.partitionBy(*keys).orderBy("_pair")
    while True:
        still = centered if open_keys is None else skew_join(centered, open_keys, keys, "left_semi")
        fresh = cut_lineage(
            autocovariance(still, keys, first, last).groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
        )
        known = fresh if known is None else known.unionByName(fresh)
        total = _overall(F.col("within"), F.coalesce("between", F.lit(0.0)))
        rho = F.when(F.col("lag") == 0, F.when(total > 0, F.lit(1.0))).otherwise(
            1 - (F.col("within") - F.col("s") / F.col("draws")) / F.nullif(total, F.lit(0.0))
        )
        pairs = (
            join_null_safe(known, spread, keys)
            .where(F.col("lag") < F.col("longest"))
            .select(*keys, "groups", "draws", "longest", F.floor(F.col("lag") / 2).alias("_pair"), rho.alias("_rho"))
            .groupBy(*keys, "groups", "draws", "longest", "_pair")
            .agg(F.sum("_rho").alias("_p"), F.count(F.lit(1)).alias("_both"))
            .where(F.col("_both") == 2)
        )
        held = pairs.select(
            "*", F.min("_p").over(pooled.rowsBetween(Window.unboundedPreceding, 0)).alias("_low")
        )
        ended = held.groupBy(*keys).agg(
            F.max("groups").alias("chains"),
            F.max("draws").alias("draws"),
            F.max("longest").alias("longest"),
            F.sum(F.when(F.col("_low") > 0, F.col("_low"))).alias("_sum"),
            F.min("_low").alias("_end"),
        )
        unended = ended.where((F.col("_end") > 0) & (F.col("longest") > last + 1))
        if last + 1 < longest:
            open_keys = cut_lineage(unended.select(*keys))
        if last + 1 >= longest or open_keys.isEmpty():
            # Draws that swing around their mean carry more than one draw each, within a bound.
            least = 1 / F.log10(F.greatest("draws", F.lit(10)))
            size = F.col("draws") / F.greatest(2 * F.col("_sum") - 1, least)
            size = F.when(F.col("_sum").isNotNull(), size)
            return ended.select(*keys, "chains", "draws", size.alias("n_eff"))
        first, last = last + 1, min(2 * (last + 1), longest) - 1


def draw_summary(draws: DataFrame, probs: dict[str, float], keys: Sequence[str] = ("param",)) -> DataFrame:
    """Mean, sd, Monte-Carlo error, effective size, scale reduction and quantiles, all over the same draws."""
    keys = list(keys)
    placed = placed_draws(draws, keys)
    moments = placed.groupBy(*keys).agg(F.avg("draw").alias("mean"), F.stddev_samp("draw").alias("sd"))
    size = _effective_size(placed, keys).select(*keys, "n_eff")
    out = join_null_safe(join_null_safe(moments, size, keys, "left"), _rhat_of(placed, keys, "draw"), keys)
    out = out.withColumn("se_mean", F.col("sd") / F.sqrt("n_eff"))
    return join_null_safe(out, exact_quantiles(placed, keys, "draw", probs), keys)


# --- sampler diagnostics -------------------------------------------------------------------


def divergences(sampler: DataFrame) -> DataFrame:
    return sampler.agg(
        F.sum("divergent").alias("n"),
        F.count(F.lit(1)).alias("iterations"),
        (F.sum("divergent") * 100.0 / F.count(F.lit(1))).alias("percent"),
    )


def saturated_depth(sampler: DataFrame, max_depth: int = 10) -> DataFrame:
    hit = F.count_if(F.col("treedepth") == max_depth)
    return sampler.agg(
        hit.alias("n"), F.count(F.lit(1)).alias("iterations"), (hit * 100.0 / F.count(F.lit(1))).alias("percent")
    )


def energy_fraction(sampler: DataFrame, limit: float = 0.2) -> DataFrame:
    """Per chain: squared energy steps over energy variance, divided by the row count.

    Steps are taken inside blocks of iterations; the last row of a block is copied
    into the next, so every step is seen once and no task sorts a whole chain. Blocks
    go by position, so iteration numbers may have gaps.
    """
    size = LAG_BLOCK
    placed = with_position(
        sampler.select("chain", F.col("iter").alias("_iter"), "energy"), ["chain"], [F.col("_iter")], "iter"
    )
    block = F.floor(F.col("iter") / size)
    lead_in = F.when(F.col("iter") % size == size - 1, F.array(block, block + 1)).otherwise(F.array(block))
    blocks = placed.select("chain", "iter", "energy", F.explode(lead_in).alias("_block"))
    inside = Window.partitionBy("chain", "_block").orderBy("iter")
    step = F.col("energy") - F.lag("energy").over(inside)
    steps = (
        blocks.withColumn("_step", step)
        .groupBy("chain")
        .agg(F.sum(F.col("_step") * F.col("_step")).alias("_steps"))
    )
    spread = sampler.groupBy("chain").agg(F.count(F.lit(1)).alias("_n"), F.var_samp("energy").alias("_var"))
    fraction = F.col("_steps") / F.col("_n") / F.nullif(F.col("_var"), F.lit(0.0))
    return steps.join(spread, "chain").select(
        "chain", fraction.alias("e_bfmi"), (fraction < limit).alias("low")
    )


def diagnostic_report(draws: DataFrame, sampler: DataFrame) -> DataFrame:
    """All checks as rows (check, item, value, ok)."""
    placed = placed_draws(draws, ["param"])
    size = _effective_size(placed, ["param"]).select(
        F.lit("n_eff").alias("check"),
        F.col("param").cast("string").alias("item"),
        (F.col("n_eff") / F.col("draws")).alias("value"),
    )
    size = size.withColumn("ok", F.coalesce(~(F.col("value") < 0.001), F.lit(False)))
    scale = _rhat_of(placed, ["param"], "draw").select(
        F.lit("rhat").alias("check"), F.col("param").cast("string").alias("item"), F.col("rhat").alias("value")
    )
    bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") > 1.1) | (F.col("value") == float("inf"))
    scale = scale.withColumn("ok", ~bad)
    energy = energy_fraction(sampler).select(
        F.lit("energy").alias("check"), F.col("chain").cast("string").alias("item"), F.col("e_bfmi").alias("value"),
        (~F.col("low")).alias("ok"),
    )
    parts = [size, scale, energy]
    for name, table in (("divergence", divergences(sampler)), ("treedepth", saturated_depth(sampler))):
        parts.append(
            table.select(
                F.lit(name).alias("check"),
                F.lit("all").alias("item"),
                F.col("n").cast("double").alias("value"),
                (F.col("n") == 0).alias("ok"),
            )
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def partition_divergent(draws: DataFrame, sampler: DataFrame) -> DataFrame:
    """Draws with the divergence flag of their iteration."""
    return skew_join(draws, sampler.select("chain", "iter", "divergent").where("chain IS NOT NULL AND iter IS NOT NULL"), ["chain", "iter"])


def extreme_partners(
    pairs: DataFrame, targets: DataFrame, labels: DataFrame, value: str, n: int, order: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    """The ``n`` lowest values between the targets and their partners, with the partner's genus and label.

    ``pairs``: ``feature_x, feature_y, <value>`` and others, each pair once in any order; ``targets``: ``feature_x``;
    ``labels``: ``feature, genus``, one row per feature. The label is the genus over the partner's id in brackets; a
    partner without a genus keeps its id. Null values are left out; values tie after rounding, then ``order`` decides.
    """
    others = [c for c in pairs.columns if c not in ("feature_x", "feature_y", value)]
    turned = pairs.select(*others, F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"), value)
    wanted = targets.select("feature_x").where("feature_x IS NOT NULL").distinct()
    rows = skew_join(pairs.unionByName(turned).where(F.col(value).isNotNull()), wanted, ["feature_x"], "left_semi")
    rounded = rows.withColumn(value, F.round(value, digits) + 0.0)
    keys = [F.col(c) for c in (value, *order, "feature_x", "feature_y")]
    lowest = rounded.orderBy(*keys).limit(n)
    named = skew_join(lowest, labels.select(F.col("feature").alias("feature_y"), "genus"), ["feature_y"], "left")
    bracket = F.concat(F.lit("\n("), F.col("feature_y").cast("string"), F.lit(")"))
    label = F.when(F.col("genus").isNull(), F.col("feature_y").cast("string")).otherwise(F.concat("genus", bracket))
    return named.select(*others, "feature_x", "feature_y", value, F.col("genus").alias("genus_y"), label.alias("label_y"))


def label_parameters(summary: DataFrame, index: DataFrame, labels: DataFrame, number: str, feature: str) -> DataFrame:
    """Summary rows with the feature behind the number in their parameter name."""
    numbered = summary.withColumn(number, first_number("parameter").cast("long"))
    named = skew_join(numbered, index, [number], "left")
    return skew_join(named, labels, [feature], "left").withColumn(
        "param_lab", F.concat("parameter", F.lit("\n"), F.col(feature).cast("string"))
    )
