"""Group comparisons for many variables or tables at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.normal import chi_square_p, two_sided_p
from cohortlake.operators.ranks import running_total
from cohortlake.operators.skew import join_null_safe


def wilcoxon_ranksum(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Two-group rank-sum test of each variable.

    ``group`` is boolean; the statistic is the one of the false group. Ranks come
    from counts per distinct value, ties share their mean rank, and p is the
    normal approximation with tie and continuity correction.
    """
    long = (
        df.select(group, *[F.col(v).cast("double").alias(v) for v in variables])
        .unpivot([group], list(variables), "variable", "value")
        .where(F.col("value").isNotNull() & F.col(group).isNotNull())
    )
    per_value = long.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("ties"), F.count_if(~F.col(group)).alias("first")
    )
    return ranksum_of_counts(per_value)


def ranksum_of_counts(per_value: DataFrame) -> DataFrame:
    """The same from ``variable, value, ties, first``: of each distinct value its rows, and those of the first group."""
    ranked = running_total(per_value, ["variable"], [F.col("value")], through=F.col("ties"))
    mid_rank = F.col("through") - (F.col("ties") - 1) / 2.0
    t = F.col("ties").cast("double")
    sums = ranked.groupBy("variable").agg(
        F.sum("first").alias("n_first"),
        F.sum(F.col("ties") - F.col("first")).alias("n_second"),
        F.sum(F.col("first") * mid_rank).alias("_r"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = n1 + n2
    w = F.col("_r") - n1 * (n1 + 1) / 2
    shift = w - n1 * n2 / 2
    # Null where there is no test: an empty group, or one value only.
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    scored = sums.select(
        "variable", "n_first", "n_second", w.alias("w"), F.try_divide(shift - F.signum(shift) * 0.5, sigma).alias("z")
    )
    return scored.withColumn("p_value", two_sided_p("z"))


FISHER_BLOCK = 1 << 18
# Cells likelier than the observed one by less than this (as a logarithm) count as ties.
FISHER_TIE = 1e-7
# Beyond a first term times exp(-46) a tail adds less than the last bit of its sum.
FISHER_REACH = 46.0

_SMALL = np.array([math.lgamma(k + 1.0) - (k + 0.5) * math.log(k or 1) + k - 0.5 * math.log(2 * math.pi) for k in range(16)])
_SMALL[0] = 0.0


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """``ln n!`` less Stirling's leading terms ``(n + 1/2) ln n - n + ln sqrt(2 pi)``; 0 for 0."""
    x = np.maximum(n, 16.0)
    y = 1 / (x * x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """``x ln(x / mean) + mean - x`` without cancellation where the two are close."""
    v = (x - mean) / np.where(x + mean > 0, x + mean, 1.0)
    close = np.abs(v) < 0.1
    w = np.where(close, v, 0.0)
    # x ln(x / mean) = 2 x atanh(v).
    total, power = (x - mean) * w, 2 * x * w
    for k in range(1, 13):
        power = power * w * w
        total = total + power / (2 * k + 1)
    far = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / np.where(mean > 0, mean, 1.0)), 0.0) + mean - x
    return np.where(close, total, far)


def _log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the binomial probability of ``k`` in ``n``, by deviances from the mean."""
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
    scale = np.where((k > 0) & (k < n), 2 * np.pi * np.maximum(k, 1.0) * (np.maximum(n - k, 1.0) / np.maximum(n, 1.0)), 1.0)
    return rest - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) - 0.5 * np.log(scale)


def log_hypergeometric(k: np.ndarray, top: np.ndarray, bottom: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Log probability of ``k`` in the first cell of a 2x2 table with rows ``top``, ``bottom`` and first column ``left``.

    A quotient of three binomials, so nothing of the size of ln n! has to cancel.
    """
    k, top, bottom, left = (np.asarray(v, float) for v in (k, top, bottom, left))
    n = top + bottom
    p = left / np.maximum(n, 1.0)
    return _log_binomial(k, top, p) + _log_binomial(left - k, bottom, p) - _log_binomial(left, n, p)


def _bisect(test, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest whole number in each ``[low, high]`` that passes; ``low`` passes, and all below one that does."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = high - (high - low) // 2
        good = test(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided p values of non-empty tables: the probability of all tables no likelier than theirs.

    Probabilities rise up to the mode and fall after it. So the cells that count are two tails; each
    begins where bisection says and is added up from there outwards, until terms stop to matter.
    """
    top, bottom, left = a + b, c + d, a + c
    lowest, highest = np.maximum(0, left - bottom), np.minimum(top, left)
    mode = ((top + 1).astype(np.longdouble) * (left + 1) / (top + bottom + 2)).astype(np.int64)
    mode = np.clip(mode, lowest, highest)
    limit = log_hypergeometric(a, top, bottom, left) + FISHER_TIE
    out = np.where(log_hypergeometric(mode, top, bottom, left) <= limit, 1.0, 0.0)
    for sign in (1, -1):
        # The upper tail is the lower one of the table with its rows' cells mirrored.
        end = lowest if sign == 1 else highest
        place = lambda k, at: log_hypergeometric(sign * k, top[at], bottom[at], left[at])
        held = np.flatnonzero((out == 0) | (out < 1))
        held = held[log_hypergeometric(end, top, bottom, left)[held] <= limit[held]]
        if not len(held):
            continue
        first = _bisect(lambda k: place(k, held) <= limit[held], sign * end[held], sign * mode[held])
        peak = place(first, held)
        near = place(sign * end[held], held) < peak - FISHER_REACH
        last = sign * end[held]
        if near.any():
            some = held[near]
            last[near] = _bisect(lambda k: place(k, some) < peak[near] - FISHER_REACH, sign * end[some], first[near])
        out[held] += _tails(place, held, first, last)
    return np.minimum(out, 1.0)


def _tails(place, held: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of the probabilities from ``last`` to ``first``, a bounded number of cells at a time."""
    sums, lengths = np.zeros(len(held)), first - last + 1
    done = np.zeros(len(held), np.int64)
    while (done < lengths).any():
        todo = np.flatnonzero(done < lengths)
        take = np.minimum(lengths[todo] - done[todo], FISHER_BLOCK)
        todo = todo[: max(1, int(np.searchsorted(np.cumsum(take), FISHER_BLOCK, "right")))]
        take = take[: len(todo)]
        owner = np.repeat(todo, take)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
        terms = np.exp(place(first[owner] - done[owner] - inner, held[owner]))
        sums[todo] += np.add.reduceat(terms, np.cumsum(take) - take)
        done[todo] += take
    return sums


def fisher_exact(df: DataFrame, keys: Sequence[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Two-sided Fisher exact p of each 2x2 table, one table per row; tables without counts are left out.

    A table stays one row whatever its margins; time grows with the spread of its law, the square
    root of its margins. A table with a null cell has a null p.
    """

    @F.pandas_udf("double")
    def p_value(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        cells = pd.concat([w, x, y, z], axis=1)
        whole = cells.notna().all(axis=1).to_numpy()
        out = np.full(len(cells), np.nan)
        if whole.any():
            out[whole] = fisher_p(*cells[whole].to_numpy(np.int64).T)
        return pd.Series(out).where(whole, None)

    total = F.col(a) + F.col(b) + F.col(c) + F.col(d)
    cells = [F.col(v).cast("long") for v in (a, b, c, d)]
    return df.where(total.isNull() | (total > 0)).select(*keys, p_value(*cells).alias("p_value"))


def chi_square(df: DataFrame, keys: Sequence[str], row: str, column: str, n: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p of each contingency table.

    ``df`` holds the non-empty cells. ``N * (sum of n^2 / (row * column) - 1)`` needs
    no expected count for the empty ones.
    """
    rows = df.groupBy(*keys, row).agg(F.sum(n).alias("_row"))
    columns = df.groupBy(*keys, column).agg(F.sum(n).alias("_col"))
    cells = join_null_safe(join_null_safe(df, rows, [*keys, row]), columns, [*keys, column])
    part = F.col(n) * F.col(n) / (F.col("_row").cast("double") * F.col("_col"))
    sizes = rows.groupBy(*keys).agg(F.sum("_row").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    widths = columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cols"))
    sums = cells.groupBy(*keys).agg(F.sum(part).alias("_s"))
    table = join_null_safe(join_null_safe(sums, sizes, keys), widths, keys)
    scored = table.select(
        *keys,
        (F.col("_n") * (F.col("_s") - 1)).alias("statistic"),
        ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("long").alias("dof"),
    )
    return scored.withColumn("p_value", chi_square_p("statistic", "dof"))
