"""Normal tails, normal quantiles, factorials and chi-square tails as SQL expressions.

Spark has no error function or log-gamma. The approximations are built as SQL
text, so they stay inside generated code and read the same in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev fit of ln(erfc) with relative error below 1.2e-7 (fixed values).
ERFC = [
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
]

# Rational fit of the normal quantile with relative error below 1.2e-9 (fixed values).
QUANTILE_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
QUANTILE_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
QUANTILE_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
QUANTILE_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
QUANTILE_EDGE = 0.02425


def _number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _horner(coefficients: list[float], x: str) -> str:
    """Polynomial with the highest power first."""
    text = _number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_number(c)})"
    return text


def erfc_sql(x: str) -> str:
    """Complementary error function of a non-negative expression."""
    t = f"(1 / (1 + 0.5 * ({x})))"
    return f"({t} * exp(-({x}) * ({x}) + {_horner(ERFC[::-1], t)}))"


def two_sided_p_sql(z: str) -> str:
    return f"least({_number(1.0)}, {erfc_sql(f'(abs({z}) / sqrt({_number(2.0)}))')})"


def normal_quantile_sql(p: str) -> str:
    low = f"sqrt(-2 * ln({p}))"
    high = f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    tail = f"({_horner(QUANTILE_C, '{t}')} / {_horner(QUANTILE_D, '{t}')})"
    return (
        f"CASE WHEN ({p}) < {QUANTILE_EDGE} THEN {tail.replace('{t}', low)} "
        f"WHEN ({p}) > 1 - {QUANTILE_EDGE} THEN -{tail.replace('{t}', high)} "
        f"ELSE {_horner(QUANTILE_A, r)} * {q} / {_horner(QUANTILE_B[:-1] + [1.0], r)} END"
    )


def two_sided_p(z: str) -> Column:
    """Two-sided normal p of the column named ``z``; null where that is null."""
    return F.when(F.col(z).isNotNull(), F.expr(two_sided_p_sql(z)))


def normal_quantile(p: str) -> Column:
    """Standard normal quantile of the column named ``p``."""
    return F.expr(normal_quantile_sql(p))


def log_factorial(n: Column) -> Column:
    """ln(n!) for any non-negative integer: exact below ten, Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    x = n.cast("double") + 1
    series = (
        (x - 0.5) * F.log(x)
        - x
        + F.lit(0.5 * math.log(2 * math.pi))
        + 1 / (12 * x)
        - 1 / (360 * F.pow(x, F.lit(3)))
        + 1 / (1260 * F.pow(x, F.lit(5)))
        - 1 / (1680 * F.pow(x, F.lit(7)))
    )
    return F.when(n < 10, F.element_at(small, F.least(n, F.lit(9)).cast("int") + 1)).otherwise(series)


def chi_square_p(statistic: str, dof: str) -> Column:
    """Upper tail of the chi-square law: a finite sum for any whole degree of freedom.

    Even: ``exp(-h) * sum h^i / i!``. Odd: ``erfc(sqrt(h))`` plus the same with half
    powers; ``h`` is half the statistic. Terms are carried as logarithms, so large
    statistics do not vanish before the terms that count.
    """
    h = F.col(statistic) / 2
    steps = F.floor(F.col(dof) / 2).cast("int")
    odd = F.col(dof) % 2 == 1
    state = F.struct(
        F.when(odd, F.log(h) / 2 - h + math.log(2 / math.sqrt(math.pi))).otherwise(-h).alias("term"),
        F.lit(0.0).alias("sum"),
    )
    offset = F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0))
    series = F.aggregate(
        F.sequence(F.lit(0), steps),
        state,
        lambda s, i: F.struct(
            (s["term"] + F.log(h) - F.log(i + offset)).alias("term"),
            F.when(i < steps, s["sum"] + F.exp(s["term"])).otherwise(s["sum"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    root = f"sqrt({statistic} / 2)"
    tail = F.when(odd, F.expr(erfc_sql(root)) + series).otherwise(series)
    return F.when(h <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))
