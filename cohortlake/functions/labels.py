"""Text, label and flag expressions, null-safe where the result is stored or negated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(column: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Regex test that is false, not null, for missing text."""
    text = F.lower(_col(column)) if ignore_case else _col(column)
    return F.coalesce(text.rlike(pattern.lower() if ignore_case else pattern), F.lit(False))


def compose(*parts: Column | str, sep: str = "", missing: str = "NA") -> Column:
    """Join fields into one label; a missing field shows as a marker."""
    return F.concat_ws(sep, *[F.coalesce(_col(p).cast("string"), F.lit(missing)) for p in parts])


def extract_first(column: Column | str, pattern: str, default: str | None = None) -> Column:
    """First match of a pattern, else the default."""
    found = F.nullif(F.regexp_extract(_col(column), f"({pattern})", 1), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def pad_left(column: Column | str, width: int, fill: str = "0") -> Column:
    """Left-pad without ever cutting the text."""
    text = _col(column).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def strip_patterns(column: Column | str, patterns: Sequence[str]) -> Column:
    """Remove every match of the given patterns."""
    return F.regexp_replace(_col(column), "|".join(patterns), "")


def first_number(column: Column | str) -> Column:
    """First number inside a text, as a double; null when there is none."""
    found = F.regexp_extract(_col(column), r"(-?\d+(\.\d+)?)", 1)
    return F.nullif(found, F.lit("")).cast("double")


def signif(column: Column | str, digits: int) -> Column:
    """Round to significant digits."""
    x = _col(column)
    scale = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    factor = F.pow(F.lit(10.0), scale)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * factor) / factor)


def number_text(column: Column | str) -> Column:
    """Plain decimal text without trailing zeros; scientific where ten decimals would lose the number."""
    x = _col(column)
    plain = F.regexp_replace(x.cast("decimal(30,10)").cast("string"), r"\.?0+$", "")
    return F.when((x != 0) & (F.abs(x) < 1e-7), F.regexp_replace(x.cast("string"), r"\.0E", "E")).otherwise(plain)


def interval_label(middle: Column | str, low: Column | str, high: Column | str, digits: int = 3) -> Column:
    """``"m (lo - hi)"`` with significant digits."""
    m, lo, hi = (number_text(signif(c, digits)) for c in (middle, low, high))
    return F.concat(m, F.lit(" ("), lo, F.lit(" - "), hi, F.lit(")"))


def axis_label(axis: Column | str, share: Column | str) -> Column:
    """``"PCoA Axis.1 (11.4% variance)"``."""
    percent = number_text(F.round(_col(share), 3) * 100)
    return F.concat(F.lit("PCoA "), _col(axis), F.lit(" ("), percent, F.lit("% variance)"))


def certainty_class(low: Column, mid: Column, wide: Column) -> Column:
    """Class of the sign error from flags at 5, 10 and 25 percent."""
    return (
        F.when(low, "< 0.05").when(mid, "< 0.1").when(wide, "< 0.25").otherwise(">= 0.25")
    )
