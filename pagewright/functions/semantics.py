"""Value rules that differ between a browser / NumPy program and Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a browser trims (includes U+3000, NBSP and BOM).
BROWSER_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BROWSER_SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# The characters that make a text count as Chinese, Japanese or Korean.
CJK_CLASS = r"[\x{4E00}-\x{9FA5}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null and NaN become `low`. `value` occurs once: copies of a long one make code that the JVM never compiles."""
    return F.least(F.greatest(F.nanvl(value, F.lit(low)), F.lit(low)), F.lit(high))  # greatest skips nulls


def text_or(value: Column, default: str) -> Column:
    """`default` for a null or empty text."""
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def number_or(value: Column, default: float) -> Column:
    """`default` for null, NaN and zero."""
    return F.when(value.isNull() | F.isnan(value) | (value == 0), F.lit(default)).otherwise(value)


def browser_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(BROWSER_SPACE_CHARS))


def round_half_up(value: Column) -> Column:
    """Nearest whole number, .5 goes up also below zero."""
    return F.floor(value + 0.5)


def has_cjk(value: Column) -> Column:
    return F.coalesce(value.rlike(CJK_CLASS), F.lit(False))


def median_avg_trunc(value: Column) -> Column:
    """Median that averages the middle pair, then drops the fraction. An aggregate."""
    return F.floor(F.median(value)).cast("int")


def median_upper(value: str) -> Column:
    """Median that takes the upper of the middle pair. An aggregate.

    Counts values instead of listing them, so its state is bounded by the
    number of distinct values (256 for a colour channel).
    """
    return F.expr(f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC) AS INT)")
