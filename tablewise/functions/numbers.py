"""Number readings of untyped cells.

Two readings exist. The strict one accepts text that is a number as a whole;
the loose one keeps digits, dots and minus signs and reads what is left. On
numeric columns both return the column itself, so Parquet filters still push
down and no text step runs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import strip

# Fixed value: text that counts as a number as a whole.
STRICT_NUMBER = (
    r"(?i)^[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf(inity)?)$"
)
# Fixed value: characters the loose reading throws away.
LOOSE_DROP = r"[^0-9.-]+"


def is_floating(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, T.NumericType)


def no_nan(c: Column, dtype: T.DataType | None) -> Column:
    """NaN is null on entry; other types pass unchanged."""
    return F.when(~F.isnan(c), c) if is_floating(dtype) else c


def num_strict(c: Column, dtype: T.DataType | None = None) -> Column:
    """The strict number in ``c`` as a double, null where there is none."""
    if is_numeric(dtype):
        return no_nan(c, dtype).cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    text = strip(c)
    return F.when(text.rlike(STRICT_NUMBER), text.try_cast("double"))


def num_loose(c: Column, dtype: T.DataType | None = None) -> Column:
    """The loose number in ``c`` as a double, null where there is none."""
    if is_numeric(dtype):
        return no_nan(c, dtype).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("double")
    return F.regexp_replace(c.cast("string"), LOOSE_DROP, "").try_cast("double")


def to_integer(c: Column, dtype: T.DataType | None = None) -> Column:
    """Whole number, cut towards zero; null where the text holds no number."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    return num_loose(c, dtype).try_cast("long")


def bin_index(v: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Equal-width bin of ``v``: half-open bins, the last one closed.

    A constant column is widened by one half on each side. The quotient can
    land one bin off because of rounding, so it is compared with the edges of
    the bin it fell into and moved by at most one.
    """
    low, high = widened(lo, hi)
    step = (high - low) / bins
    guess = F.least(bins - 1, F.floor((v - low) / step).cast("int"))
    edge = low + guess * step
    above = low + (guess + 1) * step
    return (
        F.when(v < edge, guess - 1)
        .when((v >= above) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    same = lo == hi
    return (
        F.when(same, lo - F.lit(0.5)).otherwise(lo),
        F.when(same, hi + F.lit(0.5)).otherwise(hi),
    )


def bin_edge(lo: Column, hi: Column, bins: Column, k: Column) -> Column:
    """The ``k``-th edge; the outer two are the bounds themselves."""
    low, high = widened(lo, hi)
    return F.when(k == bins, high).otherwise(low + k * ((high - low) / bins))


def display(c: Column, dtype: T.DataType | None) -> Column:
    """Value as shown: floats to 4 places, NaN and infinities to null."""
    if is_floating(dtype):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return F.when(finite, F.round(c.cast("double"), 4))
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.StringType)):
        return c
    return c.cast("string")
