"""Row predicates: the query form and the record form."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import is_floating, is_numeric
from ..functions.text import MISSING_FILTER, contains_text, is_missing, lowered
from ..table import as_text, col, is_text, loose, strict

if TYPE_CHECKING:
    from ..plans.plan import Filter

COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def _number(text: Any) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def query_predicate(df: DataFrame, f: Filter) -> Column | None:
    """Predicate of a plan filter, for ``where``; None when the filter says nothing.

    ``!=`` keeps nulls, all others drop them. Comparisons read strict numbers, and
    a bound that is no number leaves the filter out. Predicates on typed columns
    name the bare column, so they reach the Parquet reader.
    """
    if f.column not in df.columns:
        return None
    c, dtype = col(f.column), df.schema[f.column].dataType
    if f.operator == "is_null":
        return c.isNull() | F.isnan(c) if is_floating(dtype) else c.isNull()
    if f.operator == "is_not_null":
        return c.isNotNull() & ~F.isnan(c) if is_floating(dtype) else c.isNotNull()
    if f.operator in ("==", "!="):
        literal = _literal(dtype, f.value)
        if literal is None:
            return F.lit(f.operator == "!=")
        return c == literal if f.operator == "==" else ~c.eqNullSafe(literal)
    if f.operator == "contains":
        return None if f.value is None else contains_text(as_text(df, f.column), str(f.value))
    if f.operator in COMPARISONS:
        bound = _number(f.value)
        return None if bound is None else _compared(df, f.column, f.operator, bound)
    return None


def _literal(dtype: T.DataType, value: Any) -> Column | None:
    """The value as a literal that can equal a cell of the type, else None.

    Text never equals a number. Dates and other types compare with the text that
    writes them.
    """
    if value is None:
        return None
    if is_text(dtype):
        return F.lit(value) if isinstance(value, str) else None
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return None if isinstance(value, str) else F.lit(value)
    return F.lit(str(value)).try_cast(dtype) if isinstance(value, str) else F.lit(value)


def _compared(df: DataFrame, name: str, operator: str, bound: float) -> Column:
    c, dtype = col(name), df.schema[name].dataType
    if math.isnan(bound):
        return F.lit(False)
    if isinstance(dtype, T.IntegralType) and math.isfinite(bound) and abs(bound) < 2**62:
        # The whole number on the same side, so that the column needs no cast.
        whole = math.floor(bound) if operator in (">", "<=") else math.ceil(bound)
        return COMPARISONS[operator](c, F.lit(whole))
    if is_floating(dtype):
        # NaN is null, but Spark sorts it above all numbers.
        found = COMPARISONS[operator](c, F.lit(bound))
        return found & ~F.isnan(c) if operator in (">", ">=") else found
    return COMPARISONS[operator](strict(df, name), F.lit(bound))


def apply_filters(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    for f in filters:
        predicate = query_predicate(df, f)
        if predicate is not None:
            df = df.where(predicate)
    return df


def record_predicate(df: DataFrame, field: str, operator: str, target: Any = None) -> Column:
    """Predicate of the record form: text compares stripped and lower-case,
    numbers by their loose reading. Never null, so it can be negated."""
    if field not in df.columns:
        return F.lit(operator == "is_null")
    c = as_text(df, field)
    if operator == "is_null":
        return is_missing(c, MISSING_FILTER)
    if operator == "not_null":
        return ~is_missing(c, MISSING_FILTER)
    wanted = str(target).strip().lower()
    if operator == "==":
        found = lowered(c) == wanted
    elif operator == "!=":
        found = lowered(c) != wanted
    elif operator == "contains":
        found = lowered(c).contains(wanted)
    elif operator in COMPARISONS and _number(target) is not None:
        found = COMPARISONS[operator](loose(df, field), F.lit(_number(target)))
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def filter_records(
    df: DataFrame, field: str, operator: str, target: Any = None, action: str = "keep"
) -> DataFrame:
    """Keep the rows that match, or drop them."""
    matched = record_predicate(df, field, operator, target)
    return df.where(matched if action == "keep" else ~matched)
