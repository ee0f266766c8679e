"""Cleaning operations with preview and apply.

Every operation is one projection or one filter. Previews compute old and new
cells side by side, count all changes in one aggregation and read five samples.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, places, urls
from ..functions.hashing import content_hash
from ..functions.numbers import num_loose, to_integer
from ..functions.text import (
    MISSING_REQUIRED,
    TRUE_WORDS,
    blank_to_null,
    change_case,
    collapse,
    is_missing,
    lowered,
    map_value,
)
from ..scale import keep_first
from ..table import as_text, col, data_columns, is_text
from .profile import record_hash

# The operations a caller may ask for.
CELL_OPERATIONS = (
    "trim_whitespace",
    "normalize_blanks",
    "normalize_urls",
    "standardize_dates",
    "normalize_geo",
    "normalize_case",
    "convert_types",
    "fill_missing_constant",
    "map_values",
)
ROW_OPERATIONS = ("remove_duplicates", "drop_missing_required")
OPERATIONS = CELL_OPERATIONS + ROW_OPERATIONS

# Name parts that mark the columns of the named operations.
NAME_PARTS = {
    "normalize_urls": ("url", "website", "link"),
    "standardize_dates": ("date", "time"),
    "normalize_geo": ("location", "city", "country"),
}
LOSSY = ("normalize_case", "convert_types", "map_values")
SAMPLES = 5


@dataclass(frozen=True)
class Preview:
    """``summary``: one row of counts and warnings; ``samples``: up to five rows."""

    summary: DataFrame
    samples: DataFrame


@dataclass(frozen=True)
class Applied:
    """The new table, the identifiers of dropped rows, and the affected count (one row)."""

    table: DataFrame
    dropped: DataFrame
    affected: DataFrame


def _check(operation: str) -> None:
    if operation not in OPERATIONS:
        raise ValueError(f"no such cleaning operation: {operation!r}; known are {', '.join(OPERATIONS)}")


def _targets(df: DataFrame, operation: str, config: Mapping[str, Any]) -> list[str]:
    """Columns the operation may touch: one named, several named, or all."""
    one, several = config.get("field_name"), config.get("fields") or []
    if operation == "fill_missing_constant":
        several = []
    parts = NAME_PARTS.get(operation)
    names = []
    for name in data_columns(df):
        if one and name != one or several and name not in several:
            continue
        if parts and name != one and not any(p in name.lower() for p in parts):
            continue
        names.append(name)
    return names


def _converted(df: DataFrame, name: str, target: str) -> Column:
    c, dtype = col(name), df.schema[name].dataType
    if target in ("number", "integer", "int"):
        if isinstance(dtype, T.BooleanType):
            return c.cast("long")
        return to_integer(c, dtype)
    if target in ("float", "decimal"):
        return num_loose(c, dtype)
    if target in ("boolean", "bool"):
        text = as_text(df, name)
        return F.when(text.isNotNull(), lowered(text).isin(list(TRUE_WORDS)))
    return as_text(df, name)


def _constant(value: Any, dtype: T.DataType) -> Column:
    literal = F.lit(None if value is None else str(value))
    return literal if is_text(dtype) else literal.try_cast(dtype)


def new_cells(df: DataFrame, operation: str, config: Mapping[str, Any]) -> dict[str, Column]:
    """New value of every column the operation may change."""
    named = bool(config.get("field_name") or config.get("fields"))
    cells: dict[str, Column] = {}
    for name in _targets(df, operation, config):
        c, dtype = col(name), df.schema[name].dataType
        if operation == "convert_types":
            cells[name] = _converted(df, name, config.get("target_type", "string"))
        elif operation == "fill_missing_constant":
            cells[name] = F.coalesce(c, _constant(config.get("constant_value", ""), dtype))
        elif operation == "map_values":
            mapping = config.get("mapping") or {}
            mapped = map_value(as_text(df, name), mapping)
            if is_text(dtype) or named:
                cells[name] = mapped
            else:
                cells[name] = F.coalesce(mapped.try_cast(dtype), c)
        elif is_text(dtype):
            cells[name] = {
                "trim_whitespace": collapse,
                "normalize_blanks": blank_to_null,
                "normalize_urls": urls.clean_url,
                "standardize_dates": dates.standard_date,
                "normalize_geo": places.standard_place,
                "normalize_case": lambda x: change_case(x, config.get("case_type", "title")),
            }[operation](c)
    return cells


def _changed(df: DataFrame, name: str, new: Column) -> Column:
    """A real difference between the old and the new text of a cell."""
    return ~as_text(df, name).eqNullSafe(new.cast("string"))


def _required(config: Mapping[str, Any]) -> list[str]:
    names = list(config.get("required_fields") or [])
    if not names and config.get("field_name"):
        names = [config["field_name"]]
    return names


def lacks_required(df: DataFrame, names: list[str]) -> Column:
    """Any of the fields null, blank or one of the words for nothing; never null."""
    lacking = F.lit(False)
    for name in names:
        lacking = lacking | (
            is_missing(as_text(df, name), MISSING_REQUIRED) if name in df.columns else F.lit(True)
        )
    return lacking


def clean(
    df: DataFrame,
    operation: str,
    config: Mapping[str, Any] | None = None,
    order: str = "record_seq",
    mark: str | None = None,
) -> DataFrame:
    """The cleaned table. ``order`` tells which of two equal records came first.

    ``mark`` names a column that tells which rows got a new cell; operations that
    remove rows add none.
    """
    _check(operation)
    config = config or {}
    if operation == "remove_duplicates":
        return keep_first(df, record_hash(df, data_columns(df, [order])), order)
    if operation == "drop_missing_required":
        return df.where(~lacks_required(df, _required(config)))
    cells = new_cells(df, operation, config)
    if not cells:
        return df if mark is None else df.withColumn(mark, F.lit(False))
    if "content_hash" not in df.columns and mark is None:
        return df.withColumns(cells)
    # The stored hash follows the content, on changed rows only.
    any_changed = F.lit(False)
    for name, new in cells.items():
        any_changed = any_changed | _changed(df, name, new)
    fields = data_columns(df)
    flag = mark or "_changed"
    out = df.withColumn(flag, any_changed).withColumns(cells)
    if "content_hash" in df.columns:
        rehashed = F.when(F.col(flag), content_hash(fields)).otherwise(F.col("content_hash"))
        out = out.withColumn("content_hash", rehashed)
    return out if mark else out.drop(flag)


def dropped_rows(
    df: DataFrame, operation: str, config: Mapping[str, Any] | None = None, order: str = "record_seq"
) -> DataFrame:
    """The rows an operation removes."""
    config = config or {}
    if operation == "remove_duplicates":
        first = keep_first(df, record_hash(df, data_columns(df, [order])), order)
        return df.join(first.select(order), order, "left_anti")
    if operation == "drop_missing_required":
        return df.where(lacks_required(df, _required(config)))
    return df.limit(0)


def _row_count_dropped(df: DataFrame, operation: str, config: Mapping[str, Any], order: str) -> DataFrame:
    if operation == "remove_duplicates":
        # Copies per hash combine before the shuffle; no join is needed to count.
        return (
            df.select(record_hash(df, data_columns(df, [order])).alias("h"))
            .groupBy("h")
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("records_affected"))
        )
    return df.agg(
        F.count(F.when(lacks_required(df, _required(config)), 1)).alias("records_affected")
    )


def preview(
    df: DataFrame, operation: str, config: Mapping[str, Any] | None = None, order: str = "record_seq"
) -> Preview:
    """What the operation would do: counts, warnings and five examples."""
    _check(operation)
    config = config or {}
    if operation in ROW_OPERATIONS:
        count = _row_count_dropped(df, operation, config, order)
        touched = ["_record"] if operation == "remove_duplicates" else _required(config)
        text = F.concat(F.lit("Removes "), F.col("records_affected").cast("string"), F.lit(" records."))
        summary = count.select(
            F.lit(operation).alias("operation_type"),
            "records_affected",
            F.array(*[F.lit(t) for t in touched]).cast("array<string>").alias("fields_affected"),
            (F.col("records_affected") > 0).alias("potential_info_loss"),
            F.when(F.col("records_affected") > 0, F.array(text))
            .otherwise(F.array().cast("array<string>"))
            .alias("warnings"),
        )
        fields = data_columns(df, [order])
        original = F.map_from_arrays(
            F.array(*[F.lit(c) for c in fields]), F.array(*[as_text(df, c) for c in fields])
        )
        action = "delete_duplicate" if operation == "remove_duplicates" else operation
        samples = (
            dropped_rows(df, operation, config, order)
            .orderBy(col(order))
            .limit(SAMPLES)
            .select(
                col(order),
                original.alias("original"),
                F.lit(None).cast("map<string,string>").alias("cleaned"),
                F.lit(action).alias("action"),
            )
        )
        return Preview(summary, samples)

    cells = new_cells(df, operation, config)
    names = sorted(cells)
    side = df.select(
        col(order),
        *[as_text(df, n).alias(f"old{i}") for i, n in enumerate(names)],
        *[cells[n].cast("string").alias(f"new{i}") for i, n in enumerate(names)],
    )
    flags = [~F.col(f"old{i}").eqNullSafe(F.col(f"new{i}")) for i in range(len(names))]
    any_flag = F.lit(False)
    for flag in flags:
        any_flag = any_flag | flag
    failed = F.lit(0).cast("long")
    if operation == "convert_types":
        for i in range(len(names)):
            failed = failed + F.count(F.when(F.col(f"old{i}").isNotNull() & F.col(f"new{i}").isNull(), 1))
    counts = side.agg(
        F.count(F.when(any_flag, 1)).alias("records_affected"),
        failed.alias("failed_conversions"),
        *[F.count(F.when(flag, 1)).alias(f"n{i}") for i, flag in enumerate(flags)],
    )
    lossy = operation in LOSSY
    warnings = [F.lit("Original text or number formatting is replaced.")] if lossy else []
    summary = counts.select(
        F.lit(operation).alias("operation_type"),
        "records_affected",
        F.filter(
            F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(n)) for i, n in enumerate(names)]).cast("array<string>"),
            lambda x: x.isNotNull(),
        ).alias("fields_affected"),
        F.lit(lossy).alias("potential_info_loss"),
        F.array(*warnings).cast("array<string>").alias("warnings"),
        "failed_conversions",
    )

    def changed_map(kind: str) -> Column:
        pairs = F.filter(
            F.array(
                *[
                    F.when(flag, F.struct(F.lit(n).alias("k"), F.col(f"{kind}{i}").alias("v")))
                    for i, (n, flag) in enumerate(zip(names, flags))
                ]
            ),
            lambda x: x.isNotNull(),
        )
        return F.map_from_entries(pairs)

    if names:
        samples = (
            side.where(any_flag)
            .orderBy(col(order))
            .limit(SAMPLES)
            .select(
                col(order),
                changed_map("old").alias("original"),
                changed_map("new").alias("cleaned"),
                F.lit("update").alias("action"),
            )
        )
    else:
        samples = side.limit(0)
    return Preview(summary, samples)


def apply_clean(
    df: DataFrame,
    operation: str,
    config: Mapping[str, Any] | None = None,
    order: str = "record_seq",
    id_column: str = "record_id",
) -> Applied:
    """New table, dropped identifiers and affected count of an operation."""
    _check(operation)
    config = config or {}
    key = id_column if id_column in df.columns else order
    summary = preview(df, operation, config, order).summary
    return Applied(
        clean(df, operation, config, order),
        dropped_rows(df, operation, config, order).select(col(key)),
        summary.select("records_affected"),
    )
