"""Transformations: rename, derive, filter. Anything else is refused."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import content_hash
from ..functions.text import map_value, strip
from ..functions.urls import domain
from ..scale import HOT_ROWS, spread_join
from ..table import as_text, col, data_columns, is_text, loose
from .clean import SAMPLES, Applied, Preview
from .filters import filter_records, record_predicate

# What a caller may ask for.
OPERATIONS = ("rename_column", "derive_column", "filter_records")
EXPRESSIONS = (
    "combine_text",
    "split_text",
    "extract_domain",
    "math_op",
    "value_map",
    "constant",
)


@dataclass(frozen=True)
class Transformed(Applied):
    """An applied transformation with the fields it renamed or added."""

    schema_updates: Mapping[str, Any]


def _check(operation: str, config: Mapping[str, Any]) -> None:
    if operation not in OPERATIONS:
        raise ValueError(f"no such transformation: {operation!r}; known are {', '.join(OPERATIONS)}")
    if operation == "rename_column" and not (config.get("old_name") and config.get("new_name")):
        raise ValueError("a rename needs old_name and new_name")
    if operation == "derive_column":
        if not (config.get("target_column") and config.get("expression_type")):
            raise ValueError("a derived column needs target_column and expression_type")
        if config["expression_type"] not in EXPRESSIONS:
            raise ValueError(f"no such expression: {config['expression_type']!r}; known are {', '.join(EXPRESSIONS)}")


def derived(df: DataFrame, expression: str, config: Mapping[str, Any]) -> Column:
    """The derived value of a row."""
    nothing = F.lit(None).cast("string")
    if expression == "constant":
        return F.lit(config.get("constant_value"))
    if expression == "combine_text":
        parts = [
            F.nullif(strip(as_text(df, c)), F.lit(""))
            for c in config.get("source_columns", [])
            if c in df.columns
        ]
        return F.nullif(F.concat_ws(config.get("delimiter", " "), *parts), F.lit("")) if parts else nothing
    source = config.get("source_column")
    if source not in df.columns:
        return nothing
    if expression == "split_text":
        mark = re.escape(config.get("delimiter", ","))
        index = int(config.get("part_index", 0))
        if index < 0:
            return nothing
        return strip(F.get(F.split(as_text(df, source), mark, -1), F.lit(index)))
    if expression == "extract_domain":
        return domain(col(source)) if is_text(df.schema[source].dataType) else nothing
    if expression == "math_op":
        v, operand = loose(df, source), float(config.get("operand", 0))
        operator = config.get("operator", "+")
        by = F.lit(operand)
        result = {
            "+": v + by,
            "-": v - by,
            "*": v * by,
            "/": F.try_divide(v, by),
        }.get(operator, F.lit(None).cast("double"))
        return F.round(result, 2)
    return map_value(as_text(df, source), config.get("mapping") or {})


def map_by_table(
    df: DataFrame,
    source: str,
    mapping: DataFrame,
    target: str,
    spread_by: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Value map kept as a table (key, value): exact stripped key, then any case.

    For maps too large for a literal. Both joins split hot values, and the side of
    the map is only broadcast where Spark knows its size.
    """
    exact = mapping.groupBy(F.col("key").cast("string").alias("_exact")).agg(
        F.min("value").alias("_v1")
    )
    anycase = mapping.groupBy(F.lower("key").alias("_anycase")).agg(F.min_by("value", "key").alias("_v2"))
    key = strip(as_text(df, source))
    keyed = df.withColumn("_exact", key)
    first = spread_join(
        keyed, exact.withColumn("_hit1", F.lit(True)), "_exact", spread_by, "left", hot_rows
    ).withColumn("_anycase", F.lower("_exact"))
    # Keys are measured on the input, so that the first join does not run twice.
    second = spread_join(
        first, anycase.withColumn("_hit2", F.lit(True)), "_anycase", spread_by, "left", hot_rows, df.select(F.lower(key).alias("_anycase"))
    )
    return second.withColumn(
        target,
        F.when(F.col("_hit1"), F.col("_v1"))
        .when(F.col("_hit2"), F.col("_v2"))
        .otherwise(as_text(df, source)),
    ).drop("_exact", "_anycase", "_v1", "_v2", "_hit1", "_hit2")


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Renamed column; a column the table lacks changes nothing."""
    if old not in df.columns or old == new:
        return df
    if new in df.columns:
        df = df.drop(new)
    return df.withColumnRenamed(old, new)


def transform(df: DataFrame, operation: str, config: Mapping[str, Any]) -> DataFrame:
    """The transformed table."""
    _check(operation, config)
    if operation == "rename_column":
        out = rename_column(df, config["old_name"], config["new_name"])
    elif operation == "derive_column":
        out = df.withColumn(config["target_column"], derived(df, config["expression_type"], config))
    else:
        return filter_records(
            df,
            config.get("filter_field"),
            config.get("operator", "=="),
            config.get("value"),
            config.get("action", "keep"),
        )
    if "content_hash" in out.columns and out is not df:
        out = out.withColumn("content_hash", content_hash(data_columns(out)))
    return out


def _dropped(df: DataFrame, config: Mapping[str, Any]) -> Column:
    matched = record_predicate(
        df, config.get("filter_field"), config.get("operator", "=="), config.get("value")
    )
    return ~matched if config.get("action", "keep") == "keep" else matched


def preview(
    df: DataFrame, operation: str, config: Mapping[str, Any], order: str = "record_seq"
) -> Preview:
    """Affected rows, touched fields, warnings and five examples."""
    _check(operation, config)
    none = F.lit(None).cast("map<string,string>")
    if operation == "rename_column":
        old, new = config["old_name"], config["new_name"]
        fields = [old, new]
        if old in df.columns:
            hit, before = F.lit(True), F.create_map(F.lit(old), as_text(df, old))
            after = F.create_map(F.lit(new), as_text(df, old))
        else:
            hit, before, after = F.lit(False), none, none
        shown = df.where(hit)
    elif operation == "derive_column":
        target = config["target_column"]
        fields = [target]
        value = derived(df, config["expression_type"], config).cast("string")
        hit = value.isNotNull()
        first = data_columns(df, [order])[:3]
        before = F.create_map(*[x for c in first for x in (F.lit(c), as_text(df, c))])
        after = F.create_map(F.lit(target), value)
        shown = df
    else:
        field = config.get("filter_field")
        fields = [field] if field else []
        hit = _dropped(df, config)
        names = data_columns(df, [order])
        before = F.create_map(*[x for c in names for x in (F.lit(c), as_text(df, c))])
        after = none
        shown = df.where(hit)
    removes = operation == "filter_records"
    count = F.col("records_affected")
    text = F.concat(F.lit("Removes "), count.cast("string"), F.lit(" records."))
    summary = df.agg(F.count(F.when(hit, 1)).alias("records_affected")).select(
        F.lit(operation).alias("operation_type"),
        "records_affected",
        F.array(*[F.lit(f) for f in fields]).cast("array<string>").alias("fields_affected"),
        F.when(F.lit(removes) & (count > 0), F.array(text))
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
    )
    samples = (
        shown.orderBy(col(order))
        .limit(SAMPLES)
        .select(col(order), before.alias("original"), after.alias("transformed"))
    )
    return Preview(summary, samples)


def apply_transform(
    df: DataFrame,
    operation: str,
    config: Mapping[str, Any],
    order: str = "record_seq",
    id_column: str = "record_id",
) -> Transformed:
    """New table, dropped identifiers, affected count and schema change."""
    _check(operation, config)
    key = id_column if id_column in df.columns else order
    out = transform(df, operation, config)
    dropped = df.where(_dropped(df, config)) if operation == "filter_records" else df.limit(0)
    updates: dict[str, Any] = {}
    if operation == "rename_column":
        updates = {"renamed_field": {"from": config["old_name"], "to": config["new_name"]}}
    elif operation == "derive_column":
        target = config["target_column"]
        updates = {
            "added_field": {"name": target, "type": out.schema[target].dataType.simpleString()}
        }
    affected = preview(df, operation, config, order).summary.select("records_affected")
    return Transformed(out, dropped.select(col(key)), affected, updates)
