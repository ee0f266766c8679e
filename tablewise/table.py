"""Small helpers around the wide table all operators take."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .functions.numbers import no_nan, num_loose, num_strict

# Columns that describe a record and are not part of it.
META_COLUMNS = (
    "dataset_id",
    "record_id",
    "record_seq",
    "record_hash",
    "content_hash",
    "key_hash",
    "validation_status",
    "validation_errors",
    "source_count",
    "created_at",
    "updated_at",
)


def col(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def data_columns(df: DataFrame, extra_meta: Iterable[str] = ()) -> list[str]:
    skip = set(META_COLUMNS) | set(extra_meta)
    return [c for c in df.columns if c not in skip]


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def strict(df: DataFrame, name: str) -> Column:
    return num_strict(col(name), df.schema[name].dataType)


def loose(df: DataFrame, name: str) -> Column:
    return num_loose(col(name), df.schema[name].dataType)


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    return no_nan(col(name), df.schema[name].dataType)


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; nested values as JSON, NaN as null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(col(name))
    return no_nan(col(name), dtype).cast("string")


def first_column(df: DataFrame, *names: str | None) -> str:
    for name in names:
        if name:
            return name
    return df.columns[0]


def long_form(df: DataFrame, columns: Sequence[tuple[str, dict[str, Column]]], id_columns=()) -> DataFrame:
    """One row per (input row, entry): ``columns`` gives a name and its values."""
    entries = [
        F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in values.items()])
        for name, values in columns
    ]
    return df.select(*[col(c) for c in id_columns], F.inline(F.array(*entries)))
