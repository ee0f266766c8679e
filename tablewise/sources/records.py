"""Reading record tables and opening record envelopes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..table import META_COLUMNS, col


def scan_records(
    spark: SparkSession,
    path: str,
    dataset_id: Any = None,
    status: str | None = None,
    dataset_column: str = "dataset_id",
) -> DataFrame:
    """Records of a table, or of one dataset of a shared table.

    Write shared tables with ``partitionBy("dataset_id")``: the filter then skips
    whole directories. The status filter reaches the Parquet reader.
    """
    df = spark.read.parquet(path)
    if dataset_id is not None:
        df = df.where(col(dataset_column) == F.lit(dataset_id))
    if status is not None:
        df = df.where(F.col("validation_status") == F.lit(status))
    return df


# A table can have so many columns; more keys than that are no fields.
MOST_FIELDS = 10_000


def as_variant(c: Column, dtype: T.DataType) -> Column:
    return c if isinstance(dtype, T.VariantType) else F.try_parse_json(c)


def envelope_fields(df: DataFrame, record: str = "record_data") -> dict[str, str]:
    """Field names and types found in the records, by one aggregation per field.

    The result grows with the number of fields, not with the rows; records whose keys
    are data and not field names (more than MOST_FIELDS of them) raise.
    """
    opened = df.select(as_variant(col(record), df.schema[record].dataType).alias("r"))
    found = df.sparkSession.sql(
        "select e.key as name, schema_of_variant_agg(e.value) as kind"
        " from {opened}, lateral variant_explode(r) e where e.key is not null group by e.key",
        opened=opened,
    )
    rows = found.limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"the records hold more than {MOST_FIELDS} different keys; name the fields to read")
    return {row["name"]: _spark_type(row["kind"]) for row in sorted(rows, key=lambda r: r["name"])}


def _spark_type(kind: str) -> str:
    if kind.startswith("DECIMAL"):
        return "double"
    known = {
        "BIGINT": "long",
        "DOUBLE": "double",
        "FLOAT": "double",
        "STRING": "string",
        "BOOLEAN": "boolean",
        "VOID": "string",
    }
    return known.get(kind, "variant")


def tabulate(
    df: DataFrame,
    fields: Mapping[str, str] | None = None,
    record: str = "record_data",
    fallback: str | None = "normalized_data",
) -> DataFrame:
    """Envelope rows as a wide table.

    A field comes from the record, or from the normalised record where there is no
    record. Missing keys are null. Without ``fields`` the schema is taken from the data.
    """
    v = as_variant(col(record), df.schema[record].dataType)
    if fallback and fallback in df.columns:
        v = F.coalesce(v, as_variant(col(fallback), df.schema[fallback].dataType))
    if fields is None:
        fields = envelope_fields(df.select(v.alias(record)), record)
    opened = df.withColumn("_record", v)
    meta = [c for c in df.columns if c not in (record, fallback)]
    cells = [
        F.try_variant_get("_record", "$['" + name.replace("'", "\\'") + "']", kind).alias(name)
        for name, kind in fields.items()
    ]
    return opened.select(*[col(c) for c in meta], *cells)


def envelope(df: DataFrame, record: str = "record_data") -> DataFrame:
    """Wide rows as envelope rows: meta columns and one variant record."""
    meta = [c for c in df.columns if c in META_COLUMNS]
    data = [c for c in df.columns if c not in META_COLUMNS]
    return df.select(
        *[col(c) for c in meta], F.to_variant_object(F.struct(*[col(c) for c in data])).alias(record)
    )
