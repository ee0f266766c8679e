"""CSV and JSON Lines sinks. Files are written by the executors, one per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import formula_guard
from ..table import as_text, col, data_columns


def csv_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    provenance: bool = True,
    warnings: bool = False,
) -> DataFrame:
    """The guarded text cells of a CSV export; unknown columns are empty."""
    names = list(columns) if columns else sorted(data_columns(df))
    cells = [
        F.coalesce(formula_guard(as_text(df, c)), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in names
    ]
    if warnings:
        status = col("validation_status") if "validation_status" in df.columns else F.lit("valid")
        cells.append(F.coalesce(status, F.lit("valid")).alias("validation_status"))
    if provenance:
        count = col("source_count").cast("string") if "source_count" in df.columns else F.lit("1")
        cells.append(F.coalesce(count, F.lit("1")).alias("source_count"))
    return df.select(*cells)


def json_rows(
    df: DataFrame, columns: Sequence[str] | None = None, provenance: bool = True
) -> DataFrame:
    """The rows of a JSON export with a nested ``_provenance`` object."""
    names = list(columns) if columns else data_columns(df)
    cells = [col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    if provenance:

        def part(name: str, default):
            return F.coalesce(col(name), F.lit(default)) if name in df.columns else F.lit(default)

        record_hash = next((c for c in ("content_hash", "record_hash") if c in df.columns), None)
        cells.append(
            F.struct(
                part("source_count", 1).alias("source_count"),
                part("validation_status", "valid").alias("validation_status"),
                (col(record_hash) if record_hash else F.lit(None).cast("string")).alias("record_hash"),
            ).alias("_provenance")
        )
    return df.select(*cells)


def by_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if status is None else df.where(col("validation_status") == F.lit(status))


def export_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    provenance: bool = True,
    warnings: bool = False,
    status: str | None = None,
) -> None:
    """CSV folder with a header per file; every cell passes the formula guard."""
    rows = csv_rows(by_status(df, status), columns, provenance, warnings)
    rows.write.csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")


def export_json(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    provenance: bool = True,
    status: str | None = None,
) -> None:
    """JSON Lines folder; nulls are written."""
    rows = json_rows(by_status(df, status), columns, provenance)
    rows.write.json(path, ignoreNullFields=False)


def latest_rows(df: DataFrame, limit: int | None = None, tie: str = "record_id") -> DataFrame:
    """The rows of a table, newest first; ``limit`` keeps the first ones."""
    newest = df.orderBy(col("created_at").desc_nulls_last(), col(tie).asc())
    return newest if limit is None else newest.limit(limit)


def export_latest(df: DataFrame, path: str, fmt: str = "csv", limit: int | None = None) -> None:
    """Simple export of the newest rows, as CSV or JSON Lines."""
    newest = latest_rows(df, limit)
    if fmt == "csv":
        csv_rows(newest, provenance=False).write.csv(
            path, header=True, escape='"', emptyValue="", encoding="UTF-8"
        )
    elif fmt == "json":
        newest.write.json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"Unsupported export format: {fmt}")
