"""Comparing two tables: schema, records, values, size and quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frequent import LONG_TEXT
from ..functions.hashing import compact_key
from ..functions.text import is_missing, lowered, strip
from ..table import as_text, data_columns
from .profile import record_hash

TOP_VALUES = 5


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, in_a, in_b) of two wide tables. Reads no data."""
    left, right = set(data_columns(a)), set(data_columns(b))
    rows = [(c, c in left, c in right) for c in sorted(left | right)]
    return a.sparkSession.createDataFrame(rows, "column string, in_a boolean, in_b boolean")


def envelope_keys(df: DataFrame, record: str = "record") -> DataFrame:
    """Distinct keys of variant records."""
    return df.sparkSession.sql(
        f"select distinct e.key as column from {{df}}, lateral variant_explode(`{record}`) e", df=df
    )


def envelope_schema_diff(a: DataFrame, b: DataFrame, record: str = "record") -> DataFrame:
    """As ``schema_diff`` for schemaless records: keys are collected by both sides."""
    keys = (
        envelope_keys(a, record)
        .select("column", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(envelope_keys(b, record).select("column", F.lit(0).alias("a"), F.lit(1).alias("b")))
    )
    return keys.groupBy("column").agg(
        (F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b")
    )


def schema_similarity(diff: DataFrame) -> DataFrame:
    """One row: common and one-sided columns, Dice similarity in percent."""
    common = F.count(F.when(F.col("in_a") & F.col("in_b"), 1))
    sides = F.count(F.when(F.col("in_a"), 1)) + F.count(F.when(F.col("in_b"), 1))
    return diff.agg(
        common.alias("common_columns"),
        F.count(F.when(F.col("in_a") & ~F.col("in_b"), 1)).alias("a_only_columns"),
        F.count(F.when(~F.col("in_a") & F.col("in_b"), 1)).alias("b_only_columns"),
        F.round(F.lit(200.0) * common / F.greatest(sides, F.lit(1)), 1).alias("similarity"),
    )


def identifiers(df: DataFrame, key: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """The identifier of each record: its key, stripped and lower-case, else its hash."""
    names = list(columns) if columns is not None else data_columns(df)
    fallback = record_hash(df, names)
    if key is None or key not in df.columns:
        return df.select(fallback.alias("id"))
    text = as_text(df, key)
    usable = text.isNotNull() & (text != "")
    return df.select(F.when(usable, lowered(text)).otherwise(fallback).alias("id"))


def record_overlap(
    a: DataFrame, b: DataFrame, key: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: records of each side, distinct identifiers on both or one side.

    Both sides go through one aggregation with side flags, so copies combine before
    the single shuffle and no join is needed.
    """
    both = (
        identifiers(a, key, columns)
        .select("id", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(identifiers(b, key, columns).select("id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    )
    sides = both.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    return sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("records_a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("records_b"),
        (F.coalesce(F.sum("b"), F.lit(0)) - F.coalesce(F.sum("a"), F.lit(0))).alias("record_count_delta"),
        F.count(F.when(in_a & in_b, 1)).alias("common_records"),
        F.count(F.when(in_a & ~in_b, 1)).alias("a_only_records"),
        F.count(F.when(~in_a & in_b, 1)).alias("b_only_records"),
    )


def compare_values(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """(side, column, place, value, count, non_null): most frequent values per side
    of the common columns, or of those named."""
    common = sorted(set(data_columns(a)) & set(data_columns(b)))
    names = list(columns) if columns is not None else common

    cells = [(side, c, strip(as_text(df, c)), df) for side, df in (("a", a), ("b", b)) for c in names]

    def long(texts: Callable[[Column], Column]) -> DataFrame:
        """(side, column, of, key, text): ``texts`` of the cells; each column is read alone."""
        parts = [
            df.select(F.lit(side).alias("side"), F.lit(c).alias("column"), compact_key(text, LONG_TEXT).alias("key"), texts(text).alias("text"))
            .where(~is_missing(text, ("",)))
            for side, c, text, df in cells
        ]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    if not cells:
        return a.sparkSession.createDataFrame([], "side string, column string, place int, value string, count long, non_null long")
    # Long texts are grouped by hash and ordered by their start; only the listed ones are read whole.
    counted = long(lambda t: F.left(t, F.lit(LONG_TEXT))).groupBy("side", "column", "key").agg(
        F.count(F.lit(1)).alias("count"), F.min("text").alias("head")
    )
    totals = long(lambda t: F.lit(None).cast("string")).groupBy("side", "column").agg(F.count(F.lit(1)).alias("non_null"))
    first = Window.partitionBy("side", "column").orderBy(F.desc("count"), F.asc("head"), F.asc("key"))
    ranked = counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    # A few rows per compared column from here on.
    hashed = ranked.where(F.col("key").startswith("sha256:")).select("side", "column", "key")
    found = long(lambda t: F.when(F.length(t) > LONG_TEXT, t)).where(F.col("text").isNotNull())
    wholes = found.join(F.broadcast(hashed), ["side", "column", "key"], "left_semi").groupBy("side", "column", "key").agg(F.min("text").alias("text"))
    return (
        ranked.join(F.broadcast(totals), ["side", "column"])
        .join(wholes, ["side", "column", "key"], "left")
        .select("side", "column", "place", F.coalesce("text", "key").alias("value"), "count", "non_null")
    )


def quality_delta(scores_a: DataFrame, scores_b: DataFrame) -> DataFrame:
    """(dimension, score_a, score_b, delta) of two quality reports."""
    return (
        scores_a.select("dimension", F.col("score").alias("score_a"))
        .join(scores_b.select("dimension", F.col("score").alias("score_b")), "dimension")
        .withColumn("delta", F.round(F.col("score_b") - F.col("score_a"), 1))
    )
