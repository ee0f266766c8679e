"""Most frequent and first values of many columns without a frequency table.

A heavy-hitter sketch of every column, merged from all tasks, names candidates; one scan
counts these exactly. A value that is no candidate occurs at most as often as the sketch
may err, so the ranking is proven where the last wanted candidate occurs more often, or
where the candidates make up all rows. Only columns left unproven are counted by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .functions.hashing import compact_key
from .functions.text import MISSING_PROFILE, is_missing
from .table import as_text, col, value

# Texts above this length are known by their SHA-256 and their start.
LONG_TEXT = 256

# Values that a sketch keeps, and candidates that are counted for each column.
TRACKED = 20_000
CANDIDATES = 64
# A sketch of that size (2 to the 15th slots) counts a value wrongly by at most this share of the
# rows, and names every value of more than twice the share.
SKETCH_ERROR = 3.5 / (1 << 15)
# Rows from which first values are taken before whole columns are asked.
FIRST_ROWS = 1000


@dataclass(frozen=True)
class Cells:
    """The non-missing cells of a column as they are counted: numbers as such, texts by key."""

    raw: Column
    key: Column
    head: Column

    @staticmethod
    def of(df: DataFrame, name: str) -> Cells:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.IntegralType):
            raw = col(name).cast("long")
        elif isinstance(dtype, T.DoubleType):
            # Minus zero is zero.
            raw = value(df, name) + F.lit(0.0)
        else:
            text = as_text(df, name)
            held = F.when(~is_missing(text, MISSING_PROFILE), text)
            key = compact_key(held, LONG_TEXT)
            return Cells(key, key, F.left(held, F.lit(LONG_TEXT)))
        return Cells(raw, raw.cast("string"), raw.cast("string"))


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Exact number of different values of each column.

    Each column is a part of the job of its own, which reads that column alone; a
    text travels as a 128-bit hash.
    """
    parts = []
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.IntegralType, T.DoubleType)):
            known = Cells.of(df, name).raw
        else:
            text = as_text(df, name)
            held = ~is_missing(text, MISSING_PROFILE)
            known = F.when(held, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
        different = df.select(known.alias("k")).where(F.col("k").isNotNull()).distinct()
        parts.append(different.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")))
    counts = dict.fromkeys(names, 0)
    if parts:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        # One row per column.
        counts.update({names[r["i"]]: r["n"] for r in whole.collect()})
    return counts


def _entries(df: DataFrame, order: str, cells: Mapping[str, Cells], held: Mapping[str, Column]) -> DataFrame:
    """(column, key, head, first): one row for each cell that ``held`` lets through.

    Each column is a part of its own, which reads that column and the order alone.
    """
    parts = [
        df.where(held[n]).select(F.lit(n).alias("column"), c.key.alias("key"), c.head.alias("head"), col(order).alias("first"))
        for n, c in cells.items()
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _counted(entries: DataFrame) -> DataFrame:
    return entries.groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.min("head").alias("head"))


def _ranked(counted: DataFrame, size: int | None) -> DataFrame:
    """(column, place, key, n, first) by falling count, then text; tasks pass on ``size`` rows a column."""
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("head"), F.asc("key"))
    ranked = counted.withColumn("place", F.row_number().over(by_count))
    if size is not None:
        ranked = ranked.where(F.col("place") <= size)
    return ranked.select("column", "place", "key", "n", "first")


def frequent_values(
    df: DataFrame,
    names: Sequence[str],
    order: str,
    size: int | None,
    uniques: Mapping[str, int] | None = None,
    totals: Mapping[str, int] | None = None,
    few: Sequence[str] = (),
    tracked: int = TRACKED,
    candidates: int = CANDIDATES,
    error: float = SKETCH_ERROR,
) -> DataFrame:
    """(column, place, key, n, first) of the ``size`` most frequent values of each column (None: all).

    Ties go by text. ``key`` is the text, or the SHA-256 of a long one, ``first`` the least
    ``order`` at which the value stands. Columns of at most ``tracked`` values, as known from
    ``uniques`` (see ``distinct_counts``) or named in ``few``, are counted by value. Where
    ``uniques`` equals ``totals``, the number of non-missing cells, all values are different
    and the least texts come first. All other columns are sketched.
    """
    spark = df.sparkSession
    schema = f"column string, place int, key string, n long, first {df.schema[order].dataType.simpleString()}"
    if not names:
        return spark.createDataFrame([], schema)
    uniques, totals = dict(uniques or {}), dict(totals or {})
    cells = {n: Cells.of(df, n) for n in names}
    small = [n for n in names if n in few or uniques.get(n, tracked + 1) <= tracked]
    single = [n for n in names if n not in small and n in totals and uniques.get(n) == totals[n]]
    open_ones = [n for n in names if n not in small and n not in single]
    unproven, found = open_ones, []
    if open_ones and size is not None and size <= candidates:
        named, bounds, totals = _candidates(df, {n: cells[n] for n in open_ones}, tracked, candidates, error)
        exact: dict[str, list] = {n: [] for n in open_ones}
        asked = {n: cells[n] for n in open_ones if named[n]}
        if asked:
            held = {n: c.raw.isin(named[n]) for n, c in asked.items()}
            # At most ``candidates`` rows per column.
            for r in _counted(_entries(df, order, asked, held)).collect():
                exact[r["column"]].append(r)
        unproven = []
        for n in open_ones:
            ranked = sorted(exact[n], key=lambda r: (-r["n"], r["head"].encode(), r["key"].encode()))
            complete = sum(r["n"] for r in ranked) == totals[n]
            if complete or (len(ranked) >= size and ranked[size - 1]["n"] > bounds[n]):
                found += [(n, k + 1, r["key"], r["n"], r["first"]) for k, r in enumerate(ranked[:size])]
            else:
                unproven.append(n)
    out = spark.createDataFrame(found, schema)
    for some, fold in ((single, lambda e: e.withColumn("n", F.lit(1).cast("long"))), ([*small, *unproven], _counted)):
        if some:
            rest = {n: cells[n] for n in some}
            entries = _entries(df, order, rest, {n: c.raw.isNotNull() for n, c in rest.items()})
            out = out.unionByName(_ranked(fold(entries), size))
    return out


def _candidates(
    df: DataFrame, cells: Mapping[str, Cells], tracked: int, candidates: int, error: float
) -> tuple[dict[str, list], dict[str, float], dict[str, int]]:
    """For each column: candidates, what no other value's count exceeds, and its cells."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cells.values()):
        top = F.call_function("approx_top_k", c.raw, F.lit(candidates + 1), F.lit(tracked))
        aggs += [F.count(c.raw).alias(f"n{i}"), top.alias(f"t{i}")]
    row = df.agg(*aggs).first()
    named, bounds, totals = {}, {}, {}
    for i, n in enumerate(cells):
        # Null is an item of the sketch like any other.
        top = [t for t in row[f"t{i}"] or () if t["item"] is not None][:candidates]
        named[n], totals[n] = [t["item"] for t in top], row[f"n{i}"]
        # A value that is missing here was below the last estimate, or too rare to be named.
        bounds[n] = max(2 * error * row["rows"], top[-1]["count"] if len(top) == candidates else 0)
    return named, bounds, totals


def first_values(
    df: DataFrame, names: Sequence[str], order: str, size: int, uniques: Mapping[str, int] | None = None, rows: int = FIRST_ROWS
) -> DataFrame:
    """(column, place, key, first) of the first ``size`` different values of each column by ``order``.

    They are taken from the first ``rows`` rows. Columns that show fewer there are asked
    for one more value in each of at most ``size`` scans, all of them at once.
    """
    spark = df.sparkSession
    schema = f"column string, place int, key string, first {df.schema[order].dataType.simpleString()}"
    if not names:
        return spark.createDataFrame([], schema)
    cells = {n: Cells.of(df, n) for n in names}
    head = df.select(col(order).alias("first"), *[c.key.alias(f"k{i}") for i, c in enumerate(cells.values())]).orderBy("first").limit(rows)
    parts = [F.struct(F.lit(n).alias("column"), F.col(f"k{i}").alias("key")) for i, n in enumerate(cells)]
    seen = head.select("first", F.explode(F.array(*parts)).alias("e")).select("first", "e.column", "e.key").where("key IS NOT NULL")
    by_place = Window.partitionBy("column").orderBy("first", "key")
    early = seen.groupBy("column", "key").agg(F.min("first").alias("first")).withColumn("place", F.row_number().over(by_place))
    found: dict[str, list[tuple]] = {n: [] for n in names}
    for r in sorted(early.where(F.col("place") <= size).collect(), key=lambda r: r["place"]):
        found[r["column"]].append((r["key"], r["first"]))
    open_ones = [n for n in names if len(found[n]) < size and (uniques is None or uniques[n] > len(found[n]))]
    while open_ones:
        aggs = []
        for i, n in enumerate(open_ones):
            key, place = cells[n].key, col(order)
            new = key.isNotNull() & ~key.isin([k for k, _ in found[n]]) if found[n] else key.isNotNull()
            aggs.append(F.min_by(F.struct(key.alias("key"), place.alias("first")), F.when(new, place)).alias(f"x{i}"))
        row = df.agg(*aggs).first()
        left = []
        for i, n in enumerate(open_ones):
            if row[f"x{i}"] is not None:
                found[n].append((row[f"x{i}"]["key"], row[f"x{i}"]["first"]))
                if len(found[n]) < size and (uniques is None or uniques[n] > len(found[n])):
                    left.append(n)
        open_ones = left
    return spark.createDataFrame([(n, k + 1, *x) for n in names for k, x in enumerate(found[n])], schema)
