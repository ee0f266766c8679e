"""Automatic insights and the report bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import compact_key
from ..functions.text import is_empty
from ..quantiles import Facts, quantiles
from ..table import as_text, col, is_text, strict, value
from .stats import _candidates, describe_numeric, outside, pairs_of, top_correlations

TOP_CATEGORIES = 5
# Texts above this length are grouped by hash.
LONG_TEXT = 256
FEWEST_FOR_OUTLIERS = 6
MISSING_ALERT = 25.0
CORRELATION_ALERT = 0.4

# The method names given below with each insight are part of the result.
SCHEMA = "category string, title string, columns array<string>, method string, evidence map<string,string>"


def _show(c: Column) -> Column:
    return F.round(c, 4).cast("string")


def _insight(df: DataFrame, category: str, title: Column, columns: Sequence[str], method: str, evidence) -> DataFrame:
    flat = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(category).alias("category"),
        title.alias("title"),
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        F.lit(method).alias("method"),
        F.create_map(*flat).alias("evidence"),
    )


def _facts(df: DataFrame):
    """Rows, cells, strict numbers and extremes of every column, in one pass."""
    candidates = set(_candidates(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(df.columns):
        aggs.append(
            F.count(F.when(is_empty(value(df, n), is_text(df.schema[n].dataType)), 1)).alias(f"m{i}")
        )
        if n in candidates:
            v = strict(df, n)
            aggs += [F.count(v).alias(f"k{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    return df.agg(*aggs).first()


def insights(df: DataFrame, order: str, shown_columns: int | None = None) -> DataFrame:
    """Insight rows: overview, extremes, dominant categories, outliers, correlations,
    missing-value alerts. Evidence values are text.

    ``shown_columns`` keeps the extremes, categories and outliers of the first columns
    only. Which columns count as numeric depends on the data, so one pass collects a few
    numbers per column; all insight values are then computed on the cluster.
    """
    spark = df.sparkSession
    names = df.columns
    facts = _facts(df)
    rows = facts["rows"]
    if rows == 0:
        return spark.createDataFrame(
            [("overview", "Empty Dataset", [], "record_count", {"row_count": "0"})], SCHEMA
        )
    floor = max(3, int(rows * 0.4))
    candidates = _candidates(df)
    numeric = [n for n in names if n in candidates and facts[f"k{names.index(n)}"] >= floor]
    missing = {n: facts[f"m{i}"] for i, n in enumerate(names)}
    empty_cells = sum(missing.values())
    cells = rows * len(names)

    one = spark.range(1)
    complete = F.round(F.lit((cells - empty_cells) / cells * 100), 1)
    parts = [
        _insight(
            one,
            "overview",
            F.lit(f"{rows} records across {len(names)} columns"),
            names,
            "descriptive_scale",
            {
                "total_records": F.lit(rows),
                "total_columns": F.lit(len(names)),
                "completeness_pct": complete,
                "null_cells_count": F.lit(empty_cells),
            },
        )
    ]
    shown = numeric[:shown_columns]
    known = {
        n: Facts(facts[f"k{i}"], facts[f"lo{i}"], facts[f"hi{i}"]) for i, n in enumerate(names) if n in shown
    }
    quarts = quantiles(df, {n: strict(df, n) for n in shown}, [0.25, 0.5, 0.75], known)
    parts += [_extremes(df, n, names, order, quarts[n][1]) for n in shown]
    parts += _categories(df, [n for n in names if n not in numeric], rows, shown_columns)
    for n in shown:
        q1, _, q3 = quarts[n]
        if facts[f"k{names.index(n)}"] >= FEWEST_FOR_OUTLIERS and q3 > q1:
            parts.append(_outliers(df, n, order, q1, q3, facts[f"k{names.index(n)}"]))
    if len(numeric) >= 2:
        parts.append(_correlations(df, numeric))
    for n in names:
        share = F.round(F.lit(missing[n] / rows * 100), 1)
        alert = one.where(share >= MISSING_ALERT)
        parts.append(
            _insight(
                alert,
                "quality",
                F.lit(f"High missing rate in '{n}'"),
                [n],
                "missing_value_audit",
                {"column": F.lit(n), "missing_count": F.lit(missing[n]), "missing_percentage": share},
            )
        )
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _extremes(df: DataFrame, name: str, names: Sequence[str], order: str, median: float) -> DataFrame:
    v = strict(df, name)
    texts = [c for c in names if c != name and is_text(df.schema[c].dataType)]
    # The label of the first row that holds the maximum.
    label = F.min_by(col(texts[0]), F.struct(-v, col(order))) if texts else F.lit(None).cast("string")
    held = df.where(v.isNotNull())
    found = held.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.avg(v).alias("mean"),
        label.alias("label"),
    ).where(F.col("n") >= 2)
    return _insight(
        found,
        "extremes",
        F.lit(f"Highest and lowest {name}"),
        [name],
        "numerical_extremes",
        {
            "column": F.lit(name),
            "max": _show(F.col("max")),
            "min": _show(F.col("min")),
            "mean": _show(F.col("mean")),
            "median": _show(F.lit(median)),
            "top_entity": F.col("label"),
        },
    )


def _counted(df: DataFrame, name: str) -> DataFrame:
    """(value, n, head): how often each text occurs; long texts by their hash and start."""
    text = as_text(df, name)
    return (
        df.where(text.isNotNull())
        .groupBy(compact_key(text).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.left(text, F.lit(LONG_TEXT))).alias("head"))
    )


def _whole(df: DataFrame, name: str, top: DataFrame) -> DataFrame:
    """``top`` with whole texts in place of hashes; a scan that only keeps long texts."""
    text = as_text(df, name)
    long = df.where(F.length(text) > LONG_TEXT).select(compact_key(text).alias("value"), text.alias("whole"))
    found = long.join(F.broadcast(top.select("value")), "value").groupBy("value").agg(F.min("whole").alias("whole"))
    return top.join(found, "value", "left").select(F.coalesce("whole", "value").alias("value"), "n", "head")


def _categories(df: DataFrame, names: Sequence[str], rows: int, shown: int | None) -> list[DataFrame]:
    """Dominant value of the columns with 1 < distinct values < rows.

    One job counts the distinct values of all columns.
    """
    if not names:
        return []
    counts = [_counted(df, n).agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("d")) for i, n in enumerate(names)]
    frame = counts[0]
    for c in counts[1:]:
        frame = frame.unionByName(c)
    distinct = {names[r["i"]]: r["d"] for r in frame.collect()}
    parts: list[DataFrame] = []
    for name in [n for n in names if 1 < distinct[n] < rows][:shown]:
        # Five rows at most from here on.
        top = _counted(df, name).orderBy(F.desc("n"), "head", "value").limit(TOP_CATEGORIES)
        share = F.round(F.col("n") * 100.0 / F.lit(rows), 1)
        best = _best(_whole(df, name, top) if is_text(df.schema[name].dataType) else top)
        parts.append(
            _insight(
                best,
                "categorical",
                F.concat(F.lit(f"Dominant category in {name}: "), F.col("value")),
                [name],
                "frequency_distribution",
                {
                    "column": F.lit(name),
                    "top_category": F.col("value"),
                    "top_count": F.col("n"),
                    "top_percentage": share,
                    "distinct_categories": F.lit(distinct[name]),
                    "top_values": F.col("top"),
                },
            )
        )
    return parts


def _best(top: DataFrame) -> DataFrame:
    listed = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("head"), F.col("value"), F.col("n")))
    )
    return (
        top.agg(listed.alias("t"))
        .select(
            F.col("t")[0]["value"].alias("value"),
            F.col("t")[0]["n"].alias("n"),
            F.array_join(
                F.transform("t", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ", "
            ).alias("top"),
        )
    )


def _outliers(df: DataFrame, name: str, order: str, q1: float, q3: float, numbers: int) -> DataFrame:
    reach = 1.5 * (q3 - q1)
    lower, upper = q1 - reach, q3 + reach
    v = strict(df, name)
    far = df.where(outside(v, lower, upper)).select(v.alias("v"), col(order).alias("o"))
    count = far.agg(F.count(F.lit(1)).alias("n"))
    # Three rows at most.
    sample = far.orderBy("o").limit(3).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda t: _show(t["v"])), ", "
        ).alias("sample")
    )
    both = (
        count.select("n", F.lit(None).cast("string").alias("sample"))
        .unionByName(sample.select(F.lit(None).cast("long").alias("n"), "sample"))
        .agg(F.max("n").alias("n"), F.max("sample").alias("sample"))
        .where(F.col("n") > 0)
    )
    return _insight(
        both,
        "outlier",
        F.lit(f"Statistical outliers in {name}"),
        [name],
        "interquartile_range_iqr",
        {
            "column": F.lit(name),
            "outlier_count": F.col("n"),
            "outlier_percentage": F.round(F.col("n") * 100.0 / F.lit(numbers), 1),
            "lower_bound": _show(F.lit(lower)),
            "upper_bound": _show(F.lit(upper)),
            "sample_outlier_values": F.col("sample"),
        },
    )


def _correlations(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    r = F.round("r", 3)
    strong = F.when(F.abs(r) >= 0.7, "strong").otherwise("moderate")
    return (
        pairs_of(df, numeric)
        .where(F.abs(r) >= CORRELATION_ALERT)
        .select(
            F.lit("correlation").alias("category"),
            F.concat(F.lit("Correlation of "), "column_a", F.lit(" and "), "column_b").alias("title"),
            F.array("column_a", "column_b").alias("columns"),
            F.lit("pearson_correlation").alias("method"),
            F.create_map(
                F.lit("column_a"), F.col("column_a"),
                F.lit("column_b"), F.col("column_b"),
                F.lit("pearson_r"), r.cast("string"),
                F.lit("strength"), strong,
            ).alias("evidence"),
        )
    )


def report_bundle(df: DataFrame, order: str) -> DataFrame:
    """(section, item, key, value): insights, descriptive statistics and the five
    strongest correlations as one long table."""
    cards = insights(df, order)
    first = cards.select(
        F.lit("insights").alias("section"), F.col("title").alias("item"), F.explode("evidence").alias("key", "value")
    )
    stats = describe_numeric(df)
    measures = [c for c in stats.columns if c != "column"]
    second = stats.select(
        "column", *[F.col(f"`{c}`").cast("string").alias(c) for c in measures]
    ).unpivot("column", measures, "key", "value").select(
        F.lit("statistics").alias("section"), F.col("column").alias("item"), "key", "value"
    )
    third = (
        top_correlations(df)
        .limit(5)
        .select(
            F.lit("correlations").alias("section"),
            F.concat_ws(" ~ ", "column_a", "column_b").alias("item"),
            F.col("strength").alias("key"),
            F.col("coefficient").cast("string").alias("value"),
        )
    )
    return first.unionByName(second).unionByName(third)
