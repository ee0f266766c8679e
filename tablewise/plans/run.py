"""Running a plan: every operation becomes a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import compact_key
from ..functions.text import is_empty
from ..operators.filters import apply_filters
from ..operators.stats import (
    bin_edges,
    grouped_median,
    histogram_counts,
    iqr_bounds,
    number_columns,
    outside,
    pairs_of,
)
from ..quantiles import number_facts, quantiles
from ..scale import SMALL_ROWS
from ..table import as_text, col, first_column, is_text, long_form, strict, value
from .plan import Plan, bind

HISTOGRAM_BINS = 10
FEWEST_FOR_OUTLIERS = 4
# Messages that stand in the result table.
TOO_FEW_NUMBERS = "Insufficient numeric values for outlier detection"
TOO_FEW_COLUMNS = "Dataset requires at least 2 numeric columns for correlation analysis"


@dataclass(frozen=True)
class Result:
    """A result table and its one-row table of metrics."""

    table: DataFrame
    metrics: DataFrame


def run(df: DataFrame, plan: Plan, small_rows: int = SMALL_ROWS) -> Result:
    """Bind the plan, filter the rows and run its operation."""
    plan = bind(plan, df.columns)
    spark = df.sparkSession
    if df.isEmpty():
        return Result(
            spark.createDataFrame([], "message string"),
            spark.createDataFrame([("empty_dataset", 0)], "status string, total_records long"),
        )
    rows = apply_filters(df, plan.filters)
    if plan.operation == "group_by":
        return _group_by(rows, plan, small_rows)
    if plan.operation == "aggregate":
        return _aggregate(rows, plan)
    if plan.operation == "sort_limit":
        return _sort_limit(rows, plan)
    if plan.operation == "filter":
        return _filter(rows, plan)
    if plan.operation == "distribution":
        return _distribution(rows, plan)
    if plan.operation == "outlier_detection":
        return _outliers(rows, plan)
    if plan.operation == "correlation":
        return _correlation(rows, plan)
    if plan.operation == "missing_analysis":
        return _missing(rows)
    return _summary(rows)


def directed(c: Column, ascending: bool) -> Column:
    """Nulls come last in both directions."""
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _one_row(df: DataFrame, **values) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _number(df: DataFrame, name: str, agg: str) -> Column:
    """Aggregate over the strict numbers of a column."""
    v = strict(df, name)
    if agg == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    return {"mean": F.avg, "min": F.min, "max": F.max}[agg](v)


def _distinct_key(df: DataFrame, name: str) -> Column:
    """What to count distinct values by: long texts by hash, nested values by JSON."""
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return compact_key(col(name))
    if dtype.typeName() in ("array", "struct", "map", "variant"):
        return compact_key(as_text(df, name))
    return value(df, name)


def _group_by(df: DataFrame, plan: Plan, small_rows: int) -> Result:
    target = plan.target_columns[0] if plan.target_columns else None
    key = first_column(df, plan.group_by_column, target)
    measure = target if target and target != key else None
    agg = plan.aggregation_func or "count"
    keyed = df.withColumn(key, value(df, key)).where(col(key).isNotNull())
    if measure is None or agg == "count":
        name = "count"
        grouped = keyed.groupBy(col(key)).agg(F.count(F.lit(1)).alias(name))
    else:
        name = f"{agg}_{measure}"
        if agg == "median":
            grouped = grouped_median(keyed, key, strict(keyed, measure), None, small_rows).select(
                F.col("key").alias(key), F.col("median").alias(name)
            )
        elif agg == "distinct_count":
            grouped = keyed.groupBy(col(key)).agg(
                F.count_distinct(_distinct_key(keyed, measure)).alias(name)
            )
        else:
            grouped = keyed.groupBy(col(key)).agg(_number(keyed, measure, agg).alias(name))
    table = grouped.orderBy(directed(col(name), plan.sort_ascending), col(key)).transform(_first, plan.limit)
    metrics = table.agg(
        F.lit(key).alias("group_column"),
        F.lit(agg).alias("aggregation"),
        F.count(F.lit(1)).alias("distinct_groups_analyzed"),
        F.min_by(
            col(key).cast("string"),
            F.struct(col(name).isNull(), col(name) if plan.sort_ascending else -col(name), col(key)),
        ).alias("top_group"),
    )
    return Result(table, metrics)


def _aggregate(df: DataFrame, plan: Plan) -> Result:
    name = first_column(df, plan.target_columns[0] if plan.target_columns else None)
    agg = plan.aggregation_func or "count"
    v, c, key = strict(df, name), value(df, name), _distinct_key(df, name)
    if agg == "count":
        computed = F.count(c).cast("double")
    elif agg == "distinct_count":
        computed = F.count_distinct(key).cast("double")
    elif agg == "median":
        computed = F.max(F.lit(quantiles(df, {name: v}, [0.5])[name][0]).cast("double"))
    else:
        computed = _number(df, name, agg)
    one = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        computed.alias("computed"),
        F.count(c).alias("present"),
        F.count(F.when(c.isNull(), 1)).alias("absent"),
        F.count_distinct(key).alias("unique"),
        F.count(v).alias("numbers"),
        F.avg(v).alias("mean"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
    )
    shown = [
        ("Computed Value", "computed", False),
        ("Non-Null Count", "present", False),
        ("Null Count", "absent", False),
        ("Unique Count", "unique", False),
        ("Mean", "mean", True),
        ("Min", "lowest", True),
        ("Max", "highest", True),
    ]
    entries = [
        (
            label,
            {
                "value": F.round(F.col(source).cast("double"), 4),
                "shown": F.lit(True) if not numeric else F.col("numbers") > 0,
            },
        )
        for label, source, numeric in shown
    ]
    table = (
        long_form(one, entries)
        .where("shown")
        .select(F.col("column").alias("metric"), "value")
    )
    metrics = one.select(
        F.lit(name).alias("column"),
        "total_records",
        F.round("computed", 4).alias(f"{agg}_{name}"),
    )
    return Result(table, metrics)


def _tie(df: DataFrame, plan: Plan) -> list[Column]:
    return [col(plan.order_column)] if plan.order_column in df.columns else []


def _sort_limit(df: DataFrame, plan: Plan) -> Result:
    name = first_column(df, plan.sort_by, plan.target_columns[-1] if plan.target_columns else None)
    # Numbers first; where the column holds none the second key decides alone.
    keys = [directed(strict(df, name), plan.sort_ascending)]
    if df.schema[name].dataType.typeName() not in ("variant", "map"):
        keys.append(directed(value(df, name), plan.sort_ascending))
    table = df.orderBy(*keys, *_tie(df, plan)).transform(_first, plan.limit)
    metrics = table.agg(F.lit(name).alias("sort_by"), F.count(F.lit(1)).alias("limit"))
    return Result(table, metrics)


def _filter(df: DataFrame, plan: Plan) -> Result:
    tie = _tie(df, plan)
    table = (df.orderBy(*tie) if tie else df).transform(_first, plan.limit)
    return Result(table, df.agg(F.count(F.lit(1)).alias("matched_records")))


def _distribution(df: DataFrame, plan: Plan) -> Result:
    name = first_column(df, plan.target_columns[0] if plan.target_columns else None)
    v = strict(df, name)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("numbers"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
    ).first()
    if facts["numbers"] > facts["rows"] * 0.5:
        table = histogram(df, v, facts["lo"], facts["hi"], min(HISTOGRAM_BINS, facts["rows"]))
    else:
        text = as_text(df, name)
        table = (
            df.select(text.alias("category"))
            .where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "category")
            .transform(_first, plan.limit)
        )
    metrics = table.agg(F.lit(name).alias("column"), F.count(F.lit(1)).alias("categories_count"))
    return Result(table, metrics)


def histogram(df: DataFrame, v: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """All equal-width bins with label, edges and count; empty bins count 0."""
    edges = bin_edges(lo, hi, bins)
    labels = [
        (k, f"{round(edges[k], 1)} - {round(edges[k + 1], 1)}", edges[k], edges[k + 1])
        for k in range(bins)
    ]
    # One row per bin, at most HISTOGRAM_BINS.
    frame = df.sparkSession.createDataFrame(
        labels, "bin int, bin_range string, bin_start double, bin_end double"
    )
    counts = histogram_counts(df, v, lo, hi, bins)
    return (
        frame.join(counts, "bin", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .orderBy("bin")
    )


def _message(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(text,)], "message string")


def _outliers(df: DataFrame, plan: Plan) -> Result:
    name = first_column(df, plan.target_columns[0] if plan.target_columns else None)
    v = strict(df, name)
    facts = number_facts(df, {name: v})
    if facts[name].count < FEWEST_FOR_OUTLIERS:
        return Result(_message(df, TOO_FEW_NUMBERS), _one_row(df, column=name))
    q1, q3, lower, upper = iqr_bounds(df, [name], facts)[name]
    found = df.where(outside(v, lower, upper))
    tie = _tie(df, plan)
    table = (found.orderBy(*tie) if tie else found).transform(_first, plan.limit)
    metrics = found.agg(
        F.lit(name).alias("column"),
        F.round(F.lit(q1), 4).alias("q1"),
        F.round(F.lit(q3), 4).alias("q3"),
        F.round(F.lit(q3 - q1), 4).alias("iqr"),
        F.round(F.lit(lower), 4).alias("lower_bound"),
        F.round(F.lit(upper), 4).alias("upper_bound"),
        F.count(F.lit(1)).alias("outlier_count"),
    )
    return Result(table, metrics)


def _correlation(df: DataFrame, plan: Plan) -> Result:
    names = number_columns(df)
    if len(names) < 2:
        return Result(_message(df, TOO_FEW_COLUMNS), _one_row(df, status="too_few_columns"))
    pairs = pairs_of(df, names)
    r = F.col("correlation")
    ranked = (
        pairs.withColumn("correlation", F.round("r", 4))
        .where(r.isNotNull())
        .withColumn("relationship", F.when(r > 0, "Positive").otherwise("Negative"))
        .withColumn(
            "strength",
            F.when(F.abs(r) >= 0.7, "Strong").when(F.abs(r) >= 0.4, "Moderate").otherwise("Weak"),
        )
    )
    table = (
        ranked.orderBy(F.abs(r).desc(), "position_a", "position_b")
        .transform(_first, plan.limit)
        .select("column_a", "column_b", "correlation", "relationship", "strength")
    )
    metrics = ranked.agg(F.count(F.lit(1)).alias("pairs"))
    return Result(table, metrics)


def missing_cells(df: DataFrame) -> DataFrame:
    """(position, column, missing_count, rows): nulls and empty strings, one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count(
                F.when(is_empty(value(df, c), is_text(df.schema[c].dataType)), 1)
            ).alias(f"m{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    return long_form(
        one,
        [
            (c, {"position": F.lit(i), "missing_count": F.col(f"m{i}"), "rows": F.col("rows")})
            for i, c in enumerate(df.columns)
        ],
    )


def _missing(df: DataFrame) -> Result:
    share = F.coalesce(
        F.round(F.try_divide(F.col("missing_count") * 100, F.col("rows")), 2), F.lit(0.0)
    )
    cells = missing_cells(df)
    table = (
        cells.withColumn("present_count", F.col("rows") - F.col("missing_count"))
        .withColumn("missing_percentage", share)
        .orderBy(F.desc("missing_percentage"), "position")
        .select("column", "missing_count", "present_count", "missing_percentage")
    )
    metrics = cells.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count(F.when(F.col("missing_count") > 0, 1)).alias("columns_with_missing"),
    )
    return Result(table, metrics)


def _summary(df: DataFrame) -> Result:
    """Rows, columns, and the distinct values of every column.

    Each column is counted by a job of its own part of the union, which reads that
    column alone; one aggregation over all would copy every row once per column.
    """
    rows = df.agg(F.lit("Total Records").alias("metric"), F.count(F.lit(1)).alias("value"))
    columns = F.lit(len(df.columns)).cast("long")
    table = rows.unionByName(df.sparkSession.range(1).select(F.lit("Total Columns").alias("metric"), columns.alias("value")))
    for c in df.columns:
        distinct = df.select(_distinct_key(df, c).alias("k")).where(F.col("k").isNotNull()).distinct()
        table = table.unionByName(distinct.agg(F.lit(f"Unique '{c}'").alias("metric"), F.count(F.lit(1)).alias("value")))
    metrics = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.lit(len(df.columns)).alias("total_columns")
    )
    return Result(table, metrics)


def as_points(table: DataFrame, label: str, metric: str) -> DataFrame:
    """Chart points (name, value) of a result table."""
    return table.select(
        col(label).cast("string").alias("name"), col(metric).cast("double").alias("value")
    )
