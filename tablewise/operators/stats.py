"""Descriptive statistics, outliers, correlations, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import bin_index, is_numeric
from ..functions.text import is_empty
from ..quantiles import Facts, quantiles
from ..scale import HOT_SHARE, SKETCH_ACCURACY, SMALL_ROWS, cut_lineage
from ..table import col, is_text, long_form, strict, value

# Slices that the values of a hot group are cut into.
VALUE_SLICES = 256

NUMERIC_CANDIDATES = ("boolean",)

DESCRIBE_SCHEMA = (
    "column string, count long, mean double, std double, min double, q25 double,"
    " median double, q75 double, max double, null_count long"
)


def _candidates(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that may hold strict numbers by their type."""
    names = df.columns if columns is None else [c for c in columns if c in df.columns]
    return [
        n
        for n in names
        if is_numeric(df.schema[n].dataType)
        or is_text(df.schema[n].dataType)
        or df.schema[n].dataType.typeName() in NUMERIC_CANDIDATES
    ]


def number_counts(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows and strict numbers per candidate column, in one aggregation."""
    names = _candidates(df, columns)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(strict(df, n)).alias(f"n{i}") for i, n in enumerate(names)],
    ).first()
    return row["rows"], {n: row[f"n{i}"] for i, n in enumerate(names)}


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column that holds a number: count, mean, sample deviation,
    extremes, quartiles, empty cells; four decimals.

    One aggregation for the moments, then the quartiles by narrowing.
    """
    names = _candidates(df, columns)
    if not names:
        return _describe_schema(df)
    aggs: list[Column] = []
    for i, n in enumerate(names):
        v = strict(df, n)
        textual = is_text(df.schema[n].dataType)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.count(F.when(is_empty(value(df, n), textual), 1)).alias(f"empty{i}"),
        ]
    row = df.agg(*aggs).first()
    facts = {
        n: Facts(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(names) if row[f"n{i}"]
    }
    quarts = quantiles(df, {n: strict(df, n) for n in facts}, [0.25, 0.5, 0.75], facts)
    # One row per column.
    report = [
        (
            n,
            row[f"n{i}"],
            row[f"mean{i}"],
            row[f"std{i}"] if row[f"n{i}"] > 1 else 0.0,
            row[f"lo{i}"],
            *quarts[n],
            row[f"hi{i}"],
            row[f"empty{i}"],
        )
        for i, n in enumerate(names)
        if n in facts
    ]
    out = df.sparkSession.createDataFrame(report, DESCRIBE_SCHEMA)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "q25", "median", "q75", "max")})


def _describe_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], DESCRIBE_SCHEMA)


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], facts: Mapping[str, Facts] | None = None
) -> dict[str, tuple[float, float, float, float] | None]:
    """(q1, q3, lower, upper) per column; None where the column has no number."""
    found = quantiles(df, {n: strict(df, n) for n in columns}, [0.25, 0.75], facts)
    bounds: dict[str, tuple[float, float, float, float] | None] = {}
    for n in columns:
        q1, q3 = found[n]
        if q1 is None:
            bounds[n] = None
            continue
        reach = 1.5 * (q3 - q1)
        bounds[n] = (q1, q3, q1 - reach, q3 + reach)
    return bounds


def outside(v: Column, lower: float, upper: float) -> Column:
    return (v < F.lit(lower)) | (v > F.lit(upper))


def outlier_report(
    df: DataFrame,
    order: str,
    columns: Sequence[str] | None = None,
    samples: int = 5,
) -> DataFrame:
    """One row per numeric column: bounds, outlier count, first outlying values.

    The bounds are literals, so counting and sampling read the table once more
    each; per task only ``samples`` rows of a column reach the sort.
    """
    names = _candidates(df, columns)
    bounds = {n: b for n, b in iqr_bounds(df, names).items() if b}
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, lower_bound double, upper_bound double, outlier_count long,"
            " sample_outlier_values array<double>"
        )
    kept = list(bounds)
    counts = df.agg(
        *[
            F.count(F.when(outside(strict(df, n), *bounds[n][2:]), 1)).alias(f"n{i}")
            for i, n in enumerate(kept)
        ]
    )
    report = long_form(
        counts,
        [
            (
                n,
                {
                    "position": F.lit(i),
                    "lower_bound": F.round(F.lit(bounds[n][2]), 4),
                    "upper_bound": F.round(F.lit(bounds[n][3]), 4),
                    "outlier_count": F.col(f"n{i}"),
                },
            )
            for i, n in enumerate(kept)
        ],
    )
    far = long_form(
        df.withColumn("_order", col(order)),
        [
            (n, {"v": F.when(outside(strict(df, n), *bounds[n][2:]), strict(df, n))})
            for n in kept
        ],
        ["_order"],
    ).where(F.col("v").isNotNull())
    first = Window.partitionBy("column").orderBy("_order")
    picked = (
        far.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= samples)
        .groupBy("column")
        # At most ``samples`` entries per column.
        .agg(F.sort_array(F.collect_list(F.struct("place", F.round("v", 4).alias("v")))).alias("s"))
        .select("column", F.col("s.v").alias("sample_outlier_values"))
    )
    return (
        report.join(F.broadcast(picked), "column", "left")
        .withColumn(
            "sample_outlier_values",
            F.coalesce("sample_outlier_values", F.array().cast("array<double>")),
        )
        .orderBy("position")
        .drop("position")
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, r) for every pair of columns that hold a number.

    Pairwise complete rows; r is null for a constant column. Bare ``corr`` would
    raise on one. All pairs of a pass share one scan.
    """
    return pairs_of(df, number_columns(df, columns))


def number_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that hold a number. Those of numeric type need no look at the data
    as long as there are two of them: an empty one only yields null coefficients."""
    names = _candidates(df, columns)
    typed = [n for n in names if is_numeric(df.schema[n].dataType)]
    unsure = names if len(typed) < 2 else [n for n in names if n not in typed]
    if not unsure:
        return names
    _, counts = number_counts(df, unsure)
    return [n for n in names if n not in counts or counts[n] > 0]


def _finite(v: Column) -> Column:
    """Infinite cells count as gaps."""
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _gram(narrow: DataFrame, cells: Sequence[Column]) -> np.ndarray:
    """Sums of the products of every two of ``cells`` over all rows.

    One scan whatever their number: rows become vectors, each task adds up one matrix, and
    the matrices are added up in a tree, all of it outside Python. The result has one cell
    for each two of ``cells``.
    """
    vectors = narrow.select(array_to_vector(F.array(*cells)).alias("row"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row")).computeGramianMatrix().toArray()


def pairs_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(position_a, position_b, column_a, column_b, r) of all pairs of ``names``.

    A first scan takes count, mean and extremes of each column, a second one all products
    of the columns around their means (``_gram``). A column with gaps also brings its mask,
    and then every column its squares, so that each pair is judged on its common rows.
    Infinite cells are gaps. r is null for a column that is constant, or has no number.
    """
    spark = df.sparkSession
    schema = "position_a int, position_b int, column_a string, column_b string, r double"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    numbers = df.select(*[_finite(strict(df, n)).alias(f"v{i}") for i, n in enumerate(names)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    facts = numbers.agg(*aggs).first()
    size = len(names)
    still = {i for i in range(size) if facts[f"lo{i}"] == facts[f"hi{i}"]}
    gappy = [i for i in range(size) if facts[f"n{i}"] < facts["rows"]]
    r = np.full((size, size), np.nan)
    if len(still) < size - 1:
        around = [F.coalesce(F.col(f"v{i}") - F.lit(facts[f"mean{i}"] or 0.0), F.lit(0.0)) for i in range(size)]
        masks = [F.when(F.col(f"v{i}").isNotNull(), 1.0).otherwise(0.0) for i in gappy]
        squares = [x * x for x in around] if gappy else []
        g = _gram(numbers, [*around, F.lit(1.0), *masks, *squares])
        # The mask of each column: its own, or the row of ones.
        mask = np.full(size, size)
        mask[gappy] = size + 1 + np.arange(len(gappy))
        first = size + 1 + len(gappy)
        n = g[np.ix_(mask, mask)]
        # Sums and squares of the column of the row over the rows it has in common with the other.
        total = g[np.ix_(range(size), mask)]
        square = g[np.ix_(range(first, first + size), mask)] if gappy else np.repeat(np.diag(g)[:size, None], size, axis=1)
        with np.errstate(all="ignore"):
            left = square - total * total / n
            # What is left of equal values after subtraction is noise.
            spread = np.sqrt(np.where(left > square * 1e-12, left, np.nan))
            r = (g[:size, :size] - total * total.T / n) / spread / spread.T
    entries = [
        (i, j, names[i], names[j], float(r[i, j]) if np.isfinite(r[i, j]) and not {i, j} & still else None)
        for i in range(size)
        for j in range(i + 1, size)
    ]
    # One row per pair of columns.
    return spark.createDataFrame(entries, schema)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full matrix in long form, three decimals; undefined cells are null."""
    r = F.round("r", 3)
    pairs = correlation_pairs(df, columns)
    upper = pairs.select("position_a", "position_b", "column_a", "column_b", r.alias("r"))
    lower = pairs.select(
        F.col("position_b").alias("position_a"),
        F.col("position_a").alias("position_b"),
        F.col("column_b").alias("column_a"),
        F.col("column_a").alias("column_b"),
        r.alias("r"),
    )
    names = _candidates(df, columns)
    numbers = df.agg(
        *[F.count(strict(df, n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[
            F.when(F.min(strict(df, n)) < F.max(strict(df, n)), F.lit(1.0)).alias(f"d{i}")
            for i, n in enumerate(names)
        ],
    )
    diagonal = (
        numbers.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("position_a"),
                            F.lit(i).alias("position_b"),
                            F.lit(n).alias("column_a"),
                            F.lit(n).alias("column_b"),
                            F.col(f"d{i}").alias("r"),
                            F.col(f"n{i}").alias("n"),
                        )
                        for i, n in enumerate(names)
                    ]
                )
            )
        )
        .where(F.col("n") > 0)
        .drop("n")
        if names
        else upper.limit(0)
    )
    return (
        upper.unionByName(lower)
        .unionByName(diagonal)
        .select("column_a", "column_b", "r")
    )


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs by falling strength, three decimals, with the report's strength words."""
    r = F.col("coefficient")
    word = (
        F.when(r >= 0.7, "strong_positive")
        .when(r >= 0.4, "moderate_positive")
        .when(r <= -0.7, "strong_negative")
        .when(r <= -0.4, "moderate_negative")
        .otherwise("weak")
    )
    return (
        correlation_pairs(df, columns)
        .withColumn("coefficient", F.round("r", 3))
        .where(r.isNotNull())
        .withColumn("strength", word)
        .orderBy(F.abs(r).desc(), "position_a", "position_b")
        .select("column_a", "column_b", "coefficient", "strength")
    )


def histogram_counts(df: DataFrame, v: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, count) of the non-empty equal-width bins of ``v``."""
    index = bin_index(F.col("v"), F.lit(lo), F.lit(hi), F.lit(bins))
    return (
        df.select(v.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    return [lo + k * width for k in range(bins)] + [hi]


def grouped_median(
    df: DataFrame, key: str, v: Column, rows: int | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """(key, median) with exact medians; null where a group has no number.

    Small tables use ``median``. Otherwise it would gather the values of a hot
    group in one task, so equal values are counted first and the middle ranks are
    read off running counts. Groups above 1/10,000 of the rows are cut into value
    slices inside a bracket found by a sketch, so no task orders a whole hot group.
    """
    narrow = df.select(col(key).alias("key"), v.alias("v")).where(F.col("key").isNotNull())
    total = narrow.count() if rows is None else rows
    if total <= small_rows:
        return narrow.groupBy("key").agg(F.median("v").alias("median"))
    share = total // HOT_SHARE + 1
    margin = 2.0 / SKETCH_ACCURACY
    ends = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    # At most 10,000 keys hold more than one ten-thousandth of all rows. Only their
    # rows are sketched; both lists are written once and then broadcast.
    keys = cut_lineage(
        narrow.groupBy("key").agg(F.count("v").alias("n")).where(F.col("n") > share).select("key")
    )
    hot = cut_lineage(
        narrow.join(F.broadcast(keys), "key")
        .groupBy("key")
        .agg(F.percentile_approx("v", ends, SKETCH_ACCURACY).alias("s"))
        .select("key", F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))
    )
    # Read three times below: by groups that are not hot, for slices, and inside slices.
    counted = cut_lineage(
        narrow.where(F.col("v").isNotNull())
        .groupBy("key", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(hot), "key", "left")
    )
    span = F.col("hi") - F.col("lo")
    inside = F.when(
        span > 0,
        F.least(
            F.lit(VALUE_SLICES), F.floor((F.col("v") - F.col("lo")) / span * VALUE_SLICES) + 1
        ),
    ).otherwise(1)
    # Groups that are not hot are ordered whole; they are small by definition.
    whole = Window.partitionBy("key")
    cold = counted.where(F.col("lo").isNull()).select(
        "key", "v", "n", F.sum("n").over(whole.orderBy("v")).alias("at"), F.sum("n").over(whole).alias("total")
    )
    cold = cold.withColumn("low", F.floor((F.col("total") + 1) / 2)).withColumn("high", F.floor((F.col("total") + 2) / 2))
    sliced = counted.where(F.col("lo").isNotNull()).select(
        "key",
        "v",
        "n",
        F.when(F.col("v") < F.col("lo"), 0)
        .when(F.col("v") > F.col("hi"), VALUE_SLICES + 1)
        .otherwise(inside)
        .cast("int")
        .alias("slice"),
    )
    # At most VALUE_SLICES + 2 rows per key from here on.
    in_order = Window.partitionBy("key").orderBy("slice")
    slices = (
        sliced.groupBy("key", "slice")
        .agg(F.sum("n").alias("m"))
        .withColumn("upto", F.sum("m").over(in_order))
        .withColumn("total", F.sum("m").over(Window.partitionBy("key")))
        .withColumn("low", F.floor((F.col("total") + 1) / 2))
        .withColumn("high", F.floor((F.col("total") + 2) / 2))
        .withColumn("before", F.col("upto") - F.col("m"))
        .where(
            ((F.col("low") > F.col("before")) & (F.col("low") <= F.col("upto")))
            | ((F.col("high") > F.col("before")) & (F.col("high") <= F.col("upto")))
        )
        .select("key", "slice", "before", "low", "high")
    )
    running = F.sum("n").over(Window.partitionBy("key", "slice").orderBy("v"))
    # Two slices a hot key at most: broadcast, so all other slices go before the shuffle.
    placed = sliced.join(F.broadcast(slices), ["key", "slice"]).select(
        "key", "v", "n", (F.col("before") + running).alias("at"), "low", "high"
    )
    placed = placed.unionByName(cold.select("key", "v", "n", "at", "low", "high"))

    def holds(rank: str) -> Column:
        return (F.col(rank) <= F.col("at")) & (F.col(rank) > F.col("at") - F.col("n"))

    medians = placed.groupBy("key").agg(
        (
            (F.max(F.when(holds("low"), F.col("v"))) + F.max(F.when(holds("high"), F.col("v")))) / 2
        ).alias("median")
    )
    return narrow.select("key").distinct().join(medians, "key", "left")
