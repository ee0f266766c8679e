"""Column profiles, quality scores and per-column distributions.

Counts, lengths and bounds come from plain scans, most frequent and first values from
``tablewise.frequent``: no report keeps a table of all values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..frequent import LONG_TEXT, TRACKED, Cells, distinct_counts, first_values, frequent_values
from ..functions.hashing import compact_key, content_hash
from ..functions.numbers import bin_edge, bin_index, is_numeric
from ..functions.text import MISSING_PROFILE, is_missing, strip
from ..functions.urls import has_web_scheme
from ..quantiles import Facts, quantiles
from ..table import as_text, col, data_columns, is_text, long_form, loose, value

TOP_VALUES = 5
SAMPLE_VALUES = 5
TOP_CATEGORIES = 10
DISTRIBUTION_BINS = 8
# With so many values by estimate a column has more than DISTRIBUTION_BINS for certain.
SURELY_MANY = 100

# Weight of each quality dimension.
QUALITY_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.25,
    "uniqueness": 0.20,
    "consistency": 0.15,
    "provenance": 0.15,
}
# Name parts of columns that should hold URLs.
URL_NAMES = ("url", "website", "link")
NUMBER_TYPES = ("number", "integer", "float")


@dataclass(frozen=True)
class Field:
    """Declared field: name, type, whether it is required, label."""

    name: str
    type: str = "string"
    required: bool = False
    label: str | None = None

    @property
    def display(self) -> str:
        return self.label or self.name.replace("_", " ").title()


def merged_columns(df: DataFrame, fields: Sequence[Field]) -> list[str]:
    """Declared fields first, then the other data columns."""
    names = list(dict.fromkeys(f.name for f in fields))
    return names + [c for c in data_columns(df) if c not in names]


def _whole_texts(df: DataFrame, picks: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The picked rows with long texts put back, looked up by position.

    ``picks`` holds a few rows per column, so their positions are broadcast; the
    texts, of any length, are not.
    """
    texts = [c for c in columns if is_text(df.schema[c].dataType)]
    if not texts:
        return picks
    wanted = F.broadcast(
        picks.where(F.col("key").startswith("sha256:")).select("column", F.col("first").alias("_order"))
    ).distinct()
    values = (
        df.select(col(order).alias("_order"), *[col(c) for c in texts])
        .unpivot("_order", [col(c) for c in texts], "column", "text")
        .join(F.broadcast(wanted), ["column", "_order"], "left_semi")
        .withColumnRenamed("_order", "first")
    )
    return picks.join(values, ["column", "first"], "left").withColumn("key", F.coalesce("text", "key"))


@dataclass(frozen=True)
class _Numbers:
    """What one pass tells about the loose numbers of a column."""

    non_null: int
    count: int
    low: float | None
    high: float | None
    mean: float | None

    def qualifies(self, declared: str) -> bool:
        enough = self.non_null > 0 and self.count >= max(1, int(0.7 * self.non_null))
        return enough and (
            declared in NUMBER_TYPES or declared == "string" and self.count == self.non_null
        )


def _reading(df: DataFrame, name: str) -> Column:
    """Loose number of a non-missing cell."""
    if is_text(df.schema[name].dataType):
        return F.when(~is_missing(col(name), MISSING_PROFILE), loose(df, name))
    return loose(df, name)


def _written(df: DataFrame, name: str) -> Column:
    """Text of a non-missing cell."""
    text = as_text(df, name)
    return F.when(~is_missing(text, MISSING_PROFILE), text)


def profile_columns(df: DataFrame, order: str, fields: Sequence[Field] = ()) -> DataFrame:
    """One row per column with counts, type, number and text statistics, top values
    and samples. Declared columns that the table lacks are fully missing.

    One scan takes counts, bounds and lengths; medians, distinct values, top values and
    samples follow from the scans of ``quantiles`` and ``frequent``.
    """
    names = merged_columns(df, fields)
    declared = {f.name: f for f in fields}
    present = [c for c in names if c in df.columns]
    texts = [c for c in present if is_text(df.schema[c].dataType)]
    typed = [c for c in present if is_numeric(df.schema[c].dataType)]
    able = [c for c in present if c in texts or c in typed]

    def kind(c: str) -> str:
        return declared[c].type if c in declared else "string"

    def urls_wanted(c: str) -> bool:
        return "url" in c.lower() or kind(c) == "url"

    # Numbers are shown without lengths, so those of typed columns are not written out.
    worded = [c for c in present if c not in typed or kind(c) not in (*NUMBER_TYPES, "string")]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(present):
        t = _written(df, c)
        aggs.append(F.count(_reading(df, c) if c in typed else t).alias(f"h{i}"))
        if c in worded:
            aggs += [F.min(F.length(t)).alias(f"min{i}"), F.max(F.length(t)).alias(f"max{i}"), F.avg(F.length(t)).alias(f"avg{i}")]
        if urls_wanted(c):
            aggs.append(F.count(F.when(has_web_scheme(t), 1)).alias(f"u{i}"))
        if c in able:
            v = _reading(df, c)
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}")]
    row = df.agg(*aggs).first()
    rows = row["rows"]
    place = {c: i for i, c in enumerate(present)}
    found = {
        c: _Numbers(*(row[f"{x}{place[c]}"] for x in ("h", "n", "lo", "hi", "m"))) for c in able
    }
    numeric = [c for c in able if found[c].qualifies(kind(c))]
    medians = quantiles(
        df,
        {c: _reading(df, c) for c in numeric},
        [0.5],
        {c: Facts(found[c].count, found[c].low, found[c].high) for c in numeric},
    )
    uniques = distinct_counts(df, present)

    def fact(kind_of_fact: str, c: str):
        return row[f"{kind_of_fact}{place[c]}"] if f"{kind_of_fact}{place[c]}" in row else None

    entries = [
        (
            c, i, kind(c), (declared.get(c) or Field(c)).display, c in df.columns, c in numeric,
            *((found[c].low, found[c].high, found[c].mean, medians[c][0]) if c in numeric else (None,) * 4),
            *((fact("h", c), uniques[c], fact("min", c), fact("max", c), fact("avg", c), fact("u", c)) if c in place else (None,) * 6),
        )
        for i, c in enumerate(names)
    ]
    # One row per column.
    frame = df.sparkSession.createDataFrame(
        entries,
        "column string, position int, declared string, label string, present boolean, numeric boolean,"
        " lo double, hi double, avg double, med double,"
        " non_null long, unique long, min_len int, max_len int, avg_len double, urls long",
    )
    top = frequent_values(df, present, order, TOP_VALUES, uniques, {c: fact("h", c) for c in present})
    sample = first_values(df, present, order, SAMPLE_VALUES, uniques)
    if any((fact("max", c) or 0) > LONG_TEXT for c in texts):
        top, sample = (_whole_texts(df, p, present, order) for p in (top, sample))
    n = F.col("n")
    share = F.round(n * 100.0 / F.lit(max(rows, 1)), 1)
    # At most five entries per column.
    top = top.groupBy("column").agg(
        F.sort_array(
            F.collect_list(
                F.struct("place", F.col("key").alias("value"), n.alias("count"), share.alias("percentage"))
            )
        ).alias("top")
    )
    sample = sample.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("key").alias("value")))).alias("sample")
    )
    return _profile_rows(frame, rows, top, sample)


TOP_TYPE = "array<struct<place:int,value:string,count:bigint,percentage:double>>"


def _profile_rows(frame: DataFrame, rows: int, top: DataFrame, sample: DataFrame) -> DataFrame:
    # All of these hold one row per column.
    joined = frame.join(F.broadcast(top), "column", "left").join(F.broadcast(sample), "column", "left")
    non_null = F.coalesce("non_null", F.lit(0))
    declared = F.col("declared")
    url = F.col("present") & (F.lower("column").contains("url") | (declared == "url"))
    wordy = F.col("present") & ~F.col("numeric") & (non_null > 0)
    return joined.orderBy("position").select(
        F.col("column").alias("column_name"),
        F.col("label").alias("display_label"),
        F.when(url, "url").when(F.col("numeric"), "number").otherwise(declared).alias("inferred_type"),
        non_null.alias("non_null_count"),
        (F.lit(rows) - non_null).alias("null_count"),
        F.when(~F.col("present"), F.lit(100.0))
        .otherwise(F.round((F.lit(rows) - non_null) * 100.0 / F.lit(max(rows, 1)), 1))
        .alias("missing_percentage"),
        F.coalesce("unique", F.lit(0)).alias("unique_count"),
        (non_null - F.coalesce("unique", F.lit(0))).alias("duplicate_count"),
        F.round("lo", 2).alias("min_value"),
        F.round("hi", 2).alias("max_value"),
        F.round("avg", 2).alias("mean"),
        F.round("med", 2).alias("median"),
        F.when(wordy, F.col("min_len")).alias("min_len"),
        F.when(wordy, F.col("max_len")).alias("max_len"),
        F.when(wordy, F.round("avg_len", 1)).alias("avg_len"),
        F.when(~F.col("present"), F.lit(0.0))
        .when(url, F.round(F.coalesce("urls", F.lit(0)) * 100.0 / F.greatest(non_null, F.lit(1)), 1))
        .otherwise(F.lit(100.0))
        .alias("valid_format_percentage"),
        F.transform(
            F.coalesce("top", F.array().cast(TOP_TYPE)),
            lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"), t["percentage"].alias("percentage")),
        ).alias("top_values"),
        F.coalesce(F.col("sample.value"), F.array().cast("array<string>")).alias("sample_values"),
    )


def record_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """Stored content hash where the table has one, else computed."""
    return F.coalesce(col("content_hash"), content_hash(columns)) if (
        "content_hash" in df.columns
    ) else content_hash(columns)


def distinct_records(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of distinct records; copies combine before the shuffle."""
    return df.select(record_hash(df, columns).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("n")
    ).agg(F.count(F.lit(1)).alias("distinct_records"))


def _status(df: DataFrame) -> Column:
    if "validation_status" not in df.columns:
        return F.lit("valid")
    return col("validation_status")


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """One row with the values of several one-row frames, all of them whole numbers."""
    long = [
        p.select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(c).alias("k"), col(c).cast("long").alias("v")) for c in p.columns]
                )
            )
        )
        for p in parts
    ]
    stacked = long[0]
    for p in long[1:]:
        stacked = stacked.unionByName(p)
    names = [c for p in parts for c in p.columns]
    return stacked.agg(
        *[F.coalesce(F.max(F.when(F.col("k") == c, F.col("v"))), F.lit(0)).alias(c) for c in names]
    )


def profile_overview(df: DataFrame, sources: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: records by validation status, duplicates, unique records."""
    names = list(columns) if columns is not None else data_columns(df)
    status = _status(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(status == "valid", 1)).alias("valid_records"),
        F.count(F.when(status == "valid_with_warnings", 1)).alias("records_with_warnings"),
        F.count(F.when(status == "invalid", 1)).alias("invalid_records"),
    )
    facts = one_row([counts, distinct_records(df, names)])
    return facts.select(
        "total_records",
        F.lit(len(names)).cast("long").alias("total_columns"),
        F.lit(sources).cast("long").alias("total_sources"),
        "valid_records",
        "records_with_warnings",
        "invalid_records",
        (F.col("total_records") - F.col("distinct_records")).alias("duplicate_records"),
        F.col("distinct_records").alias("unique_records"),
    )


def _inconsistent(df: DataFrame, name: str) -> Column:
    """1 where a cell is untrimmed, has a double space, or should be a URL and is none."""
    text = as_text(df, name)
    url_named = any(part in name.lower() for part in URL_NAMES)
    bad = F.lit(False)
    if is_text(df.schema[name].dataType):
        bad = (text != strip(text)) | text.contains("  ")
    if url_named:
        bad = bad | ~has_web_scheme(text)
    return F.when(text.isNotNull() & (text != "") & bad, 1)


def quality_facts(
    df: DataFrame, fields: Sequence[Field] = (), sources: int = 0, links: int = 0,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row of counts behind the scores: one pass for cells and status, one
    shuffle of hashes for the copies."""
    names = list(columns) if columns is not None else data_columns(df)
    expected = [f.name for f in fields] or sorted(names)
    required = [f.name for f in fields if f.required]

    def filled(name: str) -> Column:
        if name not in df.columns:
            return F.lit(False)
        return ~is_missing(as_text(df, name), MISSING_PROFILE)

    any_missing = F.lit(False)
    for name in required:
        any_missing = any_missing | ~filled(name)
    status = _status(df)
    backed = (
        F.coalesce(col("source_count"), F.lit(0)) > 0 if "source_count" in df.columns else F.lit(False)
    )
    cells = df.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count(F.when(filled(n), 1)).alias(f"f{i}") for i, n in enumerate(expected)],
        F.count(F.when(any_missing, 1)).alias("missing_required"),
        F.count(F.when(status.isNull() | (status == "valid"), 1)).alias("valid"),
        F.count(F.when(status == "valid_with_warnings", 1)).alias("warnings"),
        *[F.count(_inconsistent(df, n)).alias(f"b{i}") for i, n in enumerate(names)],
        F.count(F.when(backed, 1)).alias("backed"),
    )

    def total(prefix: str, size: int) -> Column:
        result = F.lit(0).cast("long")
        for i in range(size):
            result = result + F.col(f"{prefix}{i}")
        return result

    folded = cells.select(
        "records",
        total("f", len(expected)).alias("populated"),
        (F.col("records") * max(len(expected), 1)).alias("cells"),
        "missing_required",
        "valid",
        "warnings",
        (F.col("records") - F.col("valid") - F.col("warnings")).alias("invalid"),
        total("b", len(names)).alias("inconsistent"),
        # Rows without sources count as backed as far as links exist; a table with
        # sources but no backed row counts as backed altogether.
        F.when((F.col("backed") < F.col("records")) & F.lit(links > 0), F.least(F.col("records"), F.lit(links)))
        .when((F.col("backed") == 0) & F.lit(sources > 0), F.col("records"))
        .otherwise(F.col("backed"))
        .alias("with_sources"),
    )
    return one_row([folded, distinct_records(df, names)]).withColumn(
        "duplicates", F.col("records") - F.col("distinct_records")
    )


def quality_scores(
    df: DataFrame, fields: Sequence[Field] = (), sources: int = 0, links: int = 0,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per quality dimension and one for the weighted overall score.

    An empty table scores zero everywhere.
    """
    facts = quality_facts(df, fields, sources, links, columns)
    c = F.col

    def score(part: Column, whole: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))

    scored = facts.select(
        "*",
        score(c("populated"), c("cells")).alias("completeness"),
        score(c("valid") + c("warnings") * 0.5, c("records")).alias("validity"),
        score(c("distinct_records"), c("records")).alias("uniqueness"),
        score(F.greatest(c("cells") - c("inconsistent"), F.lit(0)), c("cells")).alias("consistency"),
        score(c("with_sources"), c("records")).alias("provenance"),
    )
    overall = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        overall = overall + c(name) * F.lit(weight)

    def advice(*rules: tuple[Column, Column]) -> Column:
        texts = [F.when((c("records") > 0) & when, text) for when, text in rules]
        return F.filter(F.array(*texts), lambda t: t.isNotNull())

    def say(name: str, text: str) -> Column:
        return F.concat(c(name).cast("string"), F.lit(text))

    rows = {
        "completeness": (
            c("missing_required"),
            advice(
                (c("missing_required") > 0, say("missing_required", " records lack a required field: fill or drop them.")),
                (c("completeness") < 80.0, F.lit("Fill missing values with constants or defaults.")),
            ),
        ),
        "validity": (
            c("invalid") + c("warnings"),
            advice(
                (c("invalid") > 0, say("invalid", " records failed validation: inspect them.")),
                (c("warnings") > 0, say("warnings", " records carry warnings.")),
            ),
        ),
        "uniqueness": (
            c("duplicates"),
            advice((c("duplicates") > 0, say("duplicates", " records are copies: resolve the groups."))),
        ),
        "consistency": (
            c("inconsistent"),
            advice((c("inconsistent") > 0, say("inconsistent", " cells have stray whitespace or odd URLs: clean them."))),
        ),
        "provenance": (
            c("records") - c("with_sources"),
            advice((c("provenance") < 100.0, F.concat((c("records") - c("with_sources")).cast("string"), F.lit(" records have no source.")))),
        ),
    }
    entries = [
        (name, {"score": c(name), "affected_count": affected, "suggestions": tips})
        for name, (affected, tips) in rows.items()
    ]
    nothing = F.array().cast("array<string>")
    entries.append(
        ("overall", {"score": F.round(overall, 1), "affected_count": F.lit(0).cast("long"), "suggestions": nothing})
    )
    return long_form(scored, entries).withColumnRenamed("column", "dimension")


def field_distributions(
    df: DataFrame, order: str, columns: Sequence[str] | None = None, top: int | None = TOP_CATEGORIES
) -> DataFrame:
    """Histogram or ``top`` categories (None: all) of every column, in long form.

    Columns: column, type (numeric, categorical, empty), position, label, count,
    bin_min, bin_max. A column is numeric when 80 % of its values hold a number.
    Numbers are counted by bin, never by value.
    """
    names = [c for c in (columns or data_columns(df)) if c in df.columns]
    spark = df.sparkSession
    numbers = {c: F.when(_written(df, c).isNotNull(), loose(df, c)) if is_text(df.schema[c].dataType) else loose(df, c) for c in names}
    able = [c for c in names if is_text(df.schema[c].dataType) or is_numeric(df.schema[c].dataType)]
    aggs = []
    for i, c in enumerate(names):
        held = numbers[c] if c in able and not is_text(df.schema[c].dataType) else _written(df, c)
        aggs += [F.count(held).alias(f"t{i}"), F.approx_count_distinct(Cells.of(df, c).raw).alias(f"u{i}")]
        if c in able:
            v = numbers[c]
            aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.approx_count_distinct(v).alias(f"d{i}")]
    row = df.agg(*aggs).first().asDict() if names else {}
    facts = {c: {k: row.get(f"{k}{i}") for k in ("t", "u", "n", "lo", "hi", "d")} for i, c in enumerate(names)}
    numeric_names = [c for c in able if facts[c]["t"] and facts[c]["n"] >= max(1, int(facts[c]["t"] * 0.8))]
    # The estimate is right within a few percent, so these sets are small.
    few = [c for c in numeric_names if facts[c]["d"] < SURELY_MANY]
    if few:
        sizes = df.agg(*[F.size(F.collect_set(numbers[c])).alias(f"s{i}") for i, c in enumerate(few)]).first()
        for i, c in enumerate(few):
            facts[c]["d"] = sizes[f"s{i}"]
    stats = spark.createDataFrame(
        [
            (c, float(facts[c]["lo"]), float(facts[c]["hi"]), 1 if facts[c]["lo"] == facts[c]["hi"] else min(DISTRIBUTION_BINS, facts[c]["d"]))
            for c in numeric_names
        ],
        "column string, lo double, hi double, bins int",
    )
    n = F.col("n")
    lo, hi, bins, k = F.col("lo"), F.col("hi"), F.col("bins"), F.col("position")
    binned = spark.createDataFrame([], "column string, position int, count long")
    if numeric_names:
        places = []
        for r in stats.collect():
            low, high, many, v = F.lit(r["lo"]), F.lit(r["hi"]), F.lit(r["bins"]), numbers[r["column"]]
            at = F.lit(0) if r["lo"] == r["hi"] else bin_index(v, low, high, many)
            places.append(F.when(v.isNotNull(), F.struct(F.lit(r["column"]).alias("column"), at.alias("position"))))
        # At most DISTRIBUTION_BINS rows a column leave a task.
        cells = df.select(F.explode(F.array(*places)).alias("p")).where("p IS NOT NULL")
        binned = cells.groupBy("p.column", "p.position").agg(F.count(F.lit(1)).alias("count"))
    single = lo == hi
    start = F.when(single, lo).otherwise(bin_edge(lo, hi, bins, k))
    end = F.when(single, hi).otherwise(bin_edge(lo, hi, bins, k + 1))
    label = (
        F.when(single, F.format_string("%.0f", F.bround("bin_min", 0)))
        .when(
            F.col("bin_max") > 100,
            F.format_string("%,.0f - %,.0f", F.bround("bin_min", 0), F.bround("bin_max", 0)),
        )
        .otherwise(F.format_string("%.1f - %.1f", F.bround("bin_min", 1), F.bround("bin_max", 1)))
    )
    frames = (
        stats.withColumn("position", F.explode(F.sequence(F.lit(0), bins - 1)))
        .join(F.broadcast(binned), ["column", "position"], "left")
        .withColumn("bin_min", start)
        .withColumn("bin_max", end)
        .select(
            "column",
            F.lit("numeric").alias("type"),
            "position",
            label.alias("label"),
            F.coalesce("count", F.lit(0)).alias("count"),
            "bin_min",
            "bin_max",
        )
    )
    nothing = F.lit(None).cast("double")
    texts = [c for c in names if facts[c]["t"] and c not in numeric_names]
    frequent = frequent_values(df, texts, order, top, few=[c for c in texts if facts[c]["u"] <= TRACKED // 2])
    categories = _whole_texts(df, frequent, texts, order).select(
        "column",
        F.lit("categorical").alias("type"),
        (F.col("place") - 1).alias("position"),
        F.col("key").alias("label"),
        n.alias("count"),
        nothing.alias("bin_min"),
        nothing.alias("bin_max"),
    )
    listed = spark.createDataFrame([(c,) for c in names if not facts[c]["t"]], "column string")
    empty = listed.select(
        "column",
        F.lit("empty").alias("type"),
        F.lit(0).alias("position"),
        F.lit(None).cast("string").alias("label"),
        F.lit(0).cast("long").alias("count"),
        nothing.alias("bin_min"),
        nothing.alias("bin_max"),
    )
    return frames.unionByName(categories).unionByName(empty)


def chart_points(
    df: DataFrame, x: str, y: str | None = None, aggregation: str = "count", max_items: int | None = None
) -> DataFrame:
    """Chart points (name, value): x as text, largest values first."""
    agg = aggregation.lower()
    y = y if y in df.columns else None
    if x not in df.columns:
        return df.sparkSession.createDataFrame([], "name string, value double")
    rows = df.withColumn("name", as_text(df, x)).where(F.col("name").isNotNull())
    if agg == "distinct_count" and y is None:
        return rows.agg(F.lit(x).alias("name"), F.count_distinct("name").alias("value"))
    if agg in ("sum", "avg", "min", "max") and y is not None:
        v = loose(df, y)
        total = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "avg": F.avg(v), "min": F.min(v), "max": F.max(v)}
        points = rows.groupBy("name").agg(F.round(total[agg], 2).alias("value")).where(
            F.col("value").isNotNull()
        )
    elif agg == "distinct_count":
        points = rows.groupBy("name").agg(F.count_distinct(compact_key(as_text(df, y))).alias("value"))
    else:
        points = rows.groupBy("name").agg(F.count(F.lit(1)).alias("value"))
    ordered = points.orderBy(F.desc("value"), "name")
    return ordered if max_items is None else ordered.limit(max_items)
