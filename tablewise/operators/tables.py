"""Listing, searching, scoping, bulk edits and overviews of record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import content_hash
from ..scale import HOT_ROWS, cut_lineage, spread_join
from ..table import as_text, col, data_columns, long_form, strict, value

# Rows that a page may skip and show before an index is built for it.
SHALLOW = 10_000


@dataclass(frozen=True)
class Page:
    """The rows of a page and a one-row table (total, pages)."""

    rows: DataFrame
    total: DataFrame


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, kind): ``number`` when more than half of the non-nulls are numbers."""
    names = df.columns
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.count(value(df, n)).alias(f"n{i}"), F.count(strict(df, n)).alias(f"k{i}")]
    entries = [
        (
            n,
            {
                "position": F.lit(i),
                "kind": F.when(F.col(f"k{i}") > F.col(f"n{i}") * 0.5, "number").otherwise("string"),
            },
        )
        for i, n in enumerate(names)
    ]
    return long_form(df.agg(*aggs), entries)


def column_samples(df: DataFrame, order: str, size: int = 3) -> DataFrame:
    """(column, place, value): the first non-null values of each column as text.

    A rank filter over an unpivoted table; each task forwards ``size`` rows a column.
    """
    from pyspark.sql import Window

    names = df.columns
    narrow = df.select(col(order).alias("_order"), *[as_text(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    long = narrow.unpivot("_order", [f"c{i}" for i in range(len(names))], "_c", "value").where(
        F.col("value").isNotNull()
    )
    first = Window.partitionBy("_c").orderBy("_order")
    ranked = long.withColumn("place", F.row_number().over(first)).where(F.col("place") <= size)
    labels = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)])
    return ranked.select(labels[F.col("_c")].alias("column"), "place", "value")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50, shallow: int = SHALLOW) -> Page:
    """Offset pagination with the number of pages, at least 1.

    The first ``shallow`` rows come from a top-k, of which tasks keep no more than these.
    Pages behind them are read from a ``page_index``, so no task sorts what is skipped; to
    read several of them, build the index once. ``order`` must be unique.
    """
    if number * size > shallow:
        index = page_index(df, order)
        return Page(index.page(number, size), _page_total(df.sparkSession.range(1).select(F.lit(index.total).alias("total")), size))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return Page(rows, _page_total(df.agg(F.count(F.lit(1)).alias("total")), size))


def _page_total(total: DataFrame, size: int) -> DataFrame:
    return total.select(
        "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long").alias("pages"),
    )


@dataclass(frozen=True)
class PageIndex:
    """Rows in order over range partitions, each with its place, and the rows before each partition."""

    rows: DataFrame
    before: dict[int, int]
    total: int
    order: Sequence[Column]

    def page(self, number: int, size: int = 50) -> DataFrame:
        """The rows of one page, read from the partitions that hold them."""
        first, end = (number - 1) * size, number * size
        ends = [*list(self.before.values())[1:], self.total]
        parts = [(part, start) for (part, start), stop in zip(self.before.items(), ends) if start < end and stop > first]
        wanted = F.lit(False)
        for part, start in parts:
            wanted = wanted | ((F.col("_part") == part) & F.col("_at").between(first - start, end - start - 1))
        return self.rows.where(wanted).orderBy("_part", "_at").drop("_part", "_at")


def page_index(df: DataFrame, order: Sequence[Column]) -> PageIndex:
    """The table sorted once into range partitions and written, for reading any page.

    A partition is a folder of its own, and ``_at`` counts its rows from 0. What comes to
    the driver is one number a partition.
    """
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    # The lower 33 bits of this identifier count the rows of a partition.
    placed = placed.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = cut_lineage(placed, "_part")
    before, total = {}, 0
    for r in sorted(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"]):
        before[r["_part"]] = total
        total += r["n"]
    return PageIndex(rows, before, total, order)


def seek(df: DataFrame, order: str, after: Any = None, size: int = 50, descending: bool = False) -> DataFrame:
    """The next ``size`` rows after a value of a unique order column."""
    if after is not None:
        df = df.where(col(order) < F.lit(after) if descending else col(order) > F.lit(after))
    return df.orderBy(col(order).desc() if descending else col(order).asc()).limit(size)


def record_text(df: DataFrame) -> Column:
    """The record as JSON text, the form in which it is searched."""
    return F.to_json(F.struct(*[col(c) for c in data_columns(df)]))


def list_records(
    df: DataFrame,
    status: str | None = None,
    search: str | None = None,
    number: int = 1,
    size: int = 50,
    sort_by: str = "created_at",
    descending: bool = True,
    tie: str = "record_id",
) -> Page:
    """Records by status and free text, newest first; searching comes before paging."""
    if status is not None:
        df = df.where(col("validation_status") == status)
    if search:
        df = df.where(F.lower(record_text(df)).contains(search.lower()))
    first = col(sort_by).desc_nulls_last() if descending else col(sort_by).asc_nulls_last()
    return page(df, [first, col(tie).asc()], number, size)


def list_sources(
    sources: DataFrame,
    domain: str | None = None,
    retrieval_status: str | None = None,
    number: int = 1,
    size: int = 50,
    tie: str = "id",
) -> Page:
    if domain is not None:
        sources = sources.where(col("domain") == domain)
    if retrieval_status is not None:
        sources = sources.where(col("retrieval_status") == retrieval_status)
    return page(sources, [col("created_at").desc_nulls_last(), col(tie).asc()], number, size)


def search_catalog(
    df: DataFrame,
    text: str | None = None,
    columns: Sequence[str] = ("name", "description"),
    equals: Mapping[str, Any] | None = None,
    order: str = "created_at",
    tie: str = "id",
    number: int = 1,
    size: int = 20,
) -> Page:
    """Catalogue search: text anywhere in the named columns, exact filters, newest first."""
    for name, wanted in (equals or {}).items():
        df = df.where(col(name) == F.lit(wanted))
    if text:
        found = F.lit(False)
        for name in columns:
            found = found | F.coalesce(col(name).ilike(f"%{text}%"), F.lit(False))
        df = df.where(found)
    return page(df, [col(order).desc_nulls_last(), col(tie).asc()], number, size)


def scoped(df: DataFrame, datasets: DataFrame, owner: Any) -> DataFrame:
    """Rows of the owner's datasets. The owner filter runs before the join."""
    mine = datasets.where(col("user_id") == F.lit(owner)).select("dataset_id")
    return df.join(mine, "dataset_id", "left_semi")


def with_parent_name(
    df: DataFrame, parents: DataFrame, key: str, name: str, alias: str, spread_by: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Parent name looked up by key; rows without a parent stay."""
    side = parents.select(col(key), col(name).alias(alias))
    return spread_join(df, side, key, spread_by, "left", hot_rows)


def delete_records(df: DataFrame, ids: DataFrame, id_column: str, dataset_id: Any = None) -> DataFrame:
    """The table without the listed records, within one dataset when one is named."""
    listed = ids.select(col(ids.columns[0]).alias(id_column)).distinct()
    if dataset_id is None:
        return df.join(listed, id_column, "left_anti")
    listed = listed.withColumn("dataset_id", F.lit(dataset_id).cast(df.schema["dataset_id"].dataType))
    return df.join(listed, [id_column, "dataset_id"], "left_anti")


def update_records(
    df: DataFrame, ids: DataFrame, updates: Mapping[str, Any], id_column: str
) -> DataFrame:
    """Listed records get the given values; their content hash follows."""
    listed = ids.select(col(ids.columns[0]).alias(id_column)).distinct().withColumn("_hit", F.lit(True))
    out = df.join(listed, id_column, "left")
    for name, new in updates.items():
        if name in df.columns:
            literal = F.lit(new).cast(df.schema[name].dataType)
            out = out.withColumn(name, F.when(F.col("_hit"), literal).otherwise(col(name)))
        else:
            out = out.withColumn(name, F.when(F.col("_hit"), F.lit(new)))
    if "content_hash" in df.columns:
        fields = data_columns(out, ["_hit", id_column])
        out = out.withColumn(
            "content_hash",
            F.when(F.col("_hit"), content_hash(fields)).otherwise(col("content_hash")),
        )
    return out.drop("_hit")


def latest_per(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each parent, folded before the shuffle."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(col(at), col(tie)))
    return df.groupBy(col(key)).agg(newest.alias("_row")).select(
        col(key), *[F.col(f"_row.`{c}`").alias(c) for c in rest]
    )


def child_counts(children: DataFrame, key: str) -> DataFrame:
    return children.groupBy(col(key)).agg(F.count(F.lit(1)).alias("children"))


def dataset_overview(records: DataFrame, sources: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per dataset: records by status, sources, surplus of sources, latest job.

    Each input is read once and aggregated before the small results meet.
    """
    status = col("validation_status")
    counted = records.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(status == "valid", 1)).alias("valid_records"),
        F.count(F.when(status == "valid_with_warnings", 1)).alias("records_with_warnings"),
        F.count(F.when(status == "invalid", 1)).alias("rejected_records"),
    )
    found = sources.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("source_count"))
    out = counted.join(found, "dataset_id", "full")
    if jobs is not None:
        last = jobs.groupBy("dataset_id").agg(F.max_by("status", "created_at").alias("latest_job_status"))
        out = out.join(last, "dataset_id", "left")
    else:
        out = out.withColumn("latest_job_status", F.lit(None).cast("string"))
    zero = ["total_records", "valid_records", "records_with_warnings", "rejected_records", "source_count"]
    return out.fillna(0, zero).select(
        "dataset_id",
        *zero,
        F.greatest(F.col("source_count") - F.col("total_records"), F.lit(0)).alias("duplicate_count"),
        "latest_job_status",
    )


def dashboard_totals(projects: DataFrame, datasets: DataFrame, runs: DataFrame, owner: Any) -> DataFrame:
    """(metric, value) totals of one owner: projects, datasets and runs by status, rows."""
    mine = col("user_id") == F.lit(owner)

    def by_status(df: DataFrame, prefix: str) -> DataFrame:
        return (
            df.where(mine)
            .groupBy("status")
            .agg(F.count(F.lit(1)).alias("value"))
            .select(F.concat(F.lit(f"{prefix}:"), F.col("status")).alias("metric"), "value")
        )

    def overall(df: DataFrame, prefix: str) -> DataFrame:
        return df.where(mine).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(prefix).alias("metric"), "value"
        )

    rows = datasets.where(mine).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("value")).select(
        F.lit("total_rows").alias("metric"), F.col("value").cast("long").alias("value")
    )
    out = rows
    for df, name in ((projects, "projects"), (datasets, "datasets"), (runs, "runs")):
        out = out.unionByName(overall(df, name)).unionByName(by_status(df, name))
    return out


def recent(df: DataFrame, owner: Any, tie: str, size: int = 5) -> DataFrame:
    """The newest rows of one owner."""
    return (
        df.where(col("user_id") == F.lit(owner))
        .orderBy(col("created_at").desc_nulls_last(), col(tie).asc())
        .limit(size)
    )


def transformation_history(log: DataFrame, size: int | None = None) -> DataFrame:
    """The log entries, newest first; ``size`` keeps the first ones."""
    newest = log.orderBy(F.desc("created_at"), F.desc("entry_id"))
    return newest if size is None else newest.limit(size)


def record_provenance(
    links: DataFrame,
    records: DataFrame,
    datasets: DataFrame,
    sources: DataFrame,
    record_id: Any,
    owner: Any,
) -> DataFrame:
    """Evidence of one record, if it belongs to the owner. All filters reach the scans."""
    wanted = links.where(col("dataset_record_id") == F.lit(record_id))
    mine = scoped(records.where(col("record_id") == F.lit(record_id)), datasets, owner).select(
        F.col("record_id").alias("dataset_record_id")
    )
    return wanted.join(mine, "dataset_record_id", "left_semi").join(
        sources.select("data_source_id", "source_url", "domain", "page_title"), "data_source_id"
    )


def count_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence links per dataset. Links are counted per record before they join, so
    a record that holds much of the evidence is one row."""
    per_record = links.groupBy(col("dataset_record_id").alias("record_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        records.select("record_id", "dataset_id")
        .join(per_record, "record_id")
        .groupBy("dataset_id")
        .agg(F.sum("n").alias("links"))
    )


def relink(links: DataFrame, mapping: DataFrame, spread_by: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Evidence of merged records points to the retained one."""
    side = mapping.select(
        F.col("record_id").alias("dataset_record_id"), F.col("retained_id").alias("_keep")
    )
    joined = spread_join(links, side, "dataset_record_id", spread_by, "left", hot_rows)
    return joined.withColumn(
        "dataset_record_id", F.coalesce("_keep", "dataset_record_id")
    ).select(links.columns)
