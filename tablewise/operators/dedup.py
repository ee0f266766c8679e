"""Duplicates: first record per key, clusters in tiers, merges.

A third of a table may be copies of one record, so no step gathers a group: first
records come from combined aggregations, cluster sizes are joined back with hot
keys split, and merges fold rows field by field.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.hashing import content_hash, key_hash, short_id, url_key
from ..functions.text import lowered
from ..scale import HOT_ROWS, cut_lineage, spread_join
from ..table import as_text, col, data_columns, is_text
from .profile import record_hash

# Fields that identify a record at ingest, in order of preference.
INGEST_KEYS = ("company_name", "company", "title", "job_title", "name", "website", "url", "domain")
# Fields whose URL identifies a record, in order of use.
URL_FIELDS = ("job_url", "url", "website", "company_website", "canonical_url", "source_url")
# Field combinations that identify a record.
COMPOSITE_KEYS = (("company_name", "job_title"), ("company", "title"), ("name", "location"))
CONFIDENCE = {"exact_hash": 1.0, "canonical_url": 0.95, "composite_key": 0.90}
SHORTEST_PART = 3
# Chains of merges are followed over at most 2 to this power records.
MOST_HALVINGS = 48


def default_keys(fields: Sequence[str]) -> list[str]:
    """The first two identifying fields present, else the first two fields."""
    by_lower = {f.lower(): f for f in reversed(fields)}
    found = [by_lower[k] for k in INGEST_KEYS if k in by_lower][:2]
    return found or list(fields[:2])


def first_non_null(c: Column, order: Column) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), order))


def dedup_ingest(
    df: DataFrame,
    order: str,
    keys: Sequence[str] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key hash: the first record, its null fields filled from later
    copies in order, with the number of copies.

    One shuffle; every field is folded before rows move.
    """
    fields = list(fields) if fields is not None else data_columns(df, [order])
    keys = list(keys) if keys else default_keys(fields)
    seq = col(order)
    others = [c for c in df.columns if c not in fields and c not in (order, "key_hash", "copies")]
    source = df if "key_hash" in df.columns else df.withColumn("key_hash", key_hash(keys, fields))
    return source.groupBy("key_hash").agg(
        F.min(seq).alias(order),
        *[F.min_by(col(c), seq).alias(c) for c in others],
        *[first_non_null(col(f), seq).alias(f) for f in fields],
        F.count(F.lit(1)).alias("copies"),
    )


def dedup_counts(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row: records, unique keys, duplicates."""
    return (
        df.select(key_hash(keys, fields).alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
            F.count(F.lit(1)).alias("unique_records"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        )
    )


@dataclass(frozen=True)
class Tier:
    rule: str
    field: str
    key: Column


def tiers(
    df: DataFrame,
    key_fields: Sequence[Sequence[str] | str] | None = None,
    columns: Sequence[str] | None = None,
) -> list[Tier]:
    """The matching rules that apply to the columns of ``df``, strongest first."""
    names = list(columns) if columns is not None else data_columns(df)
    found = [Tier("exact_hash", "_record_hash", record_hash(df, names))]
    for f in URL_FIELDS:
        if f in names and is_text(df.schema[f].dataType):
            found.append(Tier("canonical_url", f, url_key(col(f))))
    for parts in key_fields or COMPOSITE_KEYS:
        parts = [parts] if isinstance(parts, str) else list(parts)
        if not all(p in names for p in parts):
            continue
        texts = [lowered(as_text(df, p)) for p in parts]
        usable = F.lit(True)
        for t in texts:
            usable = usable & (F.length(t) >= SHORTEST_PART)
        # Colons and backslashes of a part are escaped, so that no two lists of parts look alike.
        plain = [F.regexp_replace(t, r"([:\\])", r"\\$1") for t in texts]
        found.append(
            Tier("composite_key", "+".join(parts), F.when(usable, F.concat_ws("::", *plain)))
        )
    return found


def duplicate_members(
    df: DataFrame,
    record_id: str,
    key_fields: Sequence[Sequence[str] | str] | None = None,
    columns: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(group_id, rule_type, match_field, match_value, confidence, record_id).

    A record belongs to the first tier in which another unclustered record shares its
    key. ``match_value`` is the whole key, and (match_field, match_value) names the
    cluster; ``group_id`` is a short label of it. Identifiers and keys are computed and
    written once; nothing else is shuffled. A tier counts its keys, joins the sizes back
    with hot keys and null keys spread, and hands the unclustered rows on; the lineage is
    cut in between, so tiers are not computed twice.
    """
    names = list(columns) if columns is not None else data_columns(df, [record_id])
    rules = tiers(df, key_fields, names)
    left = cut_lineage(
        df.select(col(record_id).alias("record_id"), *[t.key.alias(f"k{i}") for i, t in enumerate(rules)])
    )
    parts: list[DataFrame] = []
    for i, rule in enumerate(rules):
        key = f"k{i}"
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        shared = counts.where(F.col("n") > 1)
        labelled = spread_join(left, shared.withColumnRenamed("n", "size"), key, "record_id", "left", hot_rows)
        if i + 1 < len(rules):
            labelled = cut_lineage(labelled)
        k = F.col(key)
        if rule.rule == "exact_hash":
            group = F.concat(F.lit("hash_"), F.left(k, F.lit(12)))
        elif rule.rule == "canonical_url":
            group = short_id("url_", k, 10)
        else:
            group = short_id("comp_", k, 10)
        parts.append(
            labelled.where(F.col("size").isNotNull()).select(
                group.alias("group_id"),
                F.lit(rule.rule).alias("rule_type"),
                F.lit(rule.field).alias("match_field"),
                k.alias("match_value"),
                F.lit(CONFIDENCE[rule.rule]).alias("confidence"),
                "record_id",
            )
        )
        left = labelled.where(F.col("size").isNull()).drop("size", key)
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    return members


def duplicate_groups(members: DataFrame) -> DataFrame:
    """One row per cluster with its size and first record; members stay a table of
    their own, since one cluster may hold a third of all records."""
    return members.groupBy(
        "group_id", "rule_type", "match_field", "match_value", "confidence"
    ).agg(F.count(F.lit(1)).alias("record_count"), F.min("record_id").alias("first_record_id"))


def first_as_retained(members: DataFrame) -> DataFrame:
    """Merge mapping (record_id, retained_id) that keeps the first record of a cluster."""
    key = F.struct("match_field", "match_value").alias("_g")
    groups = members.groupBy(key).agg(F.min("record_id").alias("retained_id"))
    joined = spread_join(members.select(key, "record_id"), groups, "_g", "record_id", "inner")
    return joined.where(F.col("record_id") != F.col("retained_id")).select("record_id", "retained_id")


def final_retained(mapping: DataFrame) -> DataFrame:
    """``mapping`` with each retained record replaced by the one it is merged into itself.

    Most mappings hold no chain and come back after one look. Chains are halved in each
    round, so one of n records takes log n joins; a circle raises.
    """
    current = mapping.select("record_id", "retained_id").where(F.col("record_id") != F.col("retained_id"))
    step = current.select(F.col("record_id").alias("retained_id"), F.col("retained_id").alias("_next"))
    if current.join(step, "retained_id", "left_semi").isEmpty():
        return current
    for _ in range(MOST_HALVINGS):
        joined = current.join(step, "retained_id", "left")
        current = cut_lineage(joined.select("record_id", F.coalesce("_next", "retained_id").alias("retained_id")))
        if not current.where(F.col("record_id") == F.col("retained_id")).isEmpty():
            break
        step = current.select(F.col("record_id").alias("retained_id"), F.col("retained_id").alias("_next"))
        if current.join(step, "retained_id", "left_semi").isEmpty():
            return current
    raise ValueError("the merge mapping runs in a circle")


def merge_groups(
    df: DataFrame,
    mapping: DataFrame,
    record_id: str,
    order: str,
    overrides: Mapping[Any, Mapping[str, Any]] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """The table after merging: each retained row takes over what it lacks.

    ``mapping`` holds (record_id, retained_id), one row per merged record; chains lead
    to their last record, circles raise. Nulls and
    empty strings of the retained row are filled from merged rows in order,
    overrides win, source counts add up (none counts as one). All groups merge in
    one job; rows outside the mapping pass unchanged.
    """
    fields = (
        list(fields) if fields is not None else data_columns(df, [record_id, order])
    )
    mapping = final_retained(mapping)
    merged = mapping.select(F.col("record_id").alias(record_id), F.col("retained_id").alias("_keep"))
    roles = (
        merged.withColumn("_rank", F.lit(1))
        .unionByName(
            mapping.select(
                F.col("retained_id").alias(record_id),
                F.col("retained_id").alias("_keep"),
                F.lit(0).alias("_rank"),
            )
        )
        .groupBy(record_id)
        .agg(F.min("_keep").alias("_keep"), F.min("_rank").alias("_rank"))
    )
    # Both sides are unique on the identifier, so no key is hot.
    tagged = df.join(roles, record_id, "left")
    place = F.struct(F.col("_rank"), col(order))
    text_fields = {f for f in fields if is_text(df.schema[f].dataType)}

    def filled(name: str) -> Column:
        c = col(name)
        if name not in text_fields:
            return F.min_by(c, F.when(c.isNotNull(), place))
        some = F.min_by(c, F.when(c.isNotNull() & (c != ""), place))
        return F.coalesce(some, F.max(F.when(c == "", c)))

    keepers = ["dataset_id", "validation_status", "validation_errors", "created_at", "updated_at", "key_hash"]
    aggs = [] if order == record_id else [F.min_by(col(order), place).alias(order)]
    aggs += [filled(f).alias(f) for f in fields]
    aggs += [F.min_by(col(c), place).alias(c) for c in keepers if c in df.columns and c not in fields]
    if "source_count" in df.columns:
        one_at_least = F.coalesce(F.nullif(col("source_count"), F.lit(0)), F.lit(1))
        dtype = df.schema["source_count"].dataType
        aggs.append(F.sum(one_at_least).cast(dtype).alias("source_count"))
    folded = tagged.where(F.col("_keep").isNotNull()).groupBy(F.col("_keep").alias(record_id)).agg(*aggs)
    if overrides:
        folded = _overridden(folded, df.schema, record_id, overrides)
    if "content_hash" in df.columns:
        folded = folded.withColumn("content_hash", content_hash(fields))
    rest = tagged.where(F.col("_keep").isNull()).drop("_keep", "_rank")
    return rest.select(df.columns).unionByName(folded.select(df.columns))


def _overridden(folded: DataFrame, schema: StructType, record_id: str, overrides: Mapping[Any, Mapping[str, Any]]) -> DataFrame:
    """Set the given cells by one join, whatever the number of merged groups."""
    names = sorted({name for values in overrides.values() for name in values})
    kinds = [StructField(f"_set{i}", StructType([StructField("value", schema[n].dataType)])) for i, n in enumerate(names)]
    rows = [(keep, *[(values[n],) if n in values else None for n in names]) for keep, values in overrides.items()]
    given = folded.sparkSession.createDataFrame(rows, StructType([StructField(record_id, schema[record_id].dataType), *kinds]))
    out = folded.join(given, record_id, "left")
    chosen = {n: F.when(F.col(f"_set{i}").isNotNull(), F.col(f"_set{i}.value")).otherwise(col(n)) for i, n in enumerate(names)}
    return out.select(*[chosen.get(c, col(c)).alias(c) for c in folded.columns])


def merge_history(df: DataFrame, mapping: DataFrame, record_id: str) -> DataFrame:
    """(retained_id, record_id, original): every row that takes part, as it was."""
    fields = data_columns(df, [record_id])
    mapping = final_retained(mapping)
    roles = mapping.select("record_id", "retained_id").unionByName(
        mapping.select(F.col("retained_id").alias("record_id"), "retained_id").distinct()
    )
    return (
        df.select(col(record_id).alias("record_id"), F.to_json(F.struct(*[col(f) for f in fields])).alias("original"))
        .join(roles, "record_id")
        .select("retained_id", "record_id", "original")
    )
