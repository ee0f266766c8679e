"""From candidate records to a table: validate, reject, deduplicate, link evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import key_hash
from ..functions.numbers import is_numeric, num_loose
from ..functions.text import collapse, comma_list, is_email, parse_boolean, strip
from ..functions.urls import checked_url, is_url
from ..plans.plan import match_column
from ..scale import HOT_ROWS, cut_lineage, spread_join
from ..table import as_text, col, is_text
from .dedup import dedup_ingest, default_keys
from .profile import NUMBER_TYPES, Field, one_row

ERROR_TYPE = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)
EVIDENCE_TYPE = "array<struct<field_name:string,evidence_excerpt:string>>"


def _problem(field: str, kind: str, message: Column, severity: str) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"),
        F.lit(kind).alias("error_type"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
    ).cast(ERROR_TYPE)


def _typed(df: DataFrame, name: str, field: Field) -> tuple[Column, Column | None]:
    """Normalised value of a present cell and the problem it has, if any."""
    dtype = df.schema[name].dataType
    text = collapse(col(name)) if is_text(dtype) else as_text(df, name)
    kind = field.type.lower()
    if kind in ("string", "text"):
        return text, None
    if kind in NUMBER_TYPES:
        if is_numeric(dtype):
            return col(name).cast("double"), None
        if isinstance(dtype, T.BooleanType):
            return col(name).cast("int").cast("double"), None
        number = num_loose(text)
        message = F.concat(F.lit("No number in '"), text, F.lit("'"))
        return number, F.when(number.isNull(), _problem(field.name, "invalid_number", message, "warning"))
    if kind == "url":
        if not is_text(dtype):
            message = F.lit(f"Expected URL text, got {dtype.simpleString()}")
            return text, _problem(field.name, "invalid_url", message, "error")
        message = F.concat(F.lit("Malformed URL '"), text, F.lit("'"))
        return (
            F.coalesce(checked_url(text), text),
            F.when(~is_url(text), _problem(field.name, "invalid_url", message, "warning")),
        )
    if kind == "email":
        good = is_email(text) if is_text(dtype) else F.lit(False)
        message = F.concat(F.lit("Invalid e-mail '"), text, F.lit("'"))
        return (
            F.when(good, F.lower(text)).otherwise(text),
            F.when(~good, _problem(field.name, "invalid_email", message, "warning")),
        )
    if kind == "boolean":
        if isinstance(dtype, T.BooleanType):
            return col(name), None
        return (col(name) != 0 if is_numeric(dtype) else parse_boolean(text)), None
    if kind == "array":
        if isinstance(dtype, T.ArrayType):
            return col(name), None
        return (comma_list(text) if is_text(dtype) else F.array(text)), None
    return (text if is_text(dtype) else col(name)), None


def _empty_type(field: Field) -> str:
    kind = field.type.lower()
    if kind in NUMBER_TYPES:
        return "double"
    return {"boolean": "boolean", "array": "array<string>"}.get(kind, "string")


def validate(
    df: DataFrame, fields: Sequence[Field], keep: Sequence[str] | None = None, keep_raw: bool = False
) -> DataFrame:
    """Normalised fields with ``validation_status`` and ``validation_errors``.

    Column names match in any case. ``keep`` names the other columns to pass on
    (default: all that are no declared field). One projection, no shuffle.
    """
    matched = {f.name: match_column(f.name, df.columns) for f in fields}
    used = {m for m in matched.values() if m}
    others = [c for c in df.columns if c not in used] if keep is None else list(keep)
    values: list[Column] = []
    problems: list[Column] = []
    for f in fields:
        name = matched[f.name]
        if name is None:
            values.append(F.lit(None).cast(_empty_type(f)).alias(f.name))
            if f.required:
                problems.append(_missing(f))
            continue
        text = as_text(df, name)
        absent = text.isNull()
        if is_text(df.schema[name].dataType):
            absent = absent | (strip(col(name)) == "")
        value, problem = _typed(df, name, f)
        values.append(F.when(~absent, value).alias(f.name))
        if f.required:
            problems.append(F.when(absent, _missing(f)))
        if problem is not None:
            problems.append(F.when(~absent, problem))
    errors = (
        F.filter(F.array(*problems), lambda e: e.isNotNull())
        if problems
        else F.array().cast(T.ArrayType(ERROR_TYPE))
    )
    raw = [F.struct(*[col(m) for m in used]).alias("record_data")] if keep_raw and used else []
    checked = df.select(*[col(c) for c in others], *raw, *values, errors.alias("validation_errors"))
    status = (
        F.when(F.exists("validation_errors", lambda e: e["severity"] == "error"), "invalid")
        .when(F.size("validation_errors") > 0, "valid_with_warnings")
        .otherwise("valid")
    )
    return checked.withColumn("validation_status", status)


def _missing(field: Field) -> Column:
    message = F.lit(f"Required field '{field.name}' is missing or empty")
    return _problem(field.name, "missing_required_field", message, "error")


def split_rejected(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records."""
    bad = F.col("validation_status") == "invalid"
    return validated.where(~bad), validated.where(bad)


def complete_evidence(
    df: DataFrame,
    fields: Sequence[str],
    evidence: str = "evidences",
    title: str = "page_title",
    domain: str = "domain",
) -> DataFrame:
    """Every non-null field gets an evidence entry; added ones name page and domain."""
    given = (
        F.coalesce(col(evidence), F.array().cast(EVIDENCE_TYPE))
        if evidence in df.columns
        else F.array().cast(EVIDENCE_TYPE)
    )

    def part(name: str) -> Column:
        return F.coalesce(col(name), F.lit("None")) if name in df.columns else F.lit("None")

    default = F.concat(F.lit("Extracted from "), part(title), F.lit(" on "), part(domain))
    present = F.filter(
        F.array(
            *[
                F.when(
                    col(f).isNotNull(),
                    F.struct(F.lit(f).alias("field_name"), default.alias("evidence_excerpt")),
                )
                for f in fields
                if f in df.columns
            ]
        ),
        lambda e: e.isNotNull(),
    )
    added = F.filter(
        present, lambda e: ~F.exists(given, lambda g: g["field_name"] == e["field_name"])
    )
    return df.withColumn(evidence, F.concat(given, added.cast(EVIDENCE_TYPE)))


@dataclass(frozen=True)
class Ingested:
    """Tables of one ingest: saved records, rejected candidates, evidence links."""

    records: DataFrame
    rejected: DataFrame
    links: DataFrame
    metrics: DataFrame


def ingest(
    raw: DataFrame,
    fields: Sequence[Field],
    order: str,
    limit: int | None = None,
    sources: DataFrame | None = None,
    keys: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> Ingested:
    """Validate, reject, deduplicate, cut to ``limit``, link evidence, count sources.

    ``raw`` holds the candidate fields, ``order``, ``source_url`` and optionally
    ``evidences``. ``sources`` holds (data_source_id, source_url), one row per URL.
    ``limit`` is the target count of the collection plan; None keeps all records.
    """
    names = [f.name for f in fields]
    keys = list(keys) if keys else default_keys(names)
    meta = [c for c in (order, "source_url", "page_title", "domain", "evidences") if c in raw.columns]
    with_evidence = complete_evidence(raw, names)
    meta = list(dict.fromkeys(meta + ["evidences"]))
    # Every later step reads the validated candidates, most of them a few columns.
    checked = cut_lineage(validate(with_evidence, fields, keep=meta).withColumn("key_hash", key_hash(keys, names)))
    accepted, rejected = split_rejected(checked)
    rejected = rejected.drop("key_hash")

    unique = cut_lineage(dedup_ingest(accepted.drop("evidences"), order, keys, names))
    kept = unique if limit is None else unique.orderBy(order).limit(limit)

    cited = accepted.where(F.size("evidences") > 0)
    urls = cited.groupBy("key_hash").agg(F.count_distinct("source_url").alias("_urls"))
    records = kept.join(urls, "key_hash", "left").withColumn(
        "source_count", F.greatest(F.lit(1), F.coalesce(F.col("_urls"), F.lit(0))).cast("int")
    ).drop("_urls")

    spread = accepted.select(
        "key_hash", F.col(order).alias("_from"), "source_url", F.explode("evidences").alias("e")
    ).select("key_hash", "_from", "source_url", "e.field_name", "e.evidence_excerpt")
    linked = spread_join(spread, kept.select("key_hash", order), "key_hash", "_from", "inner", hot_rows)
    links = linked.select(
        F.col(order).alias("record_id"),
        "key_hash",
        "source_url",
        F.col("field_name").alias("evidence_field"),
        "evidence_excerpt",
        "_from",
    )
    if sources is not None:
        links = spread_join(links, sources, "source_url", "_from", "inner", hot_rows, spread.select("source_url"))
    links = links.withColumnRenamed("_from", "candidate_id")
    return Ingested(records, rejected, links, ingest_metrics(checked, unique, limit))


def ingest_metrics(checked: DataFrame, unique: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: extracted, rejected, duplicates, unique, saved and the job's status."""
    status = checked.agg(
        F.count(F.lit(1)).alias("records_extracted"),
        F.count(F.when(F.col("validation_status") == "invalid", 1)).alias("records_rejected"),
    )
    folded = unique.agg(
        F.count(F.lit(1)).alias("unique_records"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_merged"),
    )
    return one_row([status, folded]).select(
        "*",
        (F.col("unique_records") if limit is None else F.least(F.col("unique_records"), F.lit(limit))).alias("records_saved"),
        F.when(F.col("records_rejected") > 0, "completed_with_errors")
        .otherwise("completed")
        .alias("status"),
    )
