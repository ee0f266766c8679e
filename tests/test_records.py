import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewise.operators import compare, dedup, tables
from tablewise.operators.changes import clean_version, merge_version, restore_version, transform_version
from tablewise.operators.clean import apply_clean, clean, preview
from tablewise.operators.ingest import complete_evidence, ingest, validate
from tablewise.operators.profile import Field
from tablewise.operators.transform import apply_transform, map_by_table, preview as preview_transform, transform
from tablewise.sources import (
    VersionStore,
    build_sources,
    discover,
    envelope_fields,
    export_csv,
    export_json,
    export_latest,
    scan_records,
    tabulate,
)


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        (1, "Acme ", "Engineer", "https://acme.org/jobs/1", None, 1),
        (2, "acme", "engineer", None, "9", 0),
        (3, "Birch", "Cook", "https://birch.org/1/", "", None),
        (4, "Birch Ltd", "Chef", "HTTPS://BIRCH.ORG/1", "7", 2),
        (5, "Cedar", "", "short", "1", 1),
        (6, "Cedar", "", "short", "1", 1),
    ]
    return spark.createDataFrame(rows, "record_seq long, company_name string, job_title string, url string, pay string, source_count int")


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- cleaning ---------------------------------------------------------------------


def test_unknown_operations_are_refused(jobs):
    with pytest.raises(ValueError):
        clean(jobs, "eval")
    with pytest.raises(ValueError):
        transform(jobs, "run_sql", {})
    with pytest.raises(ValueError):
        transform(jobs, "derive_column", {"target_column": "x", "expression_type": "python"})
    with pytest.raises(ValueError):
        transform(jobs, "rename_column", {"old_name": "a"})


def test_clean_targets(jobs):
    upper = clean(jobs, "normalize_case", {"case_type": "upper", "fields": ["job_title"]})
    assert [r["job_title"] for r in upper.orderBy("record_seq").collect()][:2] == ["ENGINEER", "ENGINEER"]
    assert upper.where("company_name = 'acme'").count() == 1
    urls = clean(jobs, "normalize_urls")
    assert [r["url"] for r in urls.orderBy("record_seq").collect()][2:4] == ["https://birch.org/1", "https://birch.org/1"]
    assert clean(jobs, "standardize_dates").schema == jobs.schema


def test_fill_touches_nulls_only(jobs):
    out = clean(jobs, "fill_missing_constant", {"field_name": "pay", "constant_value": "0"})
    assert [r["pay"] for r in out.orderBy("record_seq").collect()] == ["0", "9", "", "7", "1", "1"]


def test_convert_counts_failures(jobs):
    out = preview(jobs, "convert_types", {"field_name": "pay", "target_type": "int"}).summary.first()
    assert (out["failed_conversions"], out["potential_info_loss"]) == (1, True)
    typed = clean(jobs, "convert_types", {"field_name": "pay", "target_type": "int"})
    assert dict(typed.dtypes)["pay"] == "bigint"


def test_preview_and_apply_of_row_operations(jobs):
    names = ["company_name", "job_title", "url", "pay"]
    out = preview(jobs.select("record_seq", *names), "remove_duplicates")
    summary = out.summary.first()
    assert (summary["records_affected"], summary["fields_affected"], summary["potential_info_loss"]) == (1, ["_record"], True)
    sample = out.samples.first()
    assert (sample["record_seq"], sample["action"]) == (6, "delete_duplicate")
    applied = apply_clean(jobs, "drop_missing_required", {"field_name": "job_title"})
    assert sorted(rows(applied.dropped)) == [(5,), (6,)]
    assert (applied.table.count(), applied.affected.first()[0]) == (4, 2)


def test_preview_samples_show_changed_cells(jobs):
    out = preview(jobs, "trim_whitespace")
    assert out.summary.first()["fields_affected"] == ["company_name"]
    (sample,) = out.samples.collect()
    assert (sample["original"], sample["cleaned"]) == ({"company_name": "Acme "}, {"company_name": "Acme"})


# -- transformations -----------------------------------------------------------------


def test_derive_and_preview(jobs):
    config = {"target_column": "full", "expression_type": "combine_text", "source_columns": ["job_title", "pay"], "delimiter": "-"}
    out = {r["record_seq"]: r["full"] for r in transform(jobs, "derive_column", config).collect()}
    assert out == {1: "Engineer", 2: "engineer-9", 3: "Cook", 4: "Chef-7", 5: "1", 6: "1"}
    assert preview_transform(jobs, "derive_column", config).summary.first()["records_affected"] == 6
    applied = apply_transform(jobs, "rename_column", {"old_name": "pay", "new_name": "salary"})
    assert applied.schema_updates == {"renamed_field": {"from": "pay", "to": "salary"}}
    dropped = apply_transform(jobs, "filter_records", {"filter_field": "pay", "operator": ">", "value": 5, "action": "drop"})
    assert sorted(rows(dropped.dropped)) == [(2,), (4,)]
    split = {"target_column": "p", "expression_type": "split_text", "source_column": "url", "delimiter": ".", "part_index": 1}
    parts = {r["record_seq"]: r["p"] for r in transform(jobs, "derive_column", split).collect()}
    assert (parts[1], parts[5]) == ("org/jobs/1", None)


def test_map_by_table(spark, jobs):
    mapping = spark.createDataFrame([("Cook", "kitchen"), ("CHEF", "kitchen")], "key string, value string")
    out = {r["record_seq"]: r["area"] for r in map_by_table(jobs, "job_title", mapping, "area", "record_seq").collect()}
    assert out == {1: "Engineer", 2: "engineer", 3: "kitchen", 4: "kitchen", 5: "", 6: ""}


# -- duplicates ----------------------------------------------------------------------


def brute_force_groups(records):
    """Clusters by nested loops over a few records, as the rules read."""
    seen, found = set(), {}

    def cluster(rule, key_of):
        groups = defaultdict(list)
        for r in records:
            key = key_of(r)
            if r["record_seq"] not in seen and key is not None:
                groups[key].append(r["record_seq"])
        for ids in groups.values():
            if len(ids) > 1:
                seen.update(ids)
                for i in ids:
                    found[i] = (rule, min(ids))

    fields = ["company_name", "job_title", "url", "pay"]
    cluster("exact_hash", lambda r: tuple(r[f] for f in fields))
    cluster("canonical_url", lambda r: r["url"].strip().lower().rstrip("/") if r["url"] and len(r["url"].strip()) > 8 else None)

    def composite(r):
        parts = [(r[f] or "").strip().lower() for f in ("company_name", "job_title")]
        return tuple(parts) if all(len(p) > 2 for p in parts) else None

    cluster("composite_key", composite)
    return found


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_duplicates_equal_brute_force(jobs, hot_rows):
    members = dedup.duplicate_members(jobs, "record_seq", hot_rows=hot_rows)
    first = {r["group_id"]: r["first_record_id"] for r in dedup.duplicate_groups(members).collect()}
    got = {r["record_id"]: (r["rule_type"], first[r["group_id"]]) for r in members.collect()}
    assert got == brute_force_groups(jobs.collect())
    assert set(v[0] for v in got.values()) == {"exact_hash", "canonical_url", "composite_key"}


def test_merge(spark, jobs):
    mapping = spark.createDataFrame([(2, 1), (4, 3)], "record_id long, retained_id long")
    out = {r["record_seq"]: r for r in dedup.merge_groups(jobs, mapping, "record_seq", "record_seq", {3: {"job_title": "Chef de cuisine"}}).collect()}
    assert sorted(out) == [1, 3, 5, 6]
    assert (out[1]["company_name"], out[1]["pay"], out[1]["source_count"]) == ("Acme ", "9", 2)
    assert (out[3]["pay"], out[3]["job_title"], out[3]["source_count"]) == ("7", "Chef de cuisine", 3)
    history = dedup.merge_history(jobs, mapping, "record_seq").collect()
    assert json.loads(next(r["original"] for r in history if r["record_id"] == 3))["job_title"] == "Cook"


def test_merge_follows_chains_and_refuses_circles(spark, jobs):
    mapping = spark.createDataFrame([(2, 1), (3, 2), (5, 3)], "record_id long, retained_id long")
    assert sorted(rows(dedup.final_retained(mapping))) == [(2, 1), (3, 1), (5, 1)]
    merged = dedup.merge_groups(jobs, mapping, "record_seq", "record_seq")
    assert sorted(r["record_seq"] for r in merged.collect()) == [1, 4, 6]
    assert {r["retained_id"] for r in dedup.merge_history(jobs, mapping, "record_seq").collect()} == {1}
    for circle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError):
            dedup.final_retained(spark.createDataFrame(circle, "record_id long, retained_id long")).collect()


def test_clusters_with_one_short_id_stay_apart(spark, jobs, monkeypatch):
    monkeypatch.setattr(dedup, "short_id", lambda prefix, c, length: F.lit(prefix))
    members = dedup.duplicate_members(jobs, "record_seq")
    want = brute_force_groups(jobs.collect())
    assert dedup.duplicate_groups(members).count() == len(set(want.values()))
    mapping = {r["record_id"]: r["retained_id"] for r in dedup.first_as_retained(members).collect()}
    assert mapping == {i: first for i, (_, first) in want.items() if i != first}


def test_ingest_dedup_fills_gaps(spark):
    df = spark.createDataFrame(
        [(1, "Acme", "Eng", None), (2, "ACME ", "eng", "w"), (3, "acme", "ENG", "v"), (4, None, None, "x"), (5, None, None, "x")],
        "record_seq long, company_name string, job_title string, website string",
    )
    out = {r["record_seq"]: (r["company_name"], r["website"], r["copies"]) for r in dedup.dedup_ingest(df, "record_seq").collect()}
    assert out == {1: ("Acme", "w", 3), 4: (None, "x", 2)}
    assert dedup.default_keys(["x", "Title", "company", "url"]) == ["company", "Title"]
    assert dedup.default_keys(["x", "y", "z"]) == ["x", "y"]


# -- validation and ingest ---------------------------------------------------------------

FIELDS = [
    Field("company_name", "string", True),
    Field("job_title", "string", True),
    Field("website", "url"),
    Field("pay", "number"),
]


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [
        (1, "Acme", "Engineer", "acme.org/?utm_source=a", "$1,000", "https://s.org/1"),
        (2, " ACME", "engineer", None, None, "https://s.org/2"),
        (3, " ", "Cook", None, "1", "https://s.org/1"),
        (4, "Birch", "Cook", "https://birch.org", "a lot", "https://s.org/3"),
    ]
    return spark.createDataFrame(rows, "record_seq long, company_name string, job_title string, website string, pay string, source_url string")


def test_validate(candidates):
    got = {r["record_seq"]: r for r in validate(candidates, FIELDS).collect()}
    assert {k: r["validation_status"] for k, r in got.items()} == {1: "valid", 2: "valid", 3: "invalid", 4: "valid_with_warnings"}
    assert (got[1]["website"], got[1]["pay"]) == ("https://acme.org/", 1000.0)
    (error,) = got[3]["validation_errors"]
    assert (error["field_name"], error["error_type"], error["severity"]) == ("company_name", "missing_required_field", "error")
    (warning,) = got[4]["validation_errors"]
    assert (warning["error_type"], warning["severity"]) == ("invalid_number", "warning")


def test_validate_absent_and_typed_columns(spark):
    df = spark.createDataFrame([(1, 5, True)], "record_seq long, Site int, flag boolean")
    row = validate(df, [Field("site", "url"), Field("flag", "boolean"), Field("gone", "array", True)]).first()
    assert row["validation_status"] == "invalid"
    assert sorted(e["error_type"] for e in row["validation_errors"]) == ["invalid_url", "missing_required_field"]
    assert (row["flag"], row["gone"]) == (True, None)


def test_ingest(spark, candidates):
    sources = spark.createDataFrame([("s1", "https://s.org/1"), ("s2", "https://s.org/2")], "data_source_id string, source_url string")
    raw = candidates.withColumn("page_title", F.lit("Jobs")).withColumn("domain", F.lit("s.org"))
    out = ingest(raw, FIELDS, "record_seq", 10, sources)
    got = {r["record_seq"]: r for r in out.records.collect()}
    assert sorted(got) == [1, 4]
    assert (got[1]["copies"], got[1]["source_count"]) == (2, 2)
    assert [r["record_seq"] for r in out.rejected.collect()] == [3]
    links = {(r["record_id"], r["evidence_field"], r["data_source_id"]) for r in out.links.collect()}
    assert (1, "company_name", "s1") in links and (1, "job_title", "s2") in links
    assert not any(record == 4 for record, _, _ in links)
    assert {r["evidence_excerpt"] for r in out.links.collect()} == {"Extracted from Jobs on s.org"}
    metrics = out.metrics.first()
    assert (metrics["records_extracted"], metrics["records_rejected"], metrics["duplicates_merged"], metrics["records_saved"], metrics["status"]) == (
        4, 1, 1, 2, "completed_with_errors",
    )
    assert ingest(raw, FIELDS, "record_seq", 1).records.count() == 1


def test_given_evidence_is_kept(candidates):
    given = F.array(F.struct(F.lit("pay").alias("field_name"), F.lit("paid well").alias("evidence_excerpt")))
    row = complete_evidence(candidates.withColumn("evidences", given), ["pay", "website"]).where("record_seq = 1").first()
    assert [(e["field_name"], e["evidence_excerpt"]) for e in row["evidences"]] == [
        ("pay", "paid well"), ("website", "Extracted from None on None"),
    ]


# -- tables --------------------------------------------------------------------------------


def test_owner_scope(spark):
    records = spark.createDataFrame([(1, "d1"), (2, "d2")], "record_id long, dataset_id string")
    datasets = spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "dataset_id string, user_id string")
    assert rows(tables.scoped(records, datasets, "u1").select("record_id")) == [(1,)]
    assert tables.scoped(records, datasets, "u3").count() == 0


def test_update_and_delete(spark, jobs):
    hashed = jobs.withColumn("content_hash", F.lit("old"))
    ids = spark.createDataFrame([(1,), (99,)], "i long")
    out = {r["record_seq"]: r for r in tables.update_records(hashed, ids, {"pay": 12, "note": "n"}, "record_seq").collect()}
    assert (out[1]["pay"], out[1]["note"], out[2]["note"], out[2]["content_hash"]) == ("12", "n", None, "old")
    assert out[1]["content_hash"] != "old"
    assert tables.delete_records(jobs, ids, "record_seq").count() == 5
    keyed = jobs.withColumn("dataset_id", F.lit("d1"))
    assert tables.delete_records(keyed, ids, "record_seq", "other").count() == 6


def test_overview_of_datasets(spark):
    records = spark.createDataFrame([("d1", "valid"), ("d1", "invalid")], "dataset_id string, validation_status string")
    sources = spark.createDataFrame([("d1",)] * 5 + [("d2",)], "dataset_id string")
    got = {r["dataset_id"]: r for r in tables.dataset_overview(records, sources).collect()}
    assert (got["d1"]["valid_records"], got["d1"]["rejected_records"], got["d1"]["duplicate_count"]) == (1, 1, 3)
    assert (got["d2"]["total_records"], got["d2"]["source_count"]) == (0, 1)


def test_comparison(spark):
    a = spark.createDataFrame([("X ", 1, 0), ("y", 2, 5)], "name string, n int, only_a int")
    b = spark.createDataFrame([("x", 1), ("z", 2), ("z", 3)], "name string, n int")
    diff = compare.schema_diff(a, b)
    assert rows(compare.schema_similarity(diff)) == [(2, 1, 0, 80.0)]
    overlap = compare.record_overlap(a, b, "name").first()
    assert (overlap["common_records"], overlap["a_only_records"], overlap["b_only_records"], overlap["record_count_delta"]) == (1, 1, 1, 1)
    values = {(r["side"], r["column"], r["value"]): (r["count"], r["non_null"]) for r in compare.compare_values(a, b).collect()}
    assert values[("b", "name", "z")] == (2, 3)
    assert values[("a", "n", "1")] == (1, 2)


def test_envelopes(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 1, "b": "x", "c": [1]}', None), (2, None, '{"a": 2.5}'), (3, None, None)],
        "record_id long, record_data string, normalized_data string",
    )
    out = tabulate(df).orderBy("record_id")
    assert dict(out.dtypes)["a"] == "double"
    assert [(r["a"], r["b"]) for r in out.select("a", "b").collect()] == [(1.0, "x"), (2.5, None), (None, None)]
    assert set(envelope_fields(df)) == {"a", "b", "c"}


# -- sources and sinks -------------------------------------------------------------------------


def test_sources_and_discovery(spark):
    pages = spark.createDataFrame(
        [(1, "https://Example.org/a", "<title>T</title>x"), (2, "http://10.0.0.1/", "secret"), (3, "https://e.org/", "")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in build_sources(pages).collect()}
    assert (got[1]["domain"], got[1]["page_title"], got[1]["retrieval_status"]) == ("example.org", "T", "retrieved")
    assert (got[2]["retrieval_status"], got[2]["content_hash"], got[2]["page_title"]) == ("blocked", None, "Blocked URL")
    assert got[3]["content_hash"] is None and got[3]["error_message"] is None
    hits = spark.createDataFrame(
        [(1, 1, "u1"), (1, 2, "u2"), (2, 1, "u2"), (2, 2, "u3"), (16, 1, "late")], "query_pos int, hit_pos int, url string"
    )
    assert [(r["url"], r["query_pos"]) for r in discover(hits, max_queries=15).collect()] == [("u1", 1), ("u2", 1), ("u3", 2)]
    assert discover(hits).count() == 4
    assert discover(hits, max_sources=2).count() == 2


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "hi", ok', 3), (None, "", -4)], "b string, a string, source_count int")
    path = str(tmp_path / "csv")
    export_csv(df, path)
    text = "\n".join(open(os.path.join(path, f), encoding="utf8").read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert '"say ""hi"", ok",\'=1+1,3' in text
    assert text.splitlines()[0] == "a,b,source_count"
    back = spark.read.csv(path, header=True, escape='"')
    assert back.count() == 2


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "valid", "h")], "a int, b string, validation_status string, content_hash string")
    path = str(tmp_path / "json")
    export_json(df, path, status="valid")
    (line,) = [x for f in os.listdir(path) if f.endswith(".json") for x in open(os.path.join(path, f))]
    assert json.loads(line) == {"a": 1, "b": None, "_provenance": {"source_count": 1, "validation_status": "valid", "record_hash": "h"}}


def test_latest_export_and_scan(spark, tmp_path):
    df = spark.range(10).select(
        F.col("id").alias("record_id"), (F.col("id") % 2).alias("dataset_id"), F.timestamp_seconds("id").alias("created_at"),
        F.lit("valid").alias("validation_status"), F.col("id").alias("n"),
    )
    export_latest(df, str(tmp_path / "latest"), "json", 3)
    assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "latest")).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        export_latest(df, str(tmp_path / "x"), "xlsx")
    df.write.partitionBy("dataset_id").parquet(str(tmp_path / "shared"))
    scanned = scan_records(spark, str(tmp_path / "shared"), 1, "valid")
    assert scanned.count() == 5
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "EqualTo(validation_status,valid)" in plan


def test_versions(spark, jobs, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.latest() == 0 and store.list_versions().count() == 0
    with pytest.raises(ValueError):
        store.read()
    store.snapshot(jobs, "collect", "first")
    change = clean_version(store, "drop_missing_required", {"field_name": "job_title"})
    assert (change.version, change.table.count()) == (2, 4)
    moved = transform_version(store, "derive_column", {"target_column": "d", "expression_type": "extract_domain", "source_column": "url"})
    assert {r["d"] for r in moved.table.collect()} == {"acme.org", None, "birch.org"}
    restored = restore_version(store, 1)
    assert restored.table.count() == 6
    assert {r["dimension"]: r["score"] for r in restored.quality.collect()}["uniqueness"] == 83.3
    log = [(r["version"], r["change_type"], r["row_count"]) for r in store.list_versions().collect()]
    assert log == [(4, "restore", 6), (3, "derive_column", 4), (2, "drop_missing_required", 4), (1, "collect", 6)]
    history = tables.transformation_history(store.history()).collect()
    assert [(r["operation"], r["records_affected"]) for r in history] == [("derive_column", 3), ("drop_missing_required", 2)]
    assert sorted(rows(store.read(1))) == sorted(rows(jobs))


def test_two_writers_get_two_numbers(spark, jobs, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert (store._claim(), store._claim()) == (1, 2)
    assert store.snapshot(jobs, "collect") == 3
    assert store.latest() == 3


def test_merge_version(spark, jobs, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    store.snapshot(jobs.withColumn("record_id", F.col("record_seq")), "collect")
    links = spark.createDataFrame([(2, "s1"), (5, "s2")], "dataset_record_id long, data_source_id string")
    mapping = dedup.first_as_retained(dedup.duplicate_members(jobs, "record_seq"))
    out = merge_version(store, mapping, links)
    assert sorted(r["record_id"] for r in out.table.collect()) == [1, 3, 5]
    assert sorted(rows(out.links)) == [(1, "s1"), (5, "s2")]
    assert out.history.count() == 6
    assert {r["dimension"] for r in store.attached("quality", out.version).collect()} >= {"overall", "uniqueness"}
    assert out.profile.where("column_name = 'url'").count() == 1


def test_stream_equals_batch(spark, candidates, tmp_path):
    from tablewise.streaming import stream_ingest

    landed = str(tmp_path / "in")
    timed = candidates.withColumn("arrived", F.timestamp_seconds("record_seq"))
    timed.coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema(timed.schema).parquet(landed)
    run = stream_ingest(stream, FIELDS, "arrived", str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ingest(candidates, FIELDS, "record_seq", 100).records
    assert {r["key_hash"] for r in got.collect()} == {r["key_hash"] for r in want.collect()}
    assert got.count() == want.count() == 2
