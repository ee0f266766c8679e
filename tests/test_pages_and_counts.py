"""Deep pages from the index, and counts observed on writes."""

import random

import pytest
from pyspark.sql import functions as F

from tablewise.operators.changes import clean_version, transform_version
from tablewise.operators.clean import preview as preview_clean
from tablewise.operators.compare import compare_values
from tablewise.operators.tables import page, page_index
from tablewise.operators.transform import preview as preview_transform
from tablewise.sources.versions import VersionStore


@pytest.fixture(scope="module")
def listed(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([None, 1.5, 2.0, draw.random()]), "x" * (i % 5)) for i in range(1003)]
    return spark.createDataFrame(rows, "id long, price double, _text string").repartition(7)


def order():
    return [F.col("price").desc_nulls_last(), F.col("id").asc()]


@pytest.mark.parametrize("size", [1, 40, 400, 2000])
def test_every_page_of_the_index_equals_sorting(spark, listed, size):
    want = [tuple(r) for r in listed.orderBy(*order()).collect()]
    index = page_index(listed, order())
    assert index.total == 1003
    for number in sorted({1, 2, 3, 1003 // size, 1003 // size + 1, 1003 // size + 2}):
        got = [tuple(r) for r in index.page(number, size).collect()] if number else []
        assert number == 0 or got == want[(number - 1) * size : number * size]


def test_deep_pages_skip_without_sorting_what_they_skip(listed):
    deep = page(listed, order(), 9, 40, shallow=100)
    near = page(listed, order(), 9, 40)
    assert [tuple(r) for r in deep.rows.collect()] == [tuple(r) for r in near.rows.collect()]
    assert deep.total.first() == near.total.first()
    plan = deep.rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "PartitionFilters: [" in plan


def test_pages_of_no_rows(listed):
    empty = listed.limit(0)
    assert page_index(empty, order()).page(1).count() == 0
    assert page(empty, order(), 5, 40, shallow=1).total.first()["pages"] == 1


CHANGES = [
    ("trim_whitespace", {}, True),
    ("fill_missing_constant", {"field_name": "b", "fill_value": "z"}, True),
    ("remove_duplicates", {}, True),
    ("drop_missing_required", {"required_fields": ["b"]}, True),
    ("rename_column", {"old_name": "a", "new_name": "c"}, False),
    ("rename_column", {"old_name": "none", "new_name": "c"}, False),
    ("derive_column", {"target_column": "d", "expression_type": "combine_text", "source_columns": ["a", "b"]}, False),
    ("filter_records", {"filter_field": "a", "operator": "==", "value": "x"}, False),
]


@pytest.mark.parametrize("operation,config,cleaning", CHANGES)
@pytest.mark.parametrize("hashed", [False, True])
def test_observed_counts_equal_previews(spark, tmp_path, operation, config, cleaning, hashed):
    rows = [(1, " x", "1"), (2, "x", None), (3, "x", "2"), (4, "x", "2"), (5, None, "")]
    df = spark.createDataFrame(rows, "record_seq long, a string, b string").repartition(3)
    if hashed:
        df = df.withColumn("content_hash", F.md5(F.concat_ws("|", "a", "b")))
    show = preview_clean if cleaning else preview_transform
    want = show(df, operation, config, "record_seq").summary.first()["records_affected"]
    store = VersionStore(spark, str(tmp_path))
    store.snapshot(df, "import")
    change = (clean_version if cleaning else transform_version)(store, operation, config)
    assert store.history().first()["records_affected"] == want
    entry = store.log().where(f"version = {change.version}").first()
    assert entry["row_count"] == change.table.count()
    assert entry["summary"] == f"{operation}: {want} records"
    assert "_altered" not in change.table.columns and "_altered" not in entry["schema"]


def test_a_snapshot_starts_no_counting_job(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    df = spark.range(100).repartition(4)
    context = spark.sparkContext
    context.setJobGroup("snapshot", "snapshot")
    try:
        number = store.snapshot(df, "import")
        started = len(context.statusTracker().getJobIdsForGroup("snapshot"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert store.log().where(f"version = {number}").first()["row_count"] == 100
    # The rows and their exchange, the log entry, and the look at the newest number.
    assert started <= 5
    assert store.snapshot(df.limit(0), "empty") == number + 1
    assert store.log().where(f"version = {number + 1}").first()["row_count"] == 0


def test_compared_values_of_long_texts(spark):
    long = "long text " * 60
    a = spark.createDataFrame([(1, long + "a"), (2, long + "a"), (3, " short "), (4, "")], "record_seq long, t string")
    b = spark.createDataFrame([(1, None), (2, long + "b")], "record_seq long, t string")
    got = {(r["side"], r["place"]): (r["value"], r["count"], r["non_null"]) for r in compare_values(a, b, ["t"]).collect()}
    assert got == {("a", 1): (long + "a", 2, 3), ("a", 2): ("short", 1, 3), ("b", 1): (long + "b", 1, 1)}
    assert compare_values(a, b, []).count() == 0
