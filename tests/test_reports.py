import pytest
from pyspark.sql import functions as F

from tablewise.operators.insights import insights, report_bundle
from tablewise.operators.profile import (
    Field,
    chart_points,
    field_distributions,
    profile_columns,
    profile_overview,
    quality_scores,
)
from tablewise.operators.tables import column_kinds


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        (1, "a", "10", "https://x.org/1", 1.0, [1, 2]),
        (2, "a", "20", "x.org", None, None),
        (3, "b", " ", "http://x.org/3", 3.0, [1, 2]),
        (4, "null", "1,000", None, 4.0, []),
    ]
    return spark.createDataFrame(rows, "record_seq long, kind string, price string, page_url string, size double, tags array<int>")


def by_name(df, key):
    return {r[key]: r for r in df.collect()}


def test_profile(shop):
    fields = [Field("price", "number"), Field("absent", label="Not there")]
    got = by_name(profile_columns(shop, "record_seq", fields), "column_name")
    assert list(got) == ["price", "absent", "kind", "page_url", "size", "tags"]
    price = got["price"]
    assert (price["inferred_type"], price["non_null_count"], price["null_count"], price["missing_percentage"]) == ("number", 3, 1, 25.0)
    assert (price["min_value"], price["max_value"], price["mean"], price["median"]) == (10.0, 1000.0, 343.33, 20.0)
    assert price["min_len"] is None
    absent = got["absent"]
    assert (absent["display_label"], absent["null_count"], absent["missing_percentage"], absent["valid_format_percentage"]) == ("Not there", 4, 100.0, 0.0)
    kind = got["kind"]
    assert (kind["display_label"], kind["unique_count"], kind["duplicate_count"], kind["min_len"]) == ("Kind", 2, 1, 1)
    assert [tuple(t) for t in kind["top_values"]] == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert kind["sample_values"] == ["a", "b"]
    url = got["page_url"]
    assert (url["inferred_type"], url["valid_format_percentage"]) == ("url", 66.7)
    assert got["size"]["inferred_type"] == "number"
    assert got["tags"]["sample_values"] == ["[1,2]", "[]"]


def test_profile_of_long_texts(spark):
    long = "x" * 1000
    df = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, "7" + long)], "record_seq long, t string")
    row = profile_columns(df, "record_seq").first()
    assert (row["unique_count"], row["max_len"]) == (3, 1001)
    assert row["top_values"][0]["value"] == long
    assert row["sample_values"] == [long, "short", "7" + long]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "record_seq long, a string")
    row = profile_columns(df, "record_seq", [Field("a")]).first()
    assert (row["non_null_count"], row["missing_percentage"]) == (0, 0.0)
    scores = by_name(quality_scores(df), "dimension")
    assert {d: r["score"] for d, r in scores.items()} == {d: 0.0 for d in scores}


def test_whole_numbers_beyond_double_stay_apart(spark):
    df = spark.createDataFrame([(1, 2**60), (2, 2**60 + 1)], "record_seq long, big long")
    assert profile_columns(df, "record_seq").first()["unique_count"] == 2


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, "a", "http://a", "valid", 2), (2, " a", "a.org", "valid_with_warnings", 0), (3, None, None, "invalid", None), (4, "a", "http://a", None, 1)],
        "record_seq long, name string, url string, validation_status string, source_count int",
    )
    fields = [Field("name", required=True), Field("url", "url")]
    got = by_name(quality_scores(df, fields), "dimension")
    assert {d: r["score"] for d, r in got.items()} == {
        "completeness": 75.0, "validity": 62.5, "uniqueness": 75.0, "consistency": 75.0, "provenance": 50.0, "overall": 68.1,
    }
    assert {d: r["affected_count"] for d, r in got.items()} == {
        "completeness": 1, "validity": 2, "uniqueness": 1, "consistency": 2, "provenance": 2, "overall": 0,
    }
    assert by_name(quality_scores(df, fields, links=3), "dimension")["provenance"]["score"] == 75.0
    bare = df.drop("source_count")
    assert by_name(quality_scores(bare, fields, sources=1), "dimension")["provenance"]["score"] == 100.0
    overview = profile_overview(df).first()
    assert (overview["duplicate_records"], overview["unique_records"], overview["valid_records"]) == (1, 3, 1)


def test_distributions(spark):
    df = spark.createDataFrame(
        [(i, float(i * 100), "c", None, "k" + str(i % 2)) for i in range(10)],
        "record_seq long, v double, same string, nothing string, kind string",
    )
    got = {}
    for r in field_distributions(df, "record_seq").collect():
        got.setdefault(r["column"], []).append(r)
    assert [r["count"] for r in sorted(got["v"], key=lambda r: r["position"])] == [2, 1, 1, 1, 1, 1, 1, 2]
    assert sorted(got["v"], key=lambda r: r["position"])[0]["label"] == "0 - 112"
    assert got["nothing"][0]["type"] == "empty"
    assert {(r["label"], r["count"]) for r in got["kind"]} == {("0.0 - 1.0", 0)} or got["kind"][0]["type"] == "numeric"
    assert got["same"][0]["type"] == "categorical"


def test_all_categories_where_no_number_is_named(spark):
    df = spark.createDataFrame([(i, chr(97 + i * i % 37 // 6) + chr(97 + i * i % 37 % 6)) for i in range(200)], "record_seq long, t string")
    ten = field_distributions(df, "record_seq").collect()
    every = field_distributions(df, "record_seq", top=None).collect()
    assert len(ten) == 10 and len(every) == 19
    assert {(r["label"], r["count"], r["position"]) for r in ten} < {(r["label"], r["count"], r["position"]) for r in every}
    assert sum(r["count"] for r in every) == 200


def test_constant_numbers_make_one_bin(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "record_seq long, v double")
    rows = field_distributions(df, "record_seq").collect()
    assert [(r["label"], r["count"], r["bin_min"], r["bin_max"]) for r in rows] == [("5", 2, 5.0, 5.0)]


def test_charts(shop):
    def points(*args):
        return [tuple(r) for r in chart_points(shop, *args).collect()]

    assert points("kind") == [("a", 2), ("b", 1), ("null", 1)]
    assert points("kind", "price", "sum") == [("null", 1000.0), ("a", 30.0), ("b", 0.0)]
    assert points("kind", "price", "avg") == [("null", 1000.0), ("a", 15.0)]
    assert points("kind", "absent", "max") == [("a", 2), ("b", 1), ("null", 1)]
    assert points("kind", None, "distinct_count") == [("kind", 3)]
    assert points("absent") == []


def test_column_kinds(shop):
    got = {r["column"]: r["kind"] for r in column_kinds(shop).collect()}
    assert got["price"] == "string" or got["price"] == "number"
    assert (got["kind"], got["size"], got["tags"]) == ("string", "number", "string")


def test_insights(frame):
    got = insights(frame, "record_seq").collect()
    kinds = [r["category"] for r in got]
    assert kinds[0] == "overview" and kinds.count("extremes") == 4
    extremes = next(r for r in got if r["category"] == "extremes" and r["evidence"]["column"] == "employees")
    assert extremes["evidence"]["top_entity"] == "Alder"
    category = next(r for r in got if r["category"] == "categorical")["evidence"]
    assert (category["column"], category["top_category"], category["top_count"], category["top_percentage"]) == ("headquarters", "San Francisco", "3", "37.5")
    assert category["top_values"].startswith("San Francisco=3, Bangalore=2")
    pairs = {(r["evidence"]["column_a"], r["evidence"]["column_b"]): r["evidence"]["strength"] for r in got if r["category"] == "correlation"}
    assert pairs[("employees", "valuation_billion")] == "strong"
    assert pairs[("valuation_billion", "founded_year")] == "moderate"


def test_insights_alert_on_gaps_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (3, "a", "z"), (4, "b", "w")], "record_seq long, gap string, full string")
    alerts = [r["evidence"] for r in insights(df, "record_seq").collect() if r["category"] == "quality"]
    assert alerts == [{"column": "gap", "missing_count": "2", "missing_percentage": "50.0"}]
    empty = insights(df.limit(0), "record_seq").collect()
    assert [r["category"] for r in empty] == ["overview"]


def test_report_bundle(frame):
    sections = {r["section"] for r in report_bundle(frame, "record_seq").collect()}
    assert sections == {"insights", "statistics", "correlations"}
