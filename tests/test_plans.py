import numpy as np
import random

import pytest

from tablewise.plans import Filter, Plan, bind, run
from tablewise.operators.stats import correlation_pairs, describe_numeric, iqr_bounds, outlier_report
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_sum_of_headquarters(frame):
    out = run(frame, Plan("group_by", ["valuation_billion"], "headquarters", "sum")).table
    assert rows(out) == [
        ("San Francisco", 118.0),
        ("Paris", 6.0),
        ("Toronto", 5.0),
        ("New York", 4.5),
        ("Bangalore", 1.5),
    ]
    assert out.columns == ["headquarters", "sum_valuation_billion"]


def test_sort_limit_and_filter(frame):
    out = run(frame, Plan("sort_limit", sort_by="valuation_billion", limit=3)).table
    assert [r["valuation_billion"] for r in out.collect()] == [86.0, 18.0, 14.0]
    kept = run(frame, Plan("filter", filters=[Filter("employees", ">", 400)], order_column="record_seq")).table
    assert kept.count() == 3


@pytest.mark.parametrize(
    "operator,value,expected",
    [(">", 400.5, 3), (">=", 400, 4), (">=", 400.5, 3), ("<", 400.5, 5), ("<=", 399.5, 4), ("<", "many", 8), ("==", "400", 0), ("==", 400, 1), ("!=", 400, 7)],
)
def test_whole_number_bounds(frame, operator, value, expected):
    out = run(frame, Plan("filter", filters=[Filter("employees", operator, value)])).table
    assert out.count() == expected


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None)], "k long, v double")

    def kept(op, value=None):
        return {r["k"] for r in run(df, Plan("filter", filters=[Filter("v", op, value)])).table.collect()}

    assert kept(">", 1) == {2}
    assert kept("is_null") == {1, 3}
    assert kept("is_not_null") == {2}
    assert kept("!=", 5.0) == {1, 3}


def test_contains_is_literal_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, "A.c"), (2, "abc"), (3, None)], "k long, v string")
    out = run(df, Plan("filter", filters=[Filter("v", "contains", "a.C")])).table
    assert [r["k"] for r in out.collect()] == [1]


def test_filters_reach_the_reader(spark, sf_dir):
    from tablewise.operators.filters import apply_filters

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = apply_filters(df, [Filter("l_quantity", ">", 24), Filter("l_orderkey", "<=", 100.5), Filter("l_returnflag", "==", "A")])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = out.select("l_tax")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThan(l_quantity,24.0)", "LessThanOrEqual(l_orderkey,100)", "EqualTo(l_returnflag,A)"):
        assert part in pushed


def test_bind_repairs_names_and_refuses_operations():
    plan = bind(Plan("group_by", ["B", "x"], "missing", "AVG", [Filter("A", "==", 1), Filter("a", "like", 1)], limit=9999), ["a", "b"])
    assert plan.target_columns == ("b",)
    assert plan.group_by_column is None
    assert plan.aggregation_func == "mean"
    assert [f.column for f in plan.filters] == ["a"]
    assert plan.limit == 9999 and bind(Plan("filter"), ["a"]).limit is None
    for limit in (0, -1, 10**9):
        with pytest.raises(ValueError):
            bind(Plan("filter", limit=limit), ["a"])
    assert bind(Plan("aggregate", aggregation_func="product"), ["a"]).aggregation_func == "count"
    with pytest.raises(ValueError):
        bind(Plan("drop_table"), ["a"])


def test_group_rules(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "3"), (None, "7")], "k string, v string")
    assert rows(run(df, Plan("group_by", ["v"], "k", "sum")).table) == [("b", 3.0), ("a", 0.0)]
    assert rows(run(df, Plan("group_by", ["v"], "k", "mean")).table) == [("b", 3.0), ("a", None)]
    assert rows(run(df, Plan("group_by", ["v"], "k", "mean", sort_ascending=True)).table) == [("b", 3.0), ("a", None)]
    assert rows(run(df, Plan("group_by", ["k"])).table) == [("a", 2), ("b", 1)]


def test_distinct_counts_values_of_any_type(frame):
    out = run(frame, Plan("group_by", ["company_name"], "headquarters", "distinct_count")).table
    assert rows(out)[0] == ("San Francisco", 3)
    assert out.columns[1] == "distinct_count_company_name"


def test_empty_input(spark):
    df = spark.createDataFrame([], "a string")
    out = run(df, Plan("general_summary"))
    assert out.table.count() == 0
    assert rows(out.metrics) == [("empty_dataset", 0)]


def test_describe(frame):
    got = {r["column"]: r for r in describe_numeric(frame).collect()}
    e, v = got["employees"], got["valuation_billion"]
    assert (e["mean"], e["std"], e["q25"], e["median"], e["q75"]) == (506.25, 498.9972, 142.5, 350.0, 625.0)
    assert (v["mean"], v["std"], v["q25"], v["median"], v["q75"]) == (16.875, 28.5866, 3.625, 5.5, 15.0)
    assert "company_name" not in got


def test_single_value_has_no_deviation(spark):
    out = describe_numeric(spark.createDataFrame([("4",), ("x",)], "a string")).first()
    assert (out["count"], out["std"], out["median"]) == (1, 0.0, 4.0)


def test_outliers(frame):
    bounds = iqr_bounds(frame, ["valuation_billion", "employees", "founded_year"])
    assert bounds["valuation_billion"][2:] == (-13.4375, 32.0625)
    assert bounds["employees"][2:] == (-581.25, 1348.75)
    assert bounds["founded_year"][2:] == (2005.5, 2033.5)
    report = {r["column"]: r for r in outlier_report(frame, "record_seq").collect()}
    assert report["valuation_billion"]["sample_outlier_values"] == [86.0]
    assert report["employees"]["sample_outlier_values"] == [1500.0]
    assert report["founded_year"]["outlier_count"] == 0
    out = run(frame, Plan("outlier_detection", ["valuation_billion"]))
    assert [r["company_name"] for r in out.table.collect()] == ["Alder"]
    few = run(frame.limit(3), Plan("outlier_detection", ["employees"])).table
    assert few.columns == ["message"]


def test_correlation(frame):
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in run(frame.drop("record_seq"), Plan("correlation")).table.collect()}
    assert got == {
        ("employees", "valuation_billion"): 0.882,
        ("employees", "founded_year"): -0.7872,
        ("valuation_billion", "founded_year"): -0.5785,
    }


def test_correlation_with_gaps_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 7.0, None), (2.0, None, 7.0, None), (3.0, 5.0, 7.0, 1.0), (4.0, 9.0, 7.0, None)],
        "a double, b double, fixed double, lonely double",
    )
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_pairs(df).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 9])[0, 1])
    assert all(r is None for pair, r in got.items() if "fixed" in pair or "lonely" in pair)
    one = run(df.select("a", F.lit("x").alias("t")), Plan("correlation")).table
    assert one.columns == ["message"]


def test_histogram(frame, spark):
    from tablewise.plans.run import histogram

    out = histogram(frame, F.col("valuation_billion"), 0.5, 86.0, 8).collect()
    assert [r["count"] for r in out] == [5, 2, 0, 0, 0, 0, 0, 1]
    assert [r["bin_start"] for r in out] == [0.5 + k * 10.6875 for k in range(8)]
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    out = run(same, Plan("distribution", ["v"])).table.collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in out] == [(4.5, 5.0, 0), (5.0, 5.5, 2)]
    assert out[0]["bin_range"] == "4.5 - 5.0"


@pytest.mark.parametrize("copies", [1, 4])
def test_pairs_equal_numpy_with_gaps_and_infinities(spark, copies):
    """Six columns, and twenty-four of them: one way for any number of pairs."""
    from tablewise.operators.stats import pairs_of

    draw = random.Random(3)
    far = [float("inf"), float("-inf"), float("nan")]
    data = []
    for _ in range(300):
        x = draw.gauss(0, 1)
        row = (x, 2 * x + draw.gauss(0, 1), None if draw.random() < 0.3 else draw.gauss(5, 2), 1e6 + x, 7.0, None, draw.choice([x, x, draw.choice(far)]))
        data.append(row * copies)
    names = [f"{n}{k}" for k in range(copies) for n in "abcdefg"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in pairs_of(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    cells = np.array([[np.nan if v is None or np.isinf(v) else v for v in row] for row in data], float)
    for (a, b), r in got.items():
        x, y = cells[:, names.index(a)], cells[:, names.index(b)]
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[both], y[both]
        if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_products_leave_no_python_worker_in_the_plan(spark, monkeypatch):
    from tablewise.operators import stats

    seen = []
    real = stats.MLUtils.convertVectorColumnsFromML

    def noted(vectors, name):
        seen.append(vectors._jdf.queryExecution().executedPlan().toString())
        return real(vectors, name)

    monkeypatch.setattr(stats.MLUtils, "convertVectorColumnsFromML", staticmethod(noted))
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"), F.rand(1).alias("c"))
    stats.pairs_of(df, df.columns)
    assert len(seen) == 1 and "Python" not in seen[0] and "Arrow" not in seen[0]


def test_pairs_of_empty_and_constant_columns(spark):
    from tablewise.operators.stats import pairs_of

    df = spark.createDataFrame([], "a double, b double")
    assert [r["r"] for r in pairs_of(df, ["a", "b"]).collect()] == [None]
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (1.0, 3.0, float("inf"))], "a double, b double, c double")
    assert [r["r"] for r in pairs_of(df, ["a", "b", "c"]).collect()] == [None, None, None]
    assert pairs_of(df, ["a"]).count() == 0
