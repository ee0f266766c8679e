"""The paths that large or skewed tables take, forced on small ones."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewise.functions import bin_index
from tablewise.operators.stats import grouped_median
from tablewise.quantiles import number_facts, quantiles
from tablewise.scale import cut_lineage, hot_keys, keep_first, shared_folder, spread_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a tenth without a key."""
    draw = random.Random(1)

    def key(i):
        if i % 3 == 0:
            return "hot"
        return None if i % 10 == 1 else f"k{draw.randrange(60)}"

    return spark.createDataFrame([(i, key(i)) for i in range(3000)], "id long, key string")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "key string, v int")
    want = sorted(map(tuple, skewed.join(right, "key", how).select("id", "key", "v").collect()), key=str)
    got = spread_join(skewed, right, "key", "id", how, 10)
    assert sorted(map(tuple, got.select("id", "key", "v").collect()), key=str) == want


def test_spread_join_deals_the_hot_key_out(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_join(skewed, right, "key", "id", "inner", 10)
        parts = out.groupBy(F.spark_partition_id()).count().count()
        plain = skewed.join(right, "key", "inner").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plain == 1
    assert parts == 8


def test_spread_join_refuses_the_key_itself(spark, skewed):
    with pytest.raises(ValueError):
        spread_join(skewed, spark.createDataFrame([("hot", 1)], "key string, v int"), "key", "key")


def test_spread_join_spreads_by_the_whole_row_reads_the_left_side_twice_and_writes_nothing(spark, skewed):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    folder = shared_folder(spark).removeprefix("file:")
    before = len(list(os.scandir(folder)))
    left = skewed.mapInArrow(watch, skewed.schema)
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_join(left, right, "key", None, "inner", 10)
        assert out.groupBy(F.spark_partition_id()).count().count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert seen.value == 2 * skewed.count()
    assert len(list(os.scandir(folder))) == before


def test_hot_keys_are_all_found_and_few(spark):
    keys = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, 8).otherwise(F.col("id")).alias("k"))
    found = dict(hot_keys(keys, 1000))
    assert set(found) == {7, 8}
    assert 95 <= found[7] <= 105 and 38 <= found[8] <= 42
    assert hot_keys(keys, 1_000_000) == []
    assert hot_keys(keys.limit(0), 1) == []


def test_spread_join_without_a_hot_key_is_plain(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    assert "_salt" not in spread_join(skewed, right, "key", "id")._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_of_keys_of_two_types(spark, how):
    left = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(500)], "id long, key int")
    right = spark.createDataFrame([(0, "even"), (1, "odd"), (2, "none")], "key long, v string")
    want = sorted(map(tuple, left.join(right, "key", how).select("id", "v").collect()), key=str)
    assert sorted(map(tuple, spread_join(left, right, "key", "id", how, 5).select("id", "v").collect()), key=str) == want


def test_shared_folder_is_required_off_a_local_session():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_keep_first(skewed):
    got = {r["key"]: r["id"] for r in keep_first(skewed, F.col("key"), "id").collect()}
    want = {}
    for r in skewed.orderBy("id").collect():
        want.setdefault(r["key"], r["id"])
    assert got == want


def test_cut_lineage_keeps_rows_and_schema(skewed):
    out = cut_lineage(skewed)
    assert out.schema.simpleString() == skewed.schema.simpleString()
    assert out.count() == 3000
    assert "Range" not in out._jdf.queryExecution().logical().toString()


CASES = {
    "uniform": lambda n: np.random.default_rng(1).uniform(-5, 5, n),
    "heavy_tail": lambda n: np.exp(np.random.default_rng(2).normal(0, 30, n)),
    "few_values": lambda n: np.random.default_rng(3).integers(0, 4, n).astype(float),
    "one_hot_value": lambda n: np.where(np.arange(n) % 3 == 0, 7.0, np.random.default_rng(4).normal(size=n)),
    "constant": lambda n: np.full(n, 2.5),
    "huge": lambda n: np.random.default_rng(5).choice([-1.7e308, -1.0, 0.0, 1e-300, 1.7e308], n),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("few,error", [(1, 0.01), (50, 0.2), (50, -0.1), (1, -0.3)])
def test_quantiles_equal_numpy(spark, case, few, error):
    # A negative error gives brackets that miss their rank.
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    values = CASES[case](997)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, {"v": F.col("v")}, probabilities, few_rows=few, rank_error=error)["v"]
    ordered = np.sort(values)
    for p, g in zip(probabilities, got):
        at = p * (len(values) - 1)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        want = low if low == high else low + (high - low) * (at - np.floor(at))
        assert g == pytest.approx(want, rel=1e-12)


def test_quantiles_of_several_columns_with_gaps(spark):
    rows = [(float(i), None if i % 2 else float(-i), None) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = quantiles(df, {n: F.col(n) for n in "abc"}, [0.25, 0.5], few_rows=5)
    assert got == {"a": [25.0, 50.0], "b": [-75.0, -50.0], "c": [None, None]}


def test_quantiles_need_two_jobs_behind_the_sketch(spark, monkeypatch):
    from tablewise import quantiles as module

    df = spark.range(5000).select((F.col("id") * 7 % 4999).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    facts = number_facts(df, {n: F.col(n) for n in "ab"})
    scans = []
    each = module._each

    def noted(narrow, brackets, part):
        out = each(narrow, brackets, part)
        scans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(module, "_each", noted)
    assert quantiles(df, {n: F.col(n) for n in "ab"}, [0.25, 0.5, 0.75], facts) == {"a": [1248.75, 2498.5, 3748.25], "b": [0.0, 1.0, 2.0]}
    # Column b is settled by the counts; no row is copied for its columns.
    assert [p.count("Range") for p in scans] == [2, 1]
    assert not any("Generate" in p or "Expand" in p for p in scans)


def test_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (3.0,), (float("inf"),)], "v double")
    got = quantiles(df, {"v": F.col("v")}, [0.0, 0.5, 1.0], few_rows=1)["v"]
    assert got == [float("-inf"), 2.0, float("inf")]


def test_grouped_median_with_a_hot_group(spark):
    draw = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 5}", None if i % 11 == 0 else draw.choice([1.5, 2.0, draw.random() * 100])) for i in range(2000)]
    rows += [("gaps", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["key"]: r["median"] for r in grouped_median(df, "k", F.col("v"), small_rows=10).collect()}
    groups = {}
    for k, v in rows:
        if k is not None:
            groups.setdefault(k, []).append(v)
    want = {k: (float(np.median([v for v in vs if v is not None])) if any(v is not None for v in vs) else None) for k, vs in groups.items()}
    assert got == pytest.approx(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 2)), min_size=1, max_size=60), st.integers(1, 10))
def test_bins_equal_numpy(spark, values, bins):
    lo, hi = min(values), max(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counted = df.groupBy(bin_index(F.col("v"), F.lit(lo), F.lit(hi), F.lit(bins)).alias("b")).count()
    got = [0] * bins
    for r in counted.collect():
        got[r["b"]] = r["count"]
    assert got == list(np.histogram(values, bins=bins)[0])
