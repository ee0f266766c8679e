"""Most frequent and first values against counting by hand, with sketches that prove and that fail."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewise.frequent import distinct_counts, first_values, frequent_values


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(2)
    rows = []
    for i in range(3000):
        rows.append(
            (
                i,
                draw.choice(["a", "b", "b", "c", None, "null", " "]),
                min(int(draw.expovariate(0.002)), 5000),
                draw.choice([0.0, -0.0, 1.5, draw.random()]),
                f"v{draw.randrange(10**9):09d}",
                f"tie{i % 300:03d}",
                "long " * 80 + draw.choice("xyz"),
                None,
                i % 3 == 0 if i % 2 else None,
            )
        )
    kinds = "seq long, few string, tail long, zero double, unique string, tied string, wide string, nothing string, flag boolean"
    return spark.createDataFrame(rows, kinds).repartition(6)


NAMES = ["few", "tail", "zero", "unique", "tied", "wide", "nothing", "flag"]


def shown(value):
    if isinstance(value, bool):
        return str(value).lower()
    return str(value + 0.0) if isinstance(value, float) else str(value)


def cells(df, name):
    """(text, first) of the non-missing cells by place."""
    held = [(r["seq"], shown(r[name])) for r in df.select("seq", name).collect() if r[name] is not None]
    return sorted((seq, v) for seq, v in held if v.strip().lower() not in ("", "null"))


def whole(df, name, key):
    """The text of a key, long texts by their only match."""
    if not key.startswith("sha256:"):
        return key
    return df.where(F.concat(F.lit("sha256:"), F.sha2(name, 256)) == key).first()[name]


@pytest.mark.parametrize("size", [1, 5, None])
@pytest.mark.parametrize("tracked,candidates,error", [(20_000, 64, None), (64, 8, 3.5 / 128), (20_000, 5, 0.4)])
def test_frequent_values_equal_counting(mixed, size, tracked, candidates, error):
    options = {} if error is None else {"error": error}
    totals = {n: len(cells(mixed, n)) for n in NAMES}
    for uniques in (None, distinct_counts(mixed, NAMES)):
        rows = frequent_values(mixed, NAMES, "seq", size, uniques, totals, ["few"] if size == 1 else [], tracked, candidates, **options).collect()
        for name in NAMES:
            got = [(whole(mixed, name, r["key"]), r["n"], r["first"]) for r in sorted(rows, key=lambda r: r["place"]) if r["column"] == name]
            held = cells(mixed, name)
            counts = Counter(v for _, v in held)
            first = {v: seq for seq, v in reversed(held)}
            # Long texts share their start, so their ties go by the hash.
            want = sorted(counts.items(), key=lambda x: (-x[1], x[0][:256], x[0] if len(x[0]) <= 256 else ""))[:size]
            assert [g[:2] for g in got] == want
            assert all(first[v] == f for v, _, f in got)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_first_values_equal_looking(mixed, rows):
    got = first_values(mixed, NAMES, "seq", 5, rows=rows).collect()
    for name in NAMES:
        seen = []
        for _, v in cells(mixed, name):
            if v not in seen:
                seen.append(v)
        here = [whole(mixed, name, r["key"]) for r in sorted(got, key=lambda r: r["place"]) if r["column"] == name]
        assert here == seen[:5]


def test_distinct_counts(mixed):
    assert distinct_counts(mixed, NAMES) == {n: len({v for _, v in cells(mixed, n)}) for n in NAMES}


def test_a_proven_column_needs_no_count_of_all_values(mixed):
    plan = frequent_values(mixed, ["few", "wide"], "seq", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_no_rows(mixed):
    empty = mixed.limit(0)
    assert frequent_values(empty, NAMES, "seq", 5).count() == 0
    assert first_values(empty, NAMES, "seq", 5).count() == 0
    assert set(distinct_counts(empty, NAMES).values()) == {0}
    assert frequent_values(mixed, [], "seq", 5).count() == 0
