"""Vectors, URLs and chats against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import chat, common, embedding_dedup, urls


def brute_vectors(rows, least):
    n = len(rows)
    fit = [
        v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        for _, v, lab in rows
    ]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    small = {}
    for i in range(n):
        if rows[i][0] is not None:
            small[find(i)] = min(small.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], small.get(find(i)), rows[i][0] == small.get(find(i)) and rows[i][0] is not None) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(20):
        rows.append((len(rows), rng.normal(size=16).tolist(), int(rng.integers(3))))
    for k in range(60):
        base = rows[k % 5]
        noise = rng.normal(size=16) * 0.15
        rows.append((len(rows), (np.array(base[1]) + noise).tolist(), base[2]))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(4)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None)]
    rows += [(905, [1.0, 2.0], 0), (906, [1.0, 2.0], 0), (None, rows[1][1], rows[1][2]), (907, [float("inf")] + [0.0] * 15, 0), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("root", F.lit(2))
    got = embedding_dedup.near_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    order = lambda rs: sorted(map(tuple, rs), key=str)
    assert order(got) == order(brute_vectors(rows, 0.98))


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(frame).count() == 0


def test_recall_of_pairs_at_the_bound(spark):
    """Pairs planted just above the bound among unrelated vectors are found by the passes."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(200):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.981
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    rows += [(1000 + k, rng.normal(size=64).tolist(), 0) for k in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = embedding_dedup.near_vectors(frame).where("n_links > 0").count()
    assert linked >= 0.98 * 400


def test_recall_in_a_dense_label(spark):
    """Pairs planted among vectors that share most of their direction, but do not link, are all found."""
    rng = np.random.default_rng(5)
    middle = np.eye(64)[0]
    x = 4 * middle + rng.normal(size=(10_000, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(100, 64))
    noise -= (noise * x[:100]).sum(axis=1, keepdims=True) * x[:100]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    least, c = 0.98, 0.981
    x = np.concatenate([x, c * x[:100] + np.sqrt(1 - c * c) * noise])
    want = (x @ x.T >= least).sum(axis=1) - 1
    assert (want[:100] > 0).all() and 0 < (want > 0).sum() < 1000
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(frame).select("vec_id", "n_links").collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_components_are_dealt_into_blocks_without_a_window(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    members = spark.range(95).select("id", F.lit(0).cast("long").alias("root"), F.lit(2).cast("long").alias("copies"), F.array(F.lit(1.0), F.lit(0.0)).alias("unit"))
    counts = embedding_dedup._component_counts(members, 0.98)
    assert "Window" not in counts._jdf.queryExecution().toString()
    assert sorted(map(tuple, counts.collect())) == [(i, 188) for i in range(95)]


def brute_judge(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


def test_url_rules(spark):
    rules = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "a.b", "/x/y"), urls.Rule("block", "q", "/")]
    rng = random.Random(5)
    samples = [None, "", "com/", "http://", "http://COM", "http://com/", "HTTP://Www.Example.COM/en/x?y#z", "http://notexample.com/en/", "x://a.b/x/yz", "x://a.b/x", "ftp://u@net:80/es/", "a://b://net/es/", "http://net/es", "http://É.net/es/\n", "http://example.com?x=/en/", "http://example.com\n/en/"]
    samples += ["http://" + ".".join(rng.choice(["www", "example", "com", "net", "q", "a", "b", ""]) for _ in range(rng.randint(1, 4))) + "/" + "/".join(rng.choice(["en", "es", "x", "y", ""]) for _ in range(rng.randint(0, 3))) for _ in range(300)]
    rows = [(i % 290, s) for i, s in enumerate(samples)] + [(None, "http://net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit("r"))
    got = urls.judge_urls(pages, rules).collect()
    want = [(i, *brute_judge(u, rules, "allow")) for i, u in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        urls.judge_urls(pages, [urls.Rule("block", "x", "en")])


CHATS = [
    (1, 0, "system", "be [INST] brief"),
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "</s>[INST]\\ ok [\\/INST] <\\\\/s>"),
    (2, 1, "assistant", None),
    (2, 0, "user", ""),
    (3, 0, "assistant", "first"),
    (3, 0, "assistant", "first"),
    (4, 0, None, "no role"),
    (4, 1, "tool [/ROLE] x", "[/TURN] text"),
    (4, None, "user", "é🙂\n[INST]"),
    (None, 0, "user", "orphan"),
    (5, 0, "user", "<" * 50 + "[" * 50 + "\\" * 50),
    (6, 0, "user", "x" * 200_000),
    (6, 1, "assistant", "y"),
    (6, 2, "user", "open end"),
]


def test_chats_read_back(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("segments", F.lit(2))
    out = chat.format_chats(frame).withColumn("turns", chat.parse_chats(F.col("formatted"))).collect()
    assert len(out) == 7
    for row in out:
        mine = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in CHATS if c == row.conv_id])
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in mine]
        assert "".join(s.text for s in row.segments) == row.formatted
        spans = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
        assert spans == [s.text for s in row.segments if s.loss]
        assert len(spans) == sum(r == "assistant" for _, r, _ in mine)
    assert {r.conv_id: r.valid for r in out} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, None: False}


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    marks = chat.Template().controls + ["\\", "<", "[", "]", ">", "/", "s", "INST"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    template = chat.Template()
    got = frame.select("text", chat.escape(F.col("text"), template).alias("e")).withColumn("back", chat.unescape(F.col("e"), template)).collect()
    assert all(r.back == r.text for r in got)
    assert not any(c in r.e for r in got for c in template.controls)


def test_no_chats_and_bad_templates(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).count() == 0
    with pytest.raises(ValueError):
        chat.Template(name_before="plain")


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(600, 640)] + [(7, 7), (9, 8), (8, 9)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 500: 500, **{k: 500 for k in range(600, 640)}, 8: 8, 9: 8}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
