"""Every stage of the pipeline against brute force on its own input."""

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewise.llm import quality
from tablewise.llm.common import cut

from test_llm_text import brute_fingerprint, brute_groups, brute_removed, brute_repeats, brute_scan


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage, over the documents with nulls, repeats and more columns put in."""
    pipeline = importlib.import_module("corpus_pipeline")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = given.limit(1).select(
        F.explode(F.array(F.lit(None).cast("long"), F.lit(10_001), F.lit(10_002))).alias("doc_id"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", F.lit(None).cast("long").alias("n_chars"),
    )
    docs = cut(given.unionByName(odd).unionByName(given.orderBy("doc_id").limit(3)).withColumn("uid", F.lit(7)).withColumn("score", F.lit("x")))
    seen = {}
    for name, stage in pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir))
        seen[name] = (docs, out)
        docs = out
    return seen


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    names = list(stages)
    assert [n.split()[0] for n in names] == ["quality", "SimHash", "suffix-array", "benchmark", "BPE"]
    for name in names[:-1]:
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "score"]


def test_quality_stage(spark, sf_dir, stages):
    docs, out = stages["quality classifier"]
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score_quality(docs, model).where("score >= 0.3")
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kept.collect())
    assert not Counter(rows_of(out)) - Counter(rows_of(docs))


def test_near_copies_stage(stages):
    docs, out = stages["SimHash near-dedup"]
    before, after = rows_of(docs), rows_of(out)
    groups = brute_groups([brute_fingerprint(t) for _, t in before])
    least = {}
    for (key, _), g in zip(before, groups):
        rank = (key is None, key or 0)
        least[g] = min(least.get(g, rank), rank)
    assert sorted((k is None, k or 0) for k, _ in after) == sorted(least.values())
    assert not Counter(after) - Counter(before)


def test_repeats_stage(stages):
    docs, out = stages["suffix-array dedup"]
    before = docs.collect()
    want = Counter()
    for row, (_, _, _, kept) in zip(before, brute_repeats([(r.text or "").encode() for r in before], 200)):
        text = kept.decode("utf-8", "ignore")
        want[row.doc_id, text, len(text)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want


def test_benchmark_stage(spark, sf_dir, stages):
    docs, out = stages["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = rows_of(docs)
    clean = [row for row, found in zip(before, brute_scan([t for _, t in before], items)) if not found[3]]
    assert Counter(rows_of(out)) == Counter((k, brute_removed(t, items, 50)) for k, t in clean)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_encoding_stage(stages):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(
        str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    )
    library.no_truncation()
    library.no_padding()
    docs, out = stages["BPE encoding and decoding"]
    want = Counter()
    for key, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[key, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in out.collect()) == want
