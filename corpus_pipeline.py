"""The corpus pipeline: documents in, encoded training texts out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.registry import query, table
from tablewise.llm.bpe import bpe_encode
from tablewise.llm.common import cut
from tablewise.llm.decontaminate import keep_clean
from tablewise.llm.quality import fit_quality, keep_good
from tablewise.llm.queries import tokenizer_file
from tablewise.llm.simhash import keep_one
from tablewise.llm.suffix_dedup import without_repeats


# Words of a benchmark passage that a document may keep.
LONGEST_HIT = 50


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with n_chars, where there is such a column, set to the length of the text; null stays null."""
    if "n_chars" not in changed.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores 0.3 or more."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once; n_chars follows."""
    return _counted(without_repeats(docs), docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window, without
    their runs of more than 50 such words; n_chars follows."""
    return _counted(keep_clean(docs, table(spark, sf_dir, "benchmark"), longest=LONGEST_HIT), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    coded = bpe_encode(docs, tokenizer_file("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding and decoding", encoded),
]

# The classifier and the fingerprints have no SQL form; tests compare the rest by brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
