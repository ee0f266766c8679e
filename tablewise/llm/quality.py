"""Quality scores: random-indexing word vectors, pooled, and a two-layer network with calibrated output."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import bucket_of, map_rows, positional

# Rows of the word table (words share a row by hash) and size of a vector.
TABLE = 1 << 14
SIZE = 48
# Non-zero places of an index vector, and words to either side that count as context.
PLACES = 4
REACH = 2
# Labelled documents the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN = 24

TOKENS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
WORDS_KEPT = 150_000
BLOCK_TOKENS = 200_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each row of the word table."""
    rng = np.random.default_rng(11)
    return rng.integers(0, SIZE, (TABLE, PLACES)), rng.choice(np.array([-1, 1]), (TABLE, PLACES))


class WordRows:
    """Text to rows of the word table."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = TOKENS.findall(text or b"")
        kept = self.kept
        rows = list(map(kept.get, words))
        if None in rows:
            if len(kept) > WORDS_KEPT:
                kept.clear()
            for at, row in enumerate(rows):
                if row is None:
                    word = words[at]
                    rows[at] = row = zlib.crc32(word) % TABLE
                    if len(word) <= 32:
                        kept[word] = row
        return np.array(rows, np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors over all documents, one unit vector per row of the word table.

    A task adds up, for each word, the index vectors of the words around it; the sums
    are whole numbers, combined by one hash aggregation. What comes to the driver is
    TABLE x SIZE numbers, whatever the input.
    """

    def make():
        rows_of = WordRows()
        places, signs = index_vectors()

        def context(total: np.ndarray, rows: np.ndarray) -> None:
            for offset in range(1, REACH + 1):
                for here, there in ((rows[:-offset], rows[offset:]), (rows[offset:], rows[:-offset])):
                    for k in range(PLACES):
                        np.add.at(total, here * SIZE + places[there, k], signs[there, k])

        return rows_of, context

    names = [f"v{k}" for k in range(SIZE)]
    schema = "row int, " + ", ".join(f"{n} long" for n in names)

    import pyarrow as pa

    def run(batches):
        rows_of, context = make()
        total = np.zeros(TABLE * SIZE, np.int64)
        for batch in batches:
            for body in batch.column(0).cast(pa.binary()).to_pylist():
                rows = rows_of(body)
                for at in range(0, len(rows), BLOCK_TOKENS):
                    context(total, rows[max(0, at - REACH) : at + BLOCK_TOKENS])
        table = total.reshape(TABLE, SIZE)
        used = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(used), 4096):
            some = used[at : at + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32))] + [pa.array(table[some, k]) for k in range(SIZE)], names=["row", *names]
            )

    sums = docs.select(text).mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    vectors = np.zeros((TABLE, SIZE), np.float32)
    for r in sums.collect():
        vectors[r[0]] = r[1:]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class QualityModel:
    """Word vectors, network weights, scaling of the inputs, and the temperature."""

    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.shift) / self.scale
        logits = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -30, 30)))


def pool(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of a document; zeros without words."""
    if not len(rows):
        return np.zeros(2 * SIZE)
    total, squares = np.zeros(SIZE), np.zeros(SIZE)
    for at in range(0, len(rows), BLOCK_TOKENS):
        some = vectors[rows[at : at + BLOCK_TOKENS]]
        total += some.sum(axis=0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", some, some)
    mean = total / len(rows)
    return np.concatenate([mean, np.sqrt(np.maximum(squares / len(rows) - mean**2, 0))])


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 5) -> QualityModel:
    """Fit the network by Adam on four fifths of the rows and the temperature on the rest.

    Without rows of both classes the score is the share of label 1 (0.5 without any).
    """
    rng = np.random.default_rng(seed)
    wide = 2 * SIZE
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        zero = np.zeros((wide, HIDDEN))
        return QualityModel(vectors, np.zeros(wide), np.ones(wide), zero, np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - shift) / scale
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or not held.any():
        held[:] = False
    zt, yt = z[~held], y[~held]
    params = [rng.normal(0, 1 / np.sqrt(wide), (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step, batch = 0, 128
    rounds = max(20, min(60, 200_000 // len(yt)))
    for _ in range(rounds):
        order = rng.permutation(len(yt))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            w1, b1, w2, b2 = params
            hidden = np.tanh(zt[some] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - yt[some]) / len(some)
            back = np.outer(error, w2) * (1 - hidden**2)
            grads = [zt[some].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = params
    logits, target = (z[held], y[held]) if held.any() else (zt, yt)
    logits = np.tanh(logits @ w1 + b1) @ w2 + b2
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(target > 0, -1, 1) * logits / t)) for t in grid]
    return QualityModel(vectors, shift, scale, w1, b1, w2, float(b2), float(grid[int(np.argmin(loss))]))


def pooled_features(docs: DataFrame, vectors: np.ndarray, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        rows_of = WordRows()

        def block(rows):
            for doc, body in rows:
                yield doc, pool(shared.value, rows_of(body)).tolist()

        return block

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, pooled array<double>", (text,))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    sample: int = SAMPLE,
) -> QualityModel:
    """Fit on at most ``sample`` labelled documents, none from fold 0; word vectors see all documents.

    The sample is those with the smallest hash of the key, so it is the same in every
    run. A key labelled twice counts with its smaller label; null labels and null keys
    are left out.
    """
    vectors = word_vectors(docs, text)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (bucket_of(key, folds) != 0))
    chosen = known.groupBy(key).agg(F.min(label).cast("int").alias("_label")).orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen.select(key)), key, "left_semi").dropDuplicates([key])
    found = {r[0]: r[1] for r in pooled_features(rows, vectors, key, text).collect()}
    marks = [(r[0], r[1]) for r in chosen.collect() if r[0] in found]
    x = np.array([found[k] for k, _ in marks]).reshape(len(marks), 2 * SIZE)
    return fit_network(vectors, x, np.array([int(v > 0) for _, v in marks], np.float64))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, score[, text and extra columns]) of every row, in one pass without a shuffle.

    A null or empty text pools to zeros and gets the score of that point; repeated rows
    and null keys are scored alike; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(key, text, *extra)

    def make():
        rows_of = WordRows()

        def block(rows):
            model = shared.value
            pooled = np.array([pool(model.vectors, rows_of(r[1])) for r in rows])
            for row, score in zip(rows, model.score(pooled)):
                yield (row[0], float(score), *row[2:])

        return block

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    return map_rows(chosen, make, ", ".join([fields[0], "score double", *fields[2:]]), (text,))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, all columns as they were."""
    plain, names = positional(docs)
    scored = score_quality(
        plain.withColumn("_body", F.col(names[text])), model, names[key], "_body", tuple(c for c in plain.columns if c != names[key])
    )
    return scored.where(F.col("score") >= least).select(*[F.col(new).alias(old) for old, new in names.items()])
