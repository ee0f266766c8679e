"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import block_sizes, bucket_of, cut

# The end of a document; no word holds a blank.
END = b" "
# Classes of the output words: about the root of their number.
CLASSES = 224
EMBED = 16
HIDDEN = 24
WINDOW = 32
# Most frequent words, which are the words of the recurrent model and whose counts every
# task holds, and the longest of them in bytes.
HEAD = 50_000
HEAD_BYTES = 128
# Every training document moves the weights, in one of this many rounds.
ROUNDS = 2
SHARD_TOKENS = 1_500_000
# Texts read side by side in training. A step moves all weights it meets once, so few
# streams make many dear steps.
STREAMS = 256
# Bytes of text that are counted, encoded or scored side by side; a longer text goes alone.
BLOCK_BYTES = 4 << 20
# Words whose output layer is computed together.
SETTLED = 1 << 16
# States whose softmax is computed at a time, and the logits whose exponentials need no shift.
BLOCK = 1024
SAFE, LEAST = 60.0, 1e-25
# Neighbouring classes move together, about so many output rows at a time.
MOVED = 2048
# Weights that travel as one row.
CHUNK = 1024


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts end to end, with A-Z lower-cased, and how many each text has; the ends are left out."""
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.view(pa.string())
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().cast(pa.binary())
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # A text without words is split into one empty string.
    blank = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    if blank.any():
        many[blank] = 0
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, many


def with_ends(found: np.ndarray, many: np.ndarray, end: int) -> np.ndarray:
    """``found``, a value of each word, with ``end`` behind the words of each text."""
    out = np.full(len(found) + len(many), end, found.dtype)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(many + 1) - 1] = False
    out[inside] = found
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token binary, n) over all documents; a task adds up its words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in block_sizes(batch, batch.num_rows, BLOCK_BYTES):
                counts = pc.value_counts(split_words(batch.column(0).slice(first, rows))[0])
                tokens = pa.concat_arrays([counts.field("values"), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [tokens, pa.concat_arrays([counts.field("counts"), pa.array([rows], pa.int64())])], names=["token", "n"]
                )

    return docs.select(text).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Head words by falling count, and the classes of the model's words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.logs = np.log10(self.counts + 1.0)
        # Model word of each head word. Words are numbered by class; one is "any other word".
        self.end_place = self.words.index(END) if END in self.words else -1
        n = self.counts.astype(np.float64)
        rest = max(self.total - n.sum(), 0) + 1.0
        mass = np.concatenate([[rest], n])
        order = np.argsort(-mass, kind="stable")
        number = np.empty(len(mass), np.int64)
        number[order] = np.arange(len(mass))
        self.model = number[1:]
        self.other = int(number[0])
        self.end = int(self.model[self.end_place]) if self.end_place >= 0 else self.other
        self.mass = mass[order]
        spread = np.sqrt(self.mass)
        self.of_class = np.minimum(np.floor(CLASSES * (np.cumsum(spread) - spread) / spread.sum()), CLASSES - 1).astype(np.int64)
        self.bounds = np.searchsorted(self.of_class, np.arange(CLASSES + 1))
        self.size = len(self.mass)
        # Words outside the model share the chance of "any other" by their counts plus one.
        self.other_total = self.total - n.sum() + self.distinct - len(self.words) + 1

    def places(self, words: pa.Array) -> np.ndarray:
        """Number of each word among the head words, -1 for all others."""
        return pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.binary())), -1).to_numpy(zero_copy_only=False)


def start_weights(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Random weights whose output is the unigram distribution of the counts."""
    rng = np.random.default_rng(seed)
    mass = vocabulary.mass
    by_class = np.bincount(vocabulary.of_class, weights=mass, minlength=CLASSES)
    return {
        k: v.astype(np.float32)
        for k, v in {
            "embed": rng.normal(0, 0.3, (vocabulary.size, EMBED)),
            "input": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
            "state": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
            "bias": np.zeros(3 * HIDDEN),
            "class_w": rng.normal(0, 0.02, (HIDDEN, CLASSES)),
            "class_b": np.log(np.maximum(by_class, 1e-9) / mass.sum()),
            "word_w": rng.normal(0, 0.02, (HIDDEN, vocabulary.size)),
            "word_b": np.log(mass / by_class[vocabulary.of_class]),
        }.items()
    }


def _softmax(wide: np.ndarray, rows: np.ndarray, target: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Exponentials of ``wide @ rows.T``, their totals, and the logarithms of the chances of ``target`` if there is one.

    Each row is taken down by its largest value only where some would leave the range of floats.
    """
    x = wide @ rows.T
    wanted = None if target is None else x[np.arange(len(x)), target]
    if x.max() < SAFE:
        np.exp(x, out=x)
        totals = x @ np.ones(len(rows), x.dtype)
        if totals.min() > LEAST:
            return x, totals, None if wanted is None else wanted - np.log(totals)
        x = wide @ rows.T
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    totals = x.sum(axis=1)
    return x, totals, None if wanted is None else wanted - top - np.log(totals)


def _wide(h: np.ndarray) -> np.ndarray:
    """``h`` and a column of ones, which meets the bias."""
    wide = np.empty((len(h), HIDDEN + 1), h.dtype)
    wide[:, :HIDDEN], wide[:, HIDDEN] = h, 1
    return wide


def _target_logs(wide: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-softmax of ``target`` under the output ``rows``, for each row of ``wide``; BLOCK at a time, so that it stays in cache."""
    found = np.empty(len(wide), wide.dtype)
    for a in range(0, len(wide), BLOCK):
        found[a : a + BLOCK] = _softmax(wide[a : a + BLOCK], rows, target[a : a + BLOCK])[2]
    return found


def gates(h: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and both gates and the two parts of the candidate, a row a text."""
    return tuple(v.T for v in _gate_columns(h.T, a.T, state.T))


def _gate_columns(h: np.ndarray, a: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, ...]:
    """``gates`` with a column a text, so that each gate is one block; ``turned`` is the state weights transposed."""
    s = turned @ h
    zr, c = s[: 2 * HIDDEN], s[2 * HIDDEN :]
    zr += a[: 2 * HIDDEN]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    n = r * c
    n += a[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, c


def log_chances(
    w: dict[str, np.ndarray], vocabulary: Vocabulary, h: np.ndarray, target: np.ndarray, out: np.ndarray | None = None
) -> np.ndarray:
    """Natural log-probability of each target after state ``h``: its class, then the word in the class.

    ``out`` are the ``output_rows`` of ``w``, where they are at hand.
    """
    out = output_rows(w) if out is None else out
    order = np.argsort(target, kind="stable")
    target, wide = target[order], _wide(h[order])
    kinds = vocabulary.of_class[target]
    found = _target_logs(wide, class_rows(w), kinds).astype(np.float64)
    edges = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
    bounds = vocabulary.bounds.tolist()
    for k in np.unique(kinds).tolist():
        a, b, low, high = edges[k], edges[k + 1], bounds[k], bounds[k + 1]
        found[a:b] += _target_logs(wide[a:b], out[low:high], target[a:b] - low)
    unsorted = np.empty_like(found)
    unsorted[order] = found
    return unsorted


def score_texts(w: dict[str, np.ndarray], vocabulary: Vocabulary, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of model words.

    Sequences run side by side in windows of WINDOW words. The state goes from one
    window to the next, so each sequence is scored whole, whatever its length.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    total = np.zeros(len(texts))
    inputs, out_rows = w["embed"] @ w["input"] + w["bias"], output_rows(w)
    turned = np.ascontiguousarray(w["state"].T)
    h = np.zeros((HIDDEN, len(texts)), np.float32)
    last = np.full(len(texts), vocabulary.end, np.int64)
    flat = np.concatenate([texts[i] for i in order] or [np.zeros(0, np.int64)])
    begins = np.cumsum(sizes) - sizes
    at = 0
    # States that wait for their output layer, which is dear on few of them.
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    many = 0

    def settle() -> None:
        states, target, rows = (np.concatenate(x) for x in zip(*waiting))
        total[: len(texts)] += np.bincount(rows, weights=log_chances(w, vocabulary, states, target, out_rows), minlength=len(texts))
        waiting.clear()

    while len(sizes) and at < sizes[0]:
        active = int(np.searchsorted(-sizes, -at, side="left"))
        h, last = h[:, :active], last[:active]
        steps = int(min(WINDOW, sizes[0] - at))
        # Behind the end of a sequence stands whatever follows; it is left out below.
        spots = np.minimum((begins[:active] + at)[:, None] + np.arange(steps), len(flat) - 1)
        target = flat[spots].astype(np.int64)
        states = np.empty((steps, active, HIDDEN), np.float32)
        for t in range(steps):
            h = _gate_columns(h, inputs[last].T, turned)[0]
            states[t] = h.T
            last = target[:, t]
        real = np.arange(at, at + steps)[:, None] < sizes[:active]
        rows = np.broadcast_to(np.arange(active), real.shape)[real]
        waiting.append((states[real], target.T[real], rows))
        many += len(rows)
        if many >= SETTLED:
            settle()
            many = 0
        at += WINDOW
    if waiting:
        settle()
    out = np.empty(len(texts))
    out[order] = total / np.log(10)
    return out


def window_gradients(w: dict[str, np.ndarray], out: np.ndarray, vocabulary: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray):
    """Gradients of the mean negative log-probability of ``y`` after ``x``, a window of each stream.

    ``out`` holds a row for each output word, its weights and its bias. ``h`` is the state
    before the window; the new one is returned. Only what the window meets has a gradient:
    the embeddings of its words, as (words, values), and the rows of the classes of its
    targets, as a list of (low, high, values).
    """
    streams, steps = x.shape
    kind = out.dtype
    words, spots = np.unique(x, return_inverse=True)
    spots = spots.reshape(x.shape)
    embed = w["embed"][words]
    inputs = embed @ w["input"] + w["bias"]
    turned = np.ascontiguousarray(w["state"].T)
    keep = (x.T != vocabulary.end)[:, None, :].astype(kind)
    # A column a stream, as in the gates.
    h0, states, z, r, n, c = (np.empty((steps, HIDDEN, streams), kind) for _ in range(6))
    h = h.T
    for t in range(steps):
        np.multiply(h, keep[t], out=h0[t])
        h, z[t], r[t], n[t], c[t] = _gate_columns(h0[t], inputs[spots[:, t]].T, turned)
        states[t] = h
    g, rows, back = _output_gradients(w, out, vocabulary, states.transpose(0, 2, 1).reshape(-1, HIDDEN), y.T.reshape(-1))
    back = np.ascontiguousarray(back.reshape(steps, streams, HIDDEN).transpose(0, 2, 1))
    # What a change of the state is worth to each gate, for all steps.
    to_n = (1 - z) * (1 - n * n)
    to_z = (h0 - n) * z * (1 - z)
    to_r = c * r * (1 - r)
    moved, through = (np.empty((steps, 3 * HIDDEN, streams), kind) for _ in range(2))
    onward = np.zeros((HIDDEN, streams), kind)
    for t in range(steps - 1, -1, -1):
        d = onward
        d += back[t]
        here, ds = moved[t], through[t]
        dn = here[2 * HIDDEN :]
        np.multiply(d, to_z[t], out=here[:HIDDEN])
        np.multiply(d, to_n[t], out=dn)
        np.multiply(dn, to_r[t], out=here[HIDDEN : 2 * HIDDEN])
        ds[: 2 * HIDDEN] = here[: 2 * HIDDEN]
        np.multiply(dn, r[t], out=ds[2 * HIDDEN :])
        onward = w["state"] @ ds
        d *= z[t]
        onward += d
        onward *= keep[t]
    g["state"] = np.matmul(h0, through.transpose(0, 2, 1)).sum(axis=0)
    g["bias"] = moved.sum(axis=(0, 2))
    g["input"] = np.matmul(embed[spots.T].transpose(0, 2, 1), moved.transpose(0, 2, 1)).sum(axis=0)
    met = spots.T.reshape(-1)
    order = np.argsort(met, kind="stable")
    begins = np.flatnonzero(np.diff(met[order], prepend=-1))
    by_spot = np.matmul(w["input"], moved).transpose(0, 2, 1).reshape(-1, EMBED)
    return g, (words, np.add.reduceat(by_spot[order], begins)), rows, h.T


def _output_gradients(w, out: np.ndarray, vocabulary: Vocabulary, h: np.ndarray, target: np.ndarray):
    """Gradients for the class weights, for the output rows of the classes met, and for ``h``.

    Classes that lie side by side share a block of rows, of about MOVED rows.
    """
    n = len(target)
    order = np.argsort(target, kind="stable")
    target, wide = target[order], _wide(h[order])
    kinds = vocabulary.of_class[target]
    classes = class_rows(w)
    back, by_class = np.empty((n, HIDDEN), h.dtype), np.zeros_like(classes)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        back[a:b], x, part = _softmax_gradients(wide[a:b], classes, kinds[a:b], n)
        by_class += x.T @ part
    edges = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
    bounds = vocabulary.bounds.tolist()
    moved = np.empty_like(out)
    blocks: list[list[int]] = []
    for k in np.unique(kinds).tolist():
        a, b, low, high = edges[k], edges[k + 1], bounds[k], bounds[k + 1]
        more, x, part = _softmax_gradients(wide[a:b], out[low:high], target[a:b] - low, n)
        back[a:b] += more
        np.matmul(x.T, part, out=moved[low:high])
        if blocks and blocks[-1][1] == low and high - blocks[-1][0] <= MOVED:
            blocks[-1][1] = high
        else:
            blocks.append([low, high])
    rows = [(low, high, moved[low:high]) for low, high in blocks]
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return {"class_w": by_class[:, :HIDDEN].T, "class_b": by_class[:, HIDDEN]}, rows, unsorted


def _softmax_gradients(wide: np.ndarray, rows: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Gradient for the states, of a mean over ``n``, and the two factors of that of the output ``rows``.

    The chances stay exponentials; their totals divide the narrow sides of the products.
    """
    x, totals, _ = _softmax(wide, rows)
    x[np.arange(len(x)), target] -= totals
    totals *= n
    wide = wide / totals[:, None]
    back = x @ rows[:, :HIDDEN]
    back /= totals[:, None]
    return back, x, wide


def class_rows(w: dict[str, np.ndarray]) -> np.ndarray:
    """Weights and bias of each class, one row a class."""
    return np.concatenate([w["class_w"].T, w["class_b"][:, None]], axis=1)


def output_rows(w: dict[str, np.ndarray]) -> np.ndarray:
    """Weights and bias of each output word, one row a word: a class is a block of rows."""
    return np.concatenate([w["word_w"].T, w["word_b"][:, None]], axis=1)


def train(w: dict[str, np.ndarray], vocabulary: Vocabulary, stream: np.ndarray, rate: float = 0.01) -> dict[str, np.ndarray]:
    """One pass of Adam over ``stream`` (documents end to end), by backpropagation cut at WINDOW words.

    A step moves the gates and class weights whole, of embeddings and output rows those
    that its window meets.
    """
    w = {k: v.copy() for k, v in w.items()}
    out = output_rows(w)
    del w["word_w"], w["word_b"]
    first = {k: np.zeros_like(v) for k, v in [*w.items(), ("out", out)]}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    streams = int(min(STREAMS, max(1, len(stream) // (WINDOW * 4))))
    length = len(stream) // streams
    target = stream[: length * streams].reshape(streams, length)
    before = np.concatenate([np.full((streams, 1), vocabulary.end), target[:, :-1]], axis=1)
    h = np.zeros((streams, HIDDEN), np.float32)

    def move(m: np.ndarray, s: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
        """What Adam takes off the weights; the moments, kept as 10 and 1,000 fold sums, change in place."""
        unit = ((1 - 0.999**step) / 0.001) ** 0.5
        m *= np.float32(0.9)
        m += v
        s *= np.float32(0.999)
        v *= v
        s += v
        np.sqrt(s, out=v)
        v += np.float32(1e-8 * unit)
        np.divide(m, v, out=v)
        v *= np.float32(0.1 * unit * rate / (1 - 0.9**step))
        return v

    for step, at in enumerate(range(0, length, WINDOW), 1):
        x, y = before[:, at : at + WINDOW], target[:, at : at + WINDOW]
        g, (words, embed), rows, h = window_gradients(w, out, vocabulary, x, y, h)
        parts = [*g.values(), embed, *(v for _, _, v in rows)]
        size = np.sqrt(sum(float(np.vdot(v, v)) for v in parts))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        if scale < 1:
            for v in parts:
                v *= scale
        for k, v in g.items():
            w[k] -= move(first[k], second[k], v, step)
        m, s = first["embed"][words], second["embed"][words]
        w["embed"][words] -= move(m, s, embed, step)
        first["embed"][words], second["embed"][words] = m, s
        for low, high, v in rows:
            out[low:high] -= move(first["out"][low:high], second["out"][low:high], v, step)
    w["word_w"], w["word_b"] = np.ascontiguousarray(out[:, :HIDDEN].T), out[:, HIDDEN].copy()
    return w


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


@dataclass
class LanguageModel:
    """Weights and vocabulary for the tasks, and the table of all word counts."""

    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]
    counts: DataFrame


def _average(docs: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray], text: str, shards: int) -> dict[str, np.ndarray]:
    """Weights trained on each shard of ``docs`` from the same start, averaged by words seen.

    Documents go to their shards as numbers of model words, and a shard trains in its own
    task. Its weights travel as chunks of floats, each of which is added up in one task as
    they arrive; their number does not depend on the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    kind = np.min_scalar_type(vocabulary.size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = shared.value
        model = np.append(vocabulary.model, vocabulary.other).astype(kind)
        for batch in batches:
            for first, rows in block_sizes(batch, batch.num_rows, BLOCK_BYTES):
                words, many = split_words(batch.column(0).slice(first, rows))
                ids = model[with_ends(vocabulary.places(words), many, vocabulary.end_place)]
                edges = np.append(0, np.cumsum(many + 1)) * kind.itemsize
                buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), rows, buffers).cast(pa.binary())], names=["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, now = shared.value
        held: list[np.ndarray] = []
        waiting = seen = 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                held.append(np.frombuffer(body, kind))
                waiting += len(held[-1])
                if waiting > 2 * SHARD_TOKENS:
                    now = train(now, vocabulary, np.concatenate(held).astype(np.int64))
                    seen, waiting, held = seen + waiting, 0, []
        if waiting:
            now = train(now, vocabulary, np.concatenate(held).astype(np.int64))
            seen += waiting
        if seen:
            flat = _flat(now)
            chunks = [flat[a : a + CHUNK].tobytes() for a in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(chunks), dtype=np.int32)),
                    pa.array(np.full(len(chunks), seen, np.int64)),
                    pa.array(chunks, pa.binary()),
                ],
                names=["chunk", "seen", "part"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        totals: dict[int, int] = {}
        for batch in batches:
            for chunk, seen, part in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(part, np.float32) * float(seen)
                sums[chunk] = sums[chunk] + more if chunk in sums else more
                totals[chunk] = totals.get(chunk, 0) + seen
        if sums:
            means = [(sums[c] / totals[c]).astype(np.float32).tobytes() for c in sums]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], names=["chunk", "mean"])

    parts = docs.select(text).mapInArrow(encode, "ids binary").repartition(shards).mapInArrow(run, "chunk int, seen long, part binary")
    rows = parts.repartition("chunk").mapInArrow(add_up, "chunk int, mean binary").toArrow().sort_by("chunk")
    if not rows.num_rows:
        return weights
    return _unflat(np.frombuffer(b"".join(rows["mean"].to_pylist()), np.float32), weights)


def frequent_words(counts: DataFrame) -> list:
    """At most HEAD words, by falling count: those whose count reaches a bound.

    The bound comes from the number of words in each eighth of a power of two, so only
    those few sums and the words themselves come to the driver.
    """
    short = counts.where(F.length("token") <= HEAD_BYTES)
    grade = F.floor(F.log2("n") * 8).cast("int")
    grades = {r["grade"]: r["words"] for r in short.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words")).collect()}
    held, least = 0, None
    for g in sorted(grades, reverse=True):
        held += grades[g]
        if held > HEAD:
            break
        least = g
    if least is None:
        return []
    return sorted(short.where(grade >= least).collect(), key=lambda r: (-r["n"], bytes(r["token"])))


def fit_model(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> LanguageModel:
    """Count the words of all training documents, then fit the recurrent weights on the same documents.

    Documents whose crc32 of the key falls on ``held`` are never read. An empty table
    gives a model without words.
    """
    training = docs.where(bucket_of(key, folds) != held)
    counts = cut(word_counts(training, text))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    head = frequent_words(counts)
    vocabulary = Vocabulary([bytes(r["token"]) for r in head], np.array([r["n"] for r in head], np.int64), total, distinct)
    weights = start_weights(vocabulary)
    shards = max(1, round(total / ROUNDS / SHARD_TOKENS))
    turn = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("share")), F.lit(ROUNDS))
    for part in range(ROUNDS):
        weights = _average(training.where(turn == part), vocabulary, weights, text, shards)
    return LanguageModel(vocabulary, weights, counts)


def _rare_words(words: pa.Array, found: np.ndarray, many: np.ndarray, end: int) -> pa.MapArray:
    """Each text's words without a place, and how often they occur in it."""
    rare, row = words.filter(pa.array(found < 0)), np.repeat(np.arange(len(many)), many)[found < 0]
    if end < 0:
        rare, row = pa.concat_arrays([rare, pa.array([END] * len(many), pa.binary())]), np.append(row, np.arange(len(many)))
    coded = rare.dictionary_encode()
    pairs, times = np.unique(row * len(rare) + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(pairs, max(len(rare), 1))
    edges = np.searchsorted(row, np.arange(len(many) + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(edges), coded.dictionary.take(pa.array(code)), pa.array(times, pa.int32()))


def score_documents(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is the add-one unigram log10 probability, score that of the recurrent
    model, both over the whole text and its end. A word outside the model's words has
    the chance of "any other", times its share by add-one counts among those.

    Words whose counts a task does not hold are sent to the table of counts by word,
    added up per document before and after. A null text is empty and has its end as its
    only token; repeated rows are scored each; an empty table gives no row.
    """
    v = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((v, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        logs, to_model = np.append(vocabulary.logs, 0.0), np.append(vocabulary.model, vocabulary.other)
        for batch in batches:
            for first, rows in block_sizes(batch, 2048, BLOCK_BYTES):
                part = batch.slice(first, rows)
                words, many = split_words(part.column(2))
                found = vocabulary.places(words)
                at = with_ends(found, many, vocabulary.end_place)
                ids = to_model[at]
                edges = np.cumsum(many + 1)
                begins, rare, other = edges - many - 1, at < 0, ids == vocabulary.other
                columns = [
                    many + 1,
                    np.add.reduceat(~rare, begins, dtype=np.int64),
                    np.add.reduceat(logs[at], begins),
                    np.add.reduceat(other, begins, dtype=np.int64),
                    np.add.reduceat(np.where(other, logs[at], 0.0), begins),
                    score_texts(weights, vocabulary, np.split(ids, edges[:-1])),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c) for c in columns), _rare_words(words, found, many, vocabulary.end_place)],
                    names=["uid", key, "n_tokens", "known", "logs", "others", "other_logs", "model", "rare"],
                )

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.monotonically_increasing_id().alias("uid"), key, text)
    schema = (
        f"uid long, `{key}` {kind}, n_tokens long, known long, logs double, others long, other_logs double, model double,"
        " rare map<binary,int>"
    )
    facts = cut(named.mapInArrow(run, schema))
    rare = facts.select("uid", F.explode("rare").alias("token", "times"))
    met = (
        rare.join(model.counts, "token")
        .groupBy("uid")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    )
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    base = F.col("logs") + more_logs - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1))
    other = F.col("other_logs") + more_logs - F.col("others") * float(np.log10(max(v.other_total, 1)))
    return facts.drop("rare").join(met, "uid", "left").select(
        key,
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model") + other).alias("score"),
    )
