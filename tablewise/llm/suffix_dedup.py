"""Repeated byte strings by column-wise construction of collection BWTs and common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import cut, positional

# Length of the hashed strings whose smallest decides where a window belongs.
GRAM = 32
# Bytes hashed at a time; the low bits of a hash make room for a position in them.
CHUNK = 1 << 17
# A run is looked at in this many parts before its windows are sorted.
PARTS = 4
PLACE_BITS = 18
# Bytes of one collection (whole groups; a group may be larger), and of one shuffle bucket.
COLLECTION = 1 << 17
BUCKET = 4 << 20
# A gram with more distinct runs than this is split: its windows are counted one by one.
HOT_RUNS = 5_000
BLOCK_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, size = 0xD6E8FEB86659FD93, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIER
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of ``length`` bytes that share their least gram: (text, start, windows, gram, lead).

    ``lead`` is how far behind ``start`` the gram stands.

    A window belongs to the leftmost of its least grams, which its bytes alone decide.
    Equal windows therefore meet under equal grams, and no two windows of a run are equal.
    """
    width = length - GRAM + 1
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            piece = text[at : at + CHUNK + length - 1]
            if held and size + len(piece) > CHUNK + length - 1:
                yield _runs(held, length, width)
                held, size = [], 0
            held.append((number, at, piece))
            size += len(piece)
            at += CHUNK
    if held:
        yield _runs(held, length, width)


def _runs(held: list[tuple[int, int, bytes]], length: int, width: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    begins = np.cumsum(sizes) - sizes
    grams = gram_hashes(data)
    keyed = (grams & ~_PLACES) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(keyed, width) & _PLACES).astype(np.int64)
    # Windows that reach over the end of their text are no windows.
    inside = np.ones(len(place) + 1, bool)
    for begin, size in zip(begins[1:], sizes):
        inside[max(begin - length + 1, 0) : begin] = False
    inside[len(place)] = False
    first = inside[:-1].copy()
    first[1:] &= (place[1:] != place[:-1]) | ~inside[:-2]
    starts = np.flatnonzero(first)
    breaks = np.flatnonzero(first | ~inside[:-1])
    ends = np.append(breaks, len(place))[np.searchsorted(breaks, starts, side="right")]
    piece = np.searchsorted(begins, starts, side="right") - 1
    numbers = np.array([n for n, _, _ in held])[piece]
    offsets = np.array([a for _, a, _ in held])[piece] - begins[piece] + starts
    return numbers, offsets, ends - starts, grams[place[starts]].view(np.int64), place[starts] - starts


class Collection:
    """BWT and common prefixes of a collection of byte strings, built one symbol per string a round.

    In round r every string that is long enough gives its r-th symbol from the end. The
    symbol goes to where the string's last suffix stands; the order of all symbols is
    then the order of the suffixes that begin with them, which places the suffixes of
    the next round. That order is kept from round to round: old symbols move behind the
    new ones before them, and each new one is looked up among its equals. A new suffix shares with its neighbour one byte more than their
    remainders do, the least common prefix between those. Common prefixes are cut
    at ``bound``. UTF-8 leaves the highest bytes unused, so a symbol is a byte plus one
    and zero marks the start of a string.
    """

    def __init__(self, strings: list[bytes], bound: int) -> None:
        count = len(strings)
        sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        ends = np.cumsum(sizes)
        bwt = data[ends - 1]
        common = np.zeros(count, np.uint8)
        # Places of all symbols but string starts by symbol, where each symbol begins there,
        # and the rank there of the last symbol of each active string, rising.
        order = np.argsort(bwt, kind="stable")
        begins = np.searchsorted(bwt[order], np.arange(257))
        active, ranks = order, np.arange(count)
        done = 1
        top = np.uint8(bound)
        while len(active):
            fresh = count + ranks
            # Common prefixes of the new suffixes and of those right behind them.
            asked = np.stack([ranks, ranks + 1], axis=1).ravel()
            asked = asked[np.append(asked[1:] > asked[:-1], asked[-1] < len(order))]
            below, here = order[asked - 1], order[asked]
            same = (asked > 0) & (bwt[below] == bwt[here])
            values = np.zeros(len(asked), np.uint8)
            if same.any():
                spots = np.flatnonzero(same)
                spots = spots[np.argsort(below[spots], kind="stable")]
                bounds = np.empty(2 * len(spots), np.int64)
                bounds[0::2], bounds[1::2] = below[spots] + 1, here[spots] + 1
                least = np.minimum.reduceat(np.append(common, np.uint8(0)), bounds)[0::2]
                values[spots] = np.minimum(least, top - np.uint8(1)) + np.uint8(1)
            total = count + len(order)
            old = np.ones(total, bool)
            old[fresh] = False
            longer = np.empty(total, np.uint8)
            longer[old] = common
            longer[count + asked] = values
            left = sizes[active] - done
            symbols = np.where(left > 0, data[np.maximum(ends[active] - 1 - done, 0)], 0).astype(np.uint8)
            grown = np.empty(total, np.uint8)
            grown[old] = bwt
            grown[fresh] = symbols
            bwt, common = grown, longer
            going = np.flatnonzero(left > 0)
            going = going[np.lexsort((fresh[going], symbols[going]))]
            active, fresh, symbols = active[going], fresh[going], symbols[going]
            order = np.flatnonzero(old)[order]
            met = np.bincount(symbols, minlength=256)
            ranks = np.arange(len(active))
            at = 0
            for c in np.flatnonzero(met).tolist():
                low, high, to = begins[c], begins[c + 1], at + met[c]
                ranks[at:to] += low + order[low:high].searchsorted(fresh[at:to])
                at = to
            begins[1:] += np.cumsum(met)
            kept = np.ones(len(order) + len(ranks), bool)
            kept[ranks] = False
            wider = np.empty(len(kept), np.int64)
            wider[kept] = order
            wider[ranks] = fresh
            order = wider
            done += 1
        self.count, self.sizes, self.bound = count, sizes, bound
        self.bwt, self.common = bwt, common

    def repeated(self) -> list[np.ndarray]:
        """For each string, whether the ``bound`` bytes at each start occur at another place."""
        order = np.argsort(self.bwt, kind="stable")[np.count_nonzero(self.bwt == 0) :]
        back = np.empty(len(self.bwt), np.int64)
        back[order] = self.count + np.arange(len(order))
        full = self.common >= self.bound
        twice = full.copy()
        twice[:-1] |= full[1:]
        begins = np.cumsum(self.sizes) - self.sizes
        marks = np.zeros(int(self.sizes.sum()), bool)
        place = np.arange(self.count)
        active = np.arange(self.count)
        for step in range(int(self.sizes.max(initial=0))):
            place = back[place]
            marks[begins[active] + self.sizes[active] - 1 - step] = twice[place]
            going = self.sizes[active] > step + 1
            place, active = place[going], active[going]
        return [marks[b : b + max(s - self.bound + 1, 0)] for b, s in zip(begins, self.sizes)]


def shared_ranges(string: bytes, windows: int, lead: int, length: int) -> Iterator[tuple[int, int, tuple]]:
    """Ranges (first, end) of the windows of a run, with bytes that every window of the range holds.

    Equal windows have the gram at the same offset, so they fall into the same range
    and agree in all of these bytes.
    """
    step = (length - GRAM) // PARTS + 1
    for part in range((lead - windows + 1) // step, lead // step + 1):
        low, high = part * step, (part + 1) * step - 1
        first, end = max(lead - high, 0), min(lead - low + 1, windows)
        yield first, end, (part, string[max(lead - low, 0) : lead - high + length])


def mark_groups(grams: list[int], strings: list[bytes], leads: list[int], length: int) -> list[np.ndarray]:
    """Repeated windows of each string, for the distinct strings of runs sorted by gram.

    Ranges of windows that no other string of the group can match are left out, and
    what is left goes into collections of whole groups, of about COLLECTION bytes.
    Groups go by their longest string, since that decides the rounds of a collection.
    """
    marks = [np.zeros(len(s) - length + 1, bool) for s in strings]
    opened: list[list[tuple[int, int, bytes]]] = []
    at = 0
    while at < len(grams):
        group: list[tuple[int, int, bytes]] = []
        end = at
        while end < len(grams) and grams[end] == grams[at]:
            end += 1
        seen: dict[tuple, int] = {}
        for k in range(at, end):
            for _, _, held in shared_ranges(strings[k], len(marks[k]), leads[k], length):
                seen[held] = seen.get(held, 0) + 1
        for k in range(at, end):
            open_from = -1
            last = -1
            ranges = [(a, b) for a, b, held in shared_ranges(strings[k], len(marks[k]), leads[k], length) if seen[held] > 1]
            for first, stop in sorted(ranges):
                if open_from >= 0 and first == last:
                    last = stop
                    continue
                if open_from >= 0:
                    group.append((k, open_from, strings[k][open_from : last + length - 1]))
                open_from, last = first, stop
            if open_from >= 0:
                group.append((k, open_from, strings[k][open_from : last + length - 1]))
        if group:
            opened.append(group)
        at = end
    opened.sort(key=lambda group: max(len(w[2]) for w in group))
    waiting: list[tuple[int, int, bytes]] = []
    size = 0
    for n, group in enumerate(opened, 1):
        waiting += group
        size += sum(len(w[2]) for w in group)
        if size >= COLLECTION or n == len(opened):
            for (number, first, _), found in zip(waiting, Collection([w[2] for w in waiting], length).repeated()):
                marks[number][first : first + len(found)] |= found
            waiting, size = [], 0
    return marks


def _blocks(batches: Iterator[pa.RecordBatch], body: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their unpacked texts, in blocks of about BLOCK_BYTES."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at, size, texts = 0, 0, []
        for packed in batch.column(body):
            texts.append(unpack(packed.as_py()))
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = at + len(texts), 0, []
        if texts:
            yield batch.slice(at, len(texts)), texts


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """The documents with a number ``uid`` and their UTF-8 bytes packed in ``body``; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            bodies = [pack(t or b"") for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=[*batch.schema.names[:-1], "body"])

    others = [F.col(c) for c in docs.columns if c != text] or [F.lit(True).alias("none")]
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*others).alias("row"), F.col(text).alias("body"))
    kind = named.schema["row"].dataType.simpleString()
    return cut(named.mapInArrow(run, f"uid long, row {kind}, body binary"))


def _repeated_grams(packed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches, 0):
            found = [r[3] for r in runs(texts, length)]
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counts = packed.select("body").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return cut(counts.where("n > 1").select("gram"))


def _all_runs(packed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for rows, texts in _blocks(batches, 1):
            uids = rows.column(0).to_numpy()
            for numbers, starts, windows, grams, leads in runs(texts, length):
                ends = starts + windows + length - 1
                held = [digest(texts[n][a:b]) for n, a, b in zip(numbers.tolist(), starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams),
                        pa.array(np.array(held, np.uint64).view(np.int64)),
                        pa.array(uids[numbers]),
                        pa.array(starts.astype(np.int32)),
                        pa.array(windows.astype(np.int16)),
                        pa.array(leads.astype(np.int16)),
                    ],
                    names=["gram", "content", "uid", "start", "windows", "lead"],
                )

    return packed.select("uid", "body").mapInArrow(run, "gram long, content long, uid long, start int, windows smallint, lead smallint")


def _bytes_of(runs_wanted: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """(gram, content, lead, piece): the bytes of the given runs, one occurrence of each."""
    per_text = runs_wanted.groupBy("uid").agg(F.collect_list(F.struct("gram", "content", "start", "windows", "lead")).alias("wanted"))
    met = per_text.join(packed.select("uid", "body"), "uid").select("wanted", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, 1):
            out = []
            for wanted, text in zip(rows.column(0).to_pylist(), texts):
                out += [
                    (w["gram"], w["content"], w["lead"], text[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted
                ]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int16()), pa.array(columns[3], pa.binary())],
                names=["gram", "content", "lead", "piece"],
            )

    return met.mapInArrow(run, "gram long, content long, lead smallint, piece binary")


_RANGES = "gram long, content long, first int, end int"


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def _sorted_ranges(pieces: DataFrame, buckets: int, length: int) -> DataFrame:
    """Repeated windows of the pieces, from the sorted collections of their bucket."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gram", "content"])
        marks = mark_groups(pdf["gram"].tolist(), pdf["piece"].tolist(), pdf["lead"].tolist(), length)
        rows = [(g, c, a, b) for g, c, m in zip(pdf["gram"], pdf["content"], marks) for a, b in _ranges(m)]
        return pd.DataFrame(rows, columns=["gram", "content", "first", "end"]).astype({"gram": "int64", "content": "int64", "first": "int32", "end": "int32"})

    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandas(mark, _RANGES)


def _counted_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """The same for the pieces of hot grams: equal windows are counted by 128-bit digest, with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for row in batch.to_pylist():
                piece = row["piece"]
                many = len(piece) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digest(piece[k : k + length]) for k in range(many)], pa.binary()),
                        pa.array(np.full(many, row["gram"])),
                        pa.array(np.full(many, row["content"])),
                        pa.array(np.arange(many, dtype=np.int32)),
                    ],
                    names=["window", "gram", "content", "first"],
                )

    windows = cut(pieces.select("gram", "content", "piece").mapInArrow(run, "window binary, gram long, content long, first int"))
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window", "left_semi").select("gram", "content", "first", (F.col("first") + 1).alias("end"))


def repeated_spans(
    docs: DataFrame, length: int = 200, text: str = "text", hot_runs: int = HOT_RUNS, as_text: bool = False
) -> DataFrame:
    """Every row of ``docs`` as (row, n_bytes, spans, kept).

    ``spans`` are the maximal runs of bytes (start, end) that lie in a string of
    ``length`` bytes which also starts elsewhere, in this or another row; ``kept`` are
    the other bytes (with ``as_text`` a text, without characters that were cut in
    two), ``row`` holds the other columns. Strings never cross rows. A null
    text is empty, repeated rows repeat each other, an empty table gives no row.

    Each window of ``length`` bytes belongs to its least gram, so equal windows meet
    under one gram, and consecutive windows of a gram travel together as a run. Runs
    of grams that occur once are dropped; equal runs are added up before anything is
    compared, and all their windows are repeated. Different runs of a gram are sorted:
    their bytes, one occurrence of each, go to a bucket whose collections get their BWT
    and common prefixes column by column (``Collection``). Runs are short, so that takes
    a few hundred rounds whatever the length of the documents. A gram with more than
    ``hot_runs`` different runs is not kept in one task: its windows are counted.
    """
    packed = _packed(docs, text)
    grams = _repeated_grams(packed, length)
    found = cut(_all_runs(packed, length).join(grams, "gram", "left_semi"))
    distinct = cut(
        found.groupBy("gram", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "start", "windows", "lead")).alias("one")
        )
    )
    groups = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    wanted = cut(distinct.join(groups, "gram").select("gram", "content", "one.*", (F.col("members") > hot_runs).alias("hot")))
    volume = {r["hot"]: r["b"] for r in wanted.groupBy("hot").agg(F.sum(F.col("windows") + length).alias("b")).collect()}
    ranges = distinct.where("n > 1").select("gram", "content", F.lit(0).alias("first"), F.col("one.windows").cast("int").alias("end"))
    if volume.get(False):
        buckets = volume[False] // BUCKET + 1
        ranges = ranges.unionByName(_sorted_ranges(_bytes_of(wanted.where("NOT hot"), packed, length), buckets, length))
    if volume.get(True):
        ranges = ranges.unionByName(_counted_ranges(_bytes_of(wanted.where("hot"), packed, length), length))
    spans = (
        found.join(ranges, ["gram", "content"])
        .select("uid", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("end") + (length - 1)).alias("end")).alias("span"))
        .groupBy("uid")
        .agg(F.collect_list("span").alias("spans"))
    )
    joined = packed.join(spans, "uid", "left").select("row", "spans", "body")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, 2):
            out = []
            for spans, body in zip(rows.column(1).to_pylist(), texts):
                merged: list[list[int]] = []
                for span in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                edges = [0, *(e for m in merged for e in m), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                out.append((len(body), [{"start": a, "end": b} for a, b in merged], kept.decode("utf-8", "ignore") if as_text else kept))
            columns = list(zip(*out))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.string() if as_text else pa.binary())],
                names=["row", "n_bytes", "spans", "kept"],
            )

    row = packed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(finish, f"row {row}, n_bytes long, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame, length: int = 200, text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; characters cut in two go as a whole."""
    plain, names = positional(docs)
    found = repeated_spans(plain, length, names[text], as_text=True, **options)
    return found.select(*[(F.col("kept") if old == text else F.col("row").getField(new)).alias(old) for old, new in names.items()])
