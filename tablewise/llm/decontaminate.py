"""Benchmark decontamination by a generalised suffix automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import cut, map_rows, positional

# Words of one automaton. Larger benchmarks are scanned in blocks of whole items, one
# automaton after the other, so what a task holds stays bounded.
BLOCK_WORDS = 1_000_000

# Bytes of a word after lower-casing A-Z stay, all others become spaces.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


class SuffixAutomaton:
    """All word sequences of all items; a sequence never runs from one item into the next."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in texts:
            last = 0
            for word in ids:
                last = self._add(last, word)
        # Windows: for each state that holds one of ``size`` words, the items it is from.
        self.whole: list[dict[int, set]] = [{} for _ in self.moves]
        for name, ids in texts:
            size = min(window, len(ids))
            state, matched = 0, 0
            for word in ids:
                state, matched = self.step(state, matched, word)
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= size:
                    self.whole[state].setdefault(size, set()).add(name)
                    matched = max(matched, size)
        order = sorted(range(1, len(self.moves)), key=self.length.__getitem__)
        # Windows that end where a state's words end, its own and those of its suffixes.
        self.ends: list[dict[int, set]] = [{} for _ in self.moves]
        for state in order:
            above = self.ends[self.link[state]]
            self.ends[state] = {**above, **self.whole[state]} if self.whole[state] else above

    def _add(self, last: int, word: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        there = moves[last].get(word)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, at = len(moves) - 1, last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = new
            at = link[at]
        if at >= 0:
            there = moves[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        """The part of ``there`` that is no longer than ``at`` and one word, as its own state."""
        self.moves.append(dict(self.moves[there]))
        self.link.append(self.link[there])
        self.length.append(self.length[at] + 1)
        part = len(self.moves) - 1
        self.link[there] = part
        while at >= 0 and self.moves[at].get(word) == there:
            self.moves[at][word] = part
            at = self.link[at]
        return part

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        moves = self.moves
        while word not in moves[state]:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return moves[state][word], matched + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans (start, end) covered by windows, and the items those are from."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        moves, link, length, ends = self.moves, self.link, self.length, self.ends
        get = self.vocabulary.get
        state = matched = 0
        for at, word in enumerate(map(get, words)):
            if word is None:
                state = matched = 0
                continue
            nexts = moves[state].get(word)
            while nexts is None and state:
                state = link[state]
                matched = length[state]
                nexts = moves[state].get(word)
            if nexts is None:
                matched = 0
                continue
            state = nexts
            matched += 1
            here = ends[state]
            if here:
                longest = 0
                for size, names in here.items():
                    if size <= matched:
                        items |= names
                        longest = max(longest, size)
                if longest:
                    start, end = at + 1 - longest, at + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))
        return spans, items


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of at most ``limit`` bytes of text, one block at a time; a longer item is alone."""
    block: list[tuple[str | None, bytes]] = []
    held = 0
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    for row in rows.where(F.col("text").isNotNull()).toLocalIterator():
        size = len(row["text"])
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row["item"], bytes(row["text"])))
        held += size
    yield block


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    parts: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    with_text: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """key, n_words, n_hit, spans, items, contaminated[, text][, extra] for every row of ``docs``.

    The words of a document run through the automaton, which keeps the longest match
    that ends at each word. A word is hit when a window of ``window`` item words (a
    shorter item whole) covers it; ``spans`` are the hit runs as (start, end) word
    numbers, ``items`` the sorted ids of items with a window in the document.
    ``contaminated``: some word is hit, and the hit words are at least one in ``parts``.

    A null or empty text has no words. Items without words match nothing; repeated item
    ids count once, a null item id marks hits without being listed. Repeated rows are
    scanned each, an empty table gives no row, an empty benchmark no hit. Documents are
    not shuffled. The benchmark is a stated query set: it is read in blocks of about
    ``block_words`` words, each scanned against all documents.
    """
    spark = docs.sparkSession
    names = [key, text]
    found = [
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
    ]
    out = docs.select(key, text, *found, *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    blocks = _blocks(benchmark, item, item_text, block_words * 6)
    block = next(blocks)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        block = next(blocks, None)
        last = block is None
        keeps_text = with_text or not last

        def make(shared=shared, keeps_text=keeps_text):
            automaton = SuffixAutomaton([(name, words_of(body)) for name, body in shared.value], window)

            def run(rows):
                for doc, body, spans, items, _, *more in rows:
                    words = words_of(body)
                    found, named = automaton.scan(words)
                    if spans:
                        found = merge_spans([(s["start"], s["end"]) for s in spans] + found)
                    named = sorted({*items, *(n for n in named if n is not None)})
                    yield doc, (body if body is None else body.decode()) if keeps_text else None, [
                        {"start": a, "end": b} for a, b in found
                    ], named, len(words), *more

            return run

        out = map_rows(out, make, fields, (text,))
        if not last:
            out = cut(out)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.withColumn("n_hit", hit)
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(parts) * F.col("n_hit") >= F.col("n_words")))
    return out.select(key, *([text] if with_text else []), "n_words", "n_hit", "spans", "items", "contaminated", *extra)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def remove_spans(
    scanned: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 50, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(key, text, removed, extra) of a scan with its text.

    A hit run goes where the document is contaminated or where the run is longer than
    ``longest`` words; what stood around it is joined by one space. ``removed`` counts
    the words taken out. Texts without such runs, null and empty ones included, stay as
    they are.
    """

    def make():
        def run(rows):
            for doc, body, spans, contaminated, *more in rows:
                going = [(s["start"], s["end"]) for s in spans if contaminated or s["end"] - s["start"] > longest]
                removed = sum(b - a for a, b in going)
                if going:
                    places = [m.span() for m in WORD.finditer(body.translate(WORD_TABLE))]
                    parts, at = [], 0
                    for start, end in going:
                        parts.append(body[at : places[start][0]].rstrip())
                        at = places[end - 1][1]
                    parts.append(body[at:].lstrip())
                    body = b" ".join(p for p in parts if p)
                yield doc, body if body is None else body.decode(), removed, *more

        return run

    chosen = scanned.select(key, text, "spans", "contaminated", *extra)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    return map_rows(chosen, make, ", ".join([*fields[:2], "removed int", *fields[4:]]), (text,))


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", longest: int | None = None, **options
) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns as they were.

    With ``longest`` the rows kept also lose their hit runs of more than so many words, so
    that a long text does not carry a benchmark passage through.
    """
    plain, names = positional(docs)
    others = tuple(c for c in plain.columns if c not in (names[key], names[text]))
    found = scan_documents(plain, benchmark, key=names[key], text=names[text], extra=others, with_text=True, **options)
    kept = found.where("NOT contaminated")
    if longest is not None:
        kept = remove_spans(kept, names[key], names[text], longest, others)
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])
