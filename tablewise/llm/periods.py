"""Periodic runs of words: union of suffix classes by falling common prefix."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import map_rows

# Bytes of text that are worked on at a time (whole texts; a longer one goes alone).
BLOCK_BYTES = 2 << 20

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def least_prefix(least: int, copies: int) -> int:
    """Smallest common prefix of two suffixes that start one period apart in a run."""
    return min(max((copies - 1) * q, least - q) for q in range(1, least + 1))


def maybe_repeated(words: np.ndarray, text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Places whose next ``size`` words may occur again in their text: equal hashes, so none is missed."""
    h = words.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < size:
        if len(h) <= step:
            return np.zeros(0, np.int64)
        h = h[:-step] * np.uint64(pow(_ODD[0], step, 1 << 64)) + h[step:]
        step *= 2
    places = np.flatnonzero(np.arange(len(h)) + size <= ends[text[: len(h)]])
    h = (h[places] ^ (h[places] >> np.uint64(31))) * np.uint64(_ODD[1]) + text[places].astype(np.uint64) * np.uint64(_ODD[2])
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return places[twice[spot] == h]


class SuffixOrder:
    """Sorted suffixes of the places whose next ``size`` words (a power of two) occur twice in their text.

    Ranks of the first 1, 2, 4, ... words come from the ranks of their halves. Only places
    in reach of a candidate take part, and a place leaves once its rank is its own. Words
    behind the end of a text rank lowest. Ranks of all lengths are kept: two suffixes share
    as many words as the binary digits their equal ranks add up to.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, ends: np.ndarray, size: int) -> None:
        n = len(words)
        candidates = maybe_repeated(words, text, ends, size)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, candidates, 1)
        np.add.at(edges, np.minimum(candidates + 2 * size, ends[text[candidates]]), -1)
        left = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        # Places outside have ranks of their own, below all others.
        rank = -1 - np.arange(n, dtype=np.int64)
        rank[left] = 1
        self.levels: list[np.ndarray] = []
        self.places = np.zeros(0, np.int64)
        keys = (text[left].astype(np.int64) << 32) | words[left]
        reach = 1
        while len(left):
            order = np.argsort(keys, kind="stable")
            keys, old = keys[order], rank[left[order]]
            begins = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1) | np.diff(old, prepend=old[0] - 1))
            whole = np.flatnonzero(np.diff(old, prepend=old[0] - 1))
            sizes = np.diff(np.append(begins, len(keys)))
            first = np.repeat(begins, sizes)
            rank[left[order]] = old + first - np.repeat(whole, np.diff(np.append(whole, len(keys))))
            self.levels.append(rank.astype(np.int32))
            left = left[order[np.repeat(sizes, sizes) > 1]]
            if reach == size:
                self.places = left
            reached = np.minimum(left + reach, n - 1)
            after = np.where(left + reach < ends[text[left]], rank[reached], 0)
            keys = (rank[left] << 32) + after
            reach *= 2
        self.places = self.places[np.argsort(rank[self.places], kind="stable")]

    def common(self) -> np.ndarray:
        """Words that each of the sorted suffixes shares with the next one."""
        x, y = self.places[:-1].copy(), self.places[1:].copy()
        shared = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            ranks = self.levels[level]
            inside = (x < len(ranks)) & (y < len(ranks))
            same = inside & (ranks[np.where(inside, x, 0)] == ranks[np.where(inside, y, 0)])
            step = same.astype(np.int64) << level
            shared, x, y = shared + step, x + step, y + step
        return shared


def united_seeds(places: list[int], common: np.ndarray, least: int, copies: int) -> list[tuple[int, int, int]]:
    """(place, period, shared): neighbours that become adjacent when their classes are united.

    Classes of suffixes are united by falling common prefix. Each class is an ordered
    list of places, the smaller one is put into the larger one place by place. The two
    suffixes of a newly adjacent pair share exactly as many words as the edge that
    united them, and no place of the class lies between them, so their distance is the
    smallest period of what they span.
    """
    bound = least_prefix(least, copies)
    parent = list(range(len(places)))
    sets: list[list[int]] = [[p] for p in places]
    seeds: list[tuple[int, int, int]] = []
    times = copies - 1

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = np.flatnonzero(common >= bound)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    for edge, shared in zip(edges.tolist(), common[edges].tolist()):
        a, b = find(edge), find(edge + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, []
        reach = shared // times
        before = -1
        for k, place in enumerate(small):
            at = bisect_left(large, place)
            if at and large[at - 1] != before:
                gap = place - large[at - 1]
                if gap <= reach and shared + gap >= least:
                    seeds.append((large[at - 1], gap, shared))
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                gap = large[at] - place
                if gap <= reach and shared + gap >= least:
                    seeds.append((place, gap, shared))
            insort(large, place, at, at)
            before = place
    return seeds


def runs_of(words: np.ndarray, text: np.ndarray, ends: np.ndarray, least: int, copies: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in texts laid end to end; starts count from the first text.

    ``words`` are numbers, ``text`` is the number of each word's text, ``ends`` the place behind each text.
    """
    size = 1 << (least_prefix(least, copies).bit_length() - 1)
    if len(words) < least:
        return []
    suffixes = SuffixOrder(words, text, ends, size)
    if not len(suffixes.places):
        return []
    found = []
    for place, period, shared in united_seeds(suffixes.places.tolist(), suffixes.common(), least, copies):
        # The run starts here unless the word before continues the period.
        alone = place == 0 or text[place - 1] != text[place] or words[place - 1] != words[place - 1 + period]
        if alone:
            found.append((place, shared + period, period))
    return sorted((start, length, period) for start, length, period in found)


class _Numbers(dict):
    """Numbers of words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, copies: int = 3) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    Words are separated by ASCII white space. A run is a stretch of consecutive words
    with smallest period q that no neighbouring word extends and that has at least
    ``least`` words and ``copies`` periods (2 or more). ``runs`` holds (start, length,
    period) by start, then period; starts count words from 0. ``collapsed`` is the text
    without the words that any run holds after its first period, the others joined by
    one blank.

    A null or empty text has no words, no runs and an empty collapsed text. Repeated rows
    and null keys are treated like any other row, an empty table gives no row, other
    columns are ignored. Texts are worked on whole and never split: a text needs about 100
    bytes of memory a word for each doubling of its longest repeat, in one task. Rows are
    not shuffled.
    """
    if least < 1 or copies < 2:
        raise ValueError("a run has at least one word and two periods")
    chosen = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))

    def make():
        def block(rows):
            numbers = _Numbers()
            texts = [(body or b"").split() for _, body in rows]
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            words = np.array([numbers[w] for t in texts for w in t], np.int64)
            owner = np.repeat(np.arange(len(texts)), sizes)
            of_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, period in runs_of(words, owner, ends, least, copies):
                k = int(owner[start])
                of_text[k].append((start - int(ends[k] - sizes[k]), length, period))
            for (name, _), held, runs in zip(rows, texts, of_text):
                kept = held
                if runs:
                    edges = np.zeros(len(held) + 1, np.int64)
                    for start, length, period in runs:
                        edges[start + period] += 1
                        edges[start + length] -= 1
                    kept = [held[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                shown = [{"start": s, "length": n, "period": q} for s, n, q in runs]
                yield name, len(held), shown, b" ".join(kept).decode()

        return block

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(chosen, make, schema, ("_body",), most=BLOCK_BYTES)
