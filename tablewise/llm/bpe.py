"""BPE as a deterministic automaton made of merge gadgets."""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import map_rows

# Words and arcs that a task keeps; words in two generations of half as many.
WORDS_KEPT = 200_000
PAIRS_KEPT = 300_000
LONG_WORD = 48


class MergeAutomaton:
    """Tokens as labelled arcs; what may follow a token is the state it leads to.

    All arcs of one label lead to one state, so the state after a token bears its name.
    A gadget for the merge (u, v) does three things: the state after u loses its arc v,
    every state with an arc u gets an arc uv, and uv leads to a copy of the state after
    v. A merge whose arcs never meet makes no label. Copies and additions are not written out: each label keeps the time of its
    gadget, and ``arc`` follows a copied or added arc back to where it came from. A
    sequence of tokens is the encoding of a word iff each token has an arc in the state
    of the one before.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        size = max(vocab.values(), default=-1) + 1
        self.labels = [""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        self.time = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()
        self.start: dict = {}
        self.seen: dict[int, bool] = {}
        made = {a + b for a, b in merges}
        for label, i in vocab.items():
            if label not in made:
                self._extend(label, i)
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        alive = u not in self.dead and v not in self.dead and self.arc(u, v, time)
        self.time[uv], self.parts[uv] = time, (u, v)
        if not alive:
            self.dead.add(uv)
        else:
            self.lost[u, v] = time
            self._extend(self.labels[uv], uv)

    def _extend(self, label: str, i: int) -> None:
        """Add the label to the table of symbols; the last symbol of a word has its mark."""
        node = self.start
        for symbol in symbols_of_label(label):
            node = node.setdefault(symbol, {})
        node[0] = i

    def arc(self, after: int, label: int, time: int) -> bool:
        """Whether the state after ``after`` has an arc ``label`` once the gadgets before ``time`` are in."""
        while True:
            if self.lost.get((after, label), time) < time:
                return False
            made_after, made_label = self.time[after], self.time[label]
            if made_after < 0 and made_label < 0:
                return True
            if made_after > made_label:
                after, time = self.parts[after][1], made_after
            else:
                label, time = self.parts[label][0], made_label + 1

    def follows(self, after: int, label: int) -> bool:
        pair = after << 24 | label
        found = self.seen.get(pair)
        if found is None:
            if len(self.seen) >= PAIRS_KEPT:
                self.seen.clear()
            found = self.seen[pair] = self.arc(after, label, 1 << 60)
        return found

    def _labels_from(self, symbols: list[str], at: int) -> list[tuple[int, int]]:
        """Labels that spell the symbols from ``at`` on, with their ends, shortest first."""
        node, found = self.start, []
        for to in range(at, len(symbols)):
            node = node.get(symbols[to])
            if node is None:
                break
            label = node.get(0)
            if label is not None:
                found.append((label, to + 1))
        return found

    def encode(self, symbols: list[str]) -> list[int]:
        """Labels of the only path over ``symbols``.

        The longest label is tried first. Each prefix has one encoding, so a place from
        which no path leads on is left for good, and no place is tried twice.
        """
        size = len(symbols)
        out: list[int] = []
        ends = [0]
        open_labels = [self._labels_from(symbols, 0)] if size else []
        closed = bytearray(size + 1)
        while open_labels:
            state = out[-1] if out else -1
            labels = open_labels[-1]
            while labels:
                label, end = labels.pop()
                if not closed[end] and (state < 0 or self.follows(state, label)):
                    out.append(label)
                    if end == size:
                        return out
                    ends.append(end)
                    open_labels.append(self._labels_from(symbols, end))
                    break
            else:
                open_labels.pop()
                closed[ends.pop()] = 1
                if out:
                    out.pop()
        return out


def symbols_of_label(label: str, end: str = "</w>") -> list[str]:
    if label.endswith(end) and len(label) > len(end):
        body = list(label[: -len(end)])
        body[-1] += end
        return body
    return list(label)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in printable}
    for at, b in enumerate(x for x in range(256) if x not in signs):
        signs[b] = chr(256 + at)
    return [signs[b] for b in range(256)]


class WordTokenizer:
    """A word-level BPE file: added tokens, lower-casing, word split, byte symbols, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = dict(enumerate(self.automaton.labels))
        self.names.update({i: t for t, i in self.added.items()})
        self.split_added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Same split for texts of Latin letters and ASCII alone, where these classes agree.
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.other = re.compile("[^\t\n\r\x20-\x7eÀ-ɏ]")
        self.signs = byte_symbols()
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        if not self.other.search(text):
            return self.plain.findall(text.lower())
        lowered = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return self.split.findall(lowered)

    def word(self, word: str) -> list[int]:
        """Ids of a word that is not in the younger generation of kept words."""
        found = self.older.get(word)
        if found is None:
            symbols = [self.signs[b] for b in word.encode()]
            symbols[-1] += self.end
            found = self.automaton.encode(symbols)
        if len(word) <= LONG_WORD:
            if len(self.kept) >= WORDS_KEPT // 2:
                self.older, self.kept = self.kept, {}
            self.kept[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part in self.split_added.split(text or ""):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word in self.words(part):
                    ids += self.kept.get(word) or self.word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


def _file(spark, path: str) -> str:
    """Hand the tokenizer file to the executors."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def bpe_encode(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    extra: tuple[str, ...] = (),
    decoded: bool = False,
) -> DataFrame:
    """(key, ids, extra) of every row, ``ids`` as array of int; with ``decoded`` also the text read back from them.

    ``path`` is a local file of the driver that goes to every executor. A null or empty
    text gives an empty array; repeated rows, null keys and texts of any length are
    encoded alike, and an empty table gives no row. Rows are not shuffled. A task
    keeps the ids of at most WORDS_KEPT words.
    """
    from pyspark import SparkFiles

    name = _file(docs.sparkSession, path)
    chosen = docs.select(key, F.col(text).alias("_body"), *extra)

    def make():
        tokenizer = WordTokenizer(SparkFiles.get(name))

        def block(rows):
            for row in rows:
                ids = tokenizer.encode(row[1])
                yield (row[0], ids, tokenizer.decode(ids), *row[2:]) if decoded else (row[0], ids, *row[2:])

        return block

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    fields[1:2] = ["ids array<int>", "decoded string"] if decoded else ["ids array<int>"]
    return map_rows(chosen, make, ", ".join(fields), rows=64)


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids, decoded, extra): the labels of the arcs, joined by spaces. Null ids give empty text."""
    from pyspark import SparkFiles

    name = _file(encoded.sparkSession, path)
    chosen = encoded.select(key, ids, *extra)

    def make():
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        names.update({t["id"]: t["content"] for t in spec["added_tokens"]})

        def block(rows):
            for row in rows:
                yield (*row[:2], " ".join([names[i] for i in row[1] or ()]), *row[2:])

        return block

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    fields.insert(2, "decoded string")
    return map_rows(chosen, make, ", ".join(fields))
