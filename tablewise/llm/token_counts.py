"""Unigram token counts, scored once for each shared prefix of a trie of pre-tokens."""

from __future__ import annotations

import base64
import math

import regex
from pyspark.sql import DataFrame

from tablewise.llm.common import map_rows

# Split into pre-tokens: contractions, words, numbers and signs with the space before, white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_NODES = 600_000
LONG_WORD = 256


def rank_scores(path: str) -> dict[bytes, float]:
    """Unigram log-probabilities of a ranked vocabulary: Zipf's law over the ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class ForwardTrie:
    """A trie of pre-tokens. Each node holds the best score of its prefix and its number of pieces.

    A node is scored when it is made, from its ancestors, so a prefix shared by many
    pre-tokens is scored once. Among equal scores the fewest pieces win. ``ended``
    keeps the piece count of each inserted pre-token.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.ended: dict[str, int] = {}

    def _forward(self, word: bytes, to: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, minus pieces) of word[:to]; ``best`` holds those of the shorter prefixes."""
        found = (-math.inf, 0)
        get = self.scores.get
        for at in range(max(0, to - self.longest), to):
            score = get(word[at:to])
            if score is not None:
                before = best[at]
                here = (before[0] + score, before[1] - 1)
                if here > found:
                    found = here
        return found

    def insert(self, word: bytes) -> int:
        """Number of pieces of the best split; -1 where no split exists."""
        if len(word) > LONG_WORD:
            best = [(0.0, 0)]
            for to in range(1, len(word) + 1):
                best.append(self._forward(word, to, best))
            found = best[-1]
        else:
            node, path = 0, [self.best[0]]
            for to, byte in enumerate(word, 1):
                edge = node << 8 | byte
                node = self.children.get(edge, -1)
                if node < 0:
                    node = self.children[edge] = len(self.best)
                    self.best.append(self._forward(word, to, path))
                path.append(self.best[node])
            found = path[-1]
        return -found[1] if found[0] > -math.inf else -1


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = PRE_TOKENS
) -> DataFrame:
    """(key, n_pretokens, n_tokens) of every row.

    ``path`` is a ranked vocabulary file of the driver, handed to every executor; it
    holds all single bytes, so every text has a split. A null or empty text has no
    tokens; repeated rows and null keys are counted alike; an empty table gives no row.
    Rows are not shuffled. A task's trie is emptied at MAX_NODES nodes, and pre-tokens
    over LONG_WORD bytes are scored beside it, so memory stays bounded.
    """
    from pyspark import SparkFiles

    docs.sparkSession.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def make():
        trie = ForwardTrie(rank_scores(SparkFiles.get(name)))
        split = regex.compile(pattern)

        def block(rows):
            for doc, body in rows:
                words = split.findall(body or "")
                total = 0
                for word in words:
                    pieces = trie.ended.get(word)
                    if pieces is None:
                        pieces = trie.insert(word.encode())
                        if len(word) <= LONG_WORD:
                            trie.ended[word] = pieces
                    total += pieces
                if len(trie.best) > MAX_NODES:
                    trie.clear()
                yield doc, len(words), total

        return block

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, n_pretokens long, n_tokens long")
