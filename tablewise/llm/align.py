"""Alignment of two tokenizers: pointer jumping over overlapping tokens, and links counted over the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.bpe import byte_symbols
from tablewise.llm.common import cut, map_rows
from tablewise.llm.token_counts import PRE_TOKENS

# Bytes of text that are aligned at a time; each needs about 200 bytes of memory.
BLOCK_BYTES = 1 << 18
# At most this many of the most frequent id pairs are sent to every task.
FREQUENT_PAIRS = 1 << 17
# On texts of these characters both libraries split alike, whatever their Unicode version.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of A, then each of B, the number of the B token that ends its group.

    Every token points to the token overlapping it that reaches farthest right: the one
    of the other side that holds its last byte. Where both end on the same byte a group
    ends, and the B token points to itself. Pointers are followed twice as far in each
    round until none moves.
    """
    n = len(a_ends)
    over_b = np.searchsorted(a_ends, b_ends)
    after = np.empty(n + len(b_ends), np.int64)
    after[:n] = n + np.searchsorted(b_ends, a_ends)
    after[n:] = np.where(a_ends[over_b] == b_ends, n + np.arange(len(b_ends)), over_b)
    while True:
        farther = after[after]
        if np.array_equal(farther, after):
            return after - n
        after = farther


def expand(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of every member of groups of these sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def linked_pairs(
    a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, owner: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of all links, sorted: pair is A id * ``width`` + B id.

    Ids of a group are counted before they are multiplied, so a long group without a
    common boundary costs its distinct ids, not its tokens squared.
    """
    groups = len(owner)
    base = max(int(a_ids.max(initial=0)) + 1, width)
    a_key, a_times = np.unique(a_group * base + a_ids, return_counts=True)
    b_key, b_times = np.unique(b_group * base + b_ids, return_counts=True)
    b_many = np.bincount(b_key // base, minlength=groups)
    b_first = np.cumsum(b_many) - b_many
    group = a_key // base
    at, place = expand(b_many[group])
    partner = b_first[group[at]] + place
    pair = (a_key % base)[at] * width + (b_key % base)[partner]
    times = a_times[at] * b_times[partner]
    text = owner[group[at]]
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    if not len(pair):
        return text, pair, times
    begins = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
    return text[begins], pair[begins], np.add.reduceat(times, begins)


class TokenizerPair:
    """Ids and bytes of a byte-level vocabulary (A) and a piece vocabulary with byte fallback (B)."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.a_file = a_file
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        of_sign = {sign: byte for byte, sign in enumerate(byte_symbols())}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        ranks = {}
        for entry, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(of_sign[s] for s in entry)
            if entry not in special:
                ranks[self.a_bytes[i]] = i
        self.fast = tiktoken.Encoding("aligned", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.width = len(self.b_bytes)
        # Each id as text with what may follow it: a comma, a bar, a semicolon, nothing.
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(most)]
        self.most = most

    @cached_property
    def a(self):
        """The tokenizers library, for texts that are not plain."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.a_file)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, or none where a side's bytes differ from a blank and the text."""
        if not text:
            return [], []
        body = " " + text
        if PLAIN.fullmatch(body):
            a = self.fast.encode_ordinary(body)
        else:
            a = self.a.encode_batch_fast([body], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        want = body.encode()
        same = b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want
        return (a, b) if same else ([], [])


@lru_cache(maxsize=2)
def _pair_of(a_file: str, b_file: str) -> TokenizerPair:
    return TokenizerPair(a_file, b_file)


def aligned_block(pair: TokenizerPair, texts: list[str | None]) -> list[dict]:
    """Counts, groups and links of each text; the texts lie end to end, as both sides end with each."""
    coded = [pair.encode(t) for t in texts]
    a_many = np.array([len(a) for a, _ in coded], np.int64)
    b_many = np.array([len(b) for _, b in coded], np.int64)
    a_ids = np.array([i for a, _ in coded for i in a], np.int64)
    b_ids = np.array([i for _, b in coded for i in b], np.int64)
    out = [{"n_a": int(x), "n_b": int(y), "n_groups": 0, "n_links": 0, "groups": "", "pairs": [], "times": []} for x, y in zip(a_many, b_many)]
    if not len(a_ids):
        return out
    last = terminals(np.cumsum(pair.a_sizes[a_ids]), np.cumsum(pair.b_sizes[b_ids]))
    n = len(a_ids)
    ended = np.zeros(len(b_ids), np.int64)
    ended[last[n:]] = 1
    number = np.cumsum(ended) - ended
    a_group, b_group = number[last[:n]], number[last[n:]]
    groups = int(ended.sum())
    a_in, b_in = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    filled = np.flatnonzero(a_many)
    owner = np.empty(groups, np.int64)
    owner[a_group] = np.repeat(np.arange(len(texts)), a_many)
    of_text = np.bincount(owner, minlength=len(texts))
    links = np.bincount(owner, weights=a_in * b_in, minlength=len(texts))
    # Every token stands behind the tokens of earlier groups, A before B within its group.
    a_place = np.arange(n) + (np.cumsum(b_in) - b_in)[a_group]
    b_place = np.arange(len(b_ids)) + np.cumsum(a_in)[b_group]
    codes = np.empty(n + len(b_ids), np.int64)
    codes[a_place], codes[b_place] = a_ids, b_ids
    codes[a_place[np.cumsum(a_in) - 1]] += pair.most
    codes[b_place[np.cumsum(b_in) - 1]] += 2 * pair.most
    tails = np.cumsum((a_many + b_many)[filled])
    codes[tails - 1] += pair.most
    written = [pair.written[c] for c in codes.tolist()]
    text, pairs, times = linked_pairs(a_ids, a_group, b_ids, b_group, owner, pair.width)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    begin = 0
    for k, end in zip(filled.tolist(), tails.tolist()):
        low, high = edges[k], edges[k + 1]
        out[k] |= {
            "n_groups": int(of_text[k]),
            "n_links": int(links[k]),
            "groups": "".join(written[begin:end]),
            "pairs": pairs[low:high].tolist(),
            "times": times[low:high].tolist(),
        }
        begin = end
    return out


def align_tokens(
    docs: DataFrame,
    a_file: str,
    b_file: str,
    key: str = "doc_id",
    text: str = "text",
    groups: bool = True,
    frequent: int = FREQUENT_PAIRS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row.

    A (``a_file``, a byte-level BPE of the tokenizers library) encodes a blank and the
    text, B (``b_file``, a sentencepiece model that adds the blank itself) the text,
    both without special tokens. Byte offsets where tokens of both end cut them into
    groups; each A token of a group is linked with each B token of it. The count of an id
    pair is the number of rows that hold it linked. ``n_best`` links have the highest
    count of their A id (ties included), ``count_sum`` adds up the counts over links.
    ``groups`` writes the ids as ``a1,a2|b1;a3|b2,b3`` (null with ``groups=False``).

    Null and empty texts and texts that a side does not give back byte by byte have no
    tokens: zeros and an empty digest. Repeated rows and null keys count like any other
    row, an empty table gives no row, other columns are ignored. A text is aligned whole
    in one task, which needs memory for its distinct pairs. Files are local to the
    driver and sent to the executors.

    The links of a row are kept as distinct pairs with times. Pairs are counted with
    partial sums; at most ``frequent`` pairs, those above a count bound, go to every task,
    all others meet the table of counts in a join, where no pair is frequent.
    """
    import sentencepiece
    from pyspark import SparkFiles

    spark = docs.sparkSession
    names = []
    for path in (a_file, b_file):
        spark.sparkContext.addFile(path)
        names.append(path.rstrip("/").rsplit("/", 1)[-1])
    chosen = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))

    def make():
        pair = _pair_of(*(SparkFiles.get(n) for n in names))

        def block(rows):
            for (uid, name, _), x in zip(rows, aligned_block(pair, [r[2] for r in rows])):
                digest = hashlib.sha256(x["groups"].encode()).hexdigest() if x["n_a"] else ""
                yield uid, name, x["n_a"], x["n_b"], x["n_groups"], x["n_links"], digest, x["groups"] if groups else None, x["pairs"], x["times"]

        return block

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"uid long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
        " pairs array<bigint>, times array<bigint>"
    )
    facts = cut(map_rows(chosen, make, schema, most=BLOCK_BYTES))
    counts = cut(facts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    width = F.lit(sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size())
    # One row for each id of A, so the size of the vocabulary bounds the broadcast.
    best = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.join(F.broadcast(best), F.floor(F.col("pair") / width) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    bound = count_bound(counts, frequent)
    links = facts.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("uid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    met = links.join(F.broadcast(ranked.where(F.col("n") >= bound)), "pair", "left")
    rare = met.where("n IS NULL").select("uid", "pair", "times").join(ranked.where(F.col("n") < bound), "pair")

    def added(some: DataFrame) -> DataFrame:
        return some.groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )

    sums = added(met.where("n IS NOT NULL")).union(added(rare)).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return facts.drop("pairs", "times").join(sums, "uid", "left").select(
        F.col(f"`{key}`"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
        "groups",
    )


def count_bound(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows of ``counts`` reach, to an eighth of a power of two."""
    grade = F.floor(F.log2("n") * 8).cast("int")
    held, bound = 0, 1 << 62
    for row in sorted(counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect(), key=lambda r: -r["grade"]):
        held += row["rows"]
        if held > most:
            break
        bound = row["least"]
    return bound
