"""Personal data: seed entities, the contexts they induce, and identifiers those contexts discover."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import block_sizes, cut, map_rows

KINDS = ("email", "ip", "card", "phone")
# Words before an entity that a pattern holds: the last one, two and three.
REACH = 3
# Rounds of scoring; in each, new instances may support new patterns.
ROUNDS = 3
# A pattern speaks when so many different entities stand in it and it leads to entities this often.
SUPPORT = 3
CONFIDENCE = 0.5
# An instance is accepted from this score on.
ACCEPT = 0.6
# Bits of the filter that tells which contexts are patterns; more patterns let more through.
FILTER_BITS = 23
BLOCK_BYTES = 4 << 20
COUNTER_ROWS = 200_000

_TOKENS = re.compile(r"\w+|[^\w\s]")
_DIGITS = str.maketrans("123456789", "000000000")
# Code points looked at for the words before an entity.
_BEFORE = 120

# The base forms (fixed values of the query's contract). A match never starts inside a row
# of digits, where the longer match from the row's first digit would have the same end.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider forms: what may be an identifier of the kind where a pattern vouches for it.
_AT = re.compile(
    r"(?:@|[\[({]\s?(?:at|@)\s?[\])}])\s?[a-z0-9-]++(?:\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}])\s?[a-z0-9-]++)*+", re.IGNORECASE | re.ASCII
)
_WIDE = {
    "ip": re.compile(
        r"(?<![\w.:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}"
        r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
    ),
    "card": re.compile(r"(?<![\w*])(?:[0-9*Xx]{4}[ ./-]?){2,4}[0-9*Xx]{2,7}(?![\w*])"),
    "phone": re.compile(r"(?<![\w+.(-])\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w-])"),
}


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others: every second one from the right doubled, digits added up."""
    total = 0
    for place, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points of each kind, leftmost first; matches that fail their check are left out."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # Only @ can join the two parts, so each @ is looked at once.
    free = 0
    for m in _DOMAIN.finditer(text):
        start = _left_of(text, m.start(), free)
        if start < m.start():
            found["email"].append((start, m.end()))
            free = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found["phone"].append(m.span())
    return found


def _left_of(text: str, at: int, free: int) -> int:
    """Where the row of local characters that ends at ``at`` begins, not before ``free``."""
    while at > free and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def wide_spans(text: str, taken: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the wider forms that overlap no base span of any kind."""
    found: list[tuple[str, int, int]] = []
    free = 0
    for m in _AT.finditer(text):
        # One blank may stand before the sign.
        edge = m.start() - (m.start() > free and text[m.start() - 1].isspace())
        start = _left_of(text, edge, free)
        if start < edge:
            found.append(("email", start, m.end()))
            free = m.end()
    for kind, form in _WIDE.items():
        for m in form.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            signs = sum(c.isalnum() or c == "*" for c in m.group())
            if kind == "ip" or kind == "phone" and 7 <= digits <= 15 or kind == "card" and digits >= 2 and 13 <= signs <= 19:
                found.append((kind, *m.span()))
    if not any(taken.values()):
        return found
    begins = {k: [s for s, _ in spans] for k, spans in taken.items()}

    def clear(start: int, end: int) -> bool:
        for k, spans in taken.items():
            at = bisect_left(begins[k], end)
            if at and spans[at - 1][1] > start:
                return False
        return True

    return [f for f in found if clear(f[1], f[2])]


def normal(value: str) -> str:
    """An entity as the graph knows it: lower case, without white space and brackets."""
    return re.sub(r"[\s()\[\]{}]", "", value.lower())


def tokens(text: str) -> list[str]:
    """Words and signs in lower case."""
    return _TOKENS.findall(text.lower())


def word_hash(word: str) -> int:
    """Hash of a word in which all digits are alike."""
    return xxhash.xxh64_intdigest(word.translate(_DIGITS))


def context_hash(words: list[int], reach: int) -> int:
    """Hash of the last ``reach`` words, given by their own hashes."""
    h = reach
    for w in words[len(words) - reach :]:
        h = ((h * 0x9E3779B97F4A7C15) ^ w) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 32
    return h


def contexts(text: str, start: int) -> list[tuple[int, str]]:
    """(hash, words) of the patterns that end right before ``start``."""
    before = text[max(start - _BEFORE, 0) : start]
    if start > _BEFORE:
        # The first word may be cut; it is only used where it is whole.
        before = before[re.match(r"\w*", before).end() :]
    words = tokens(before)[-REACH:]
    hashes = [word_hash(w) for w in words]
    return [(_signed(context_hash(hashes, n)), " ".join(words[-n:]).translate(_DIGITS)) for n in range(1, len(words) + 1)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _found_in(docs: DataFrame, key: str, text: str) -> DataFrame:
    """uid, key, base spans and mentions (base and wider forms with their contexts) of every row."""
    chosen = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`"), F.col(f"`{text}`").alias("_body"))

    def make():
        def block(rows):
            for uid, name, body in rows:
                body = body or ""
                base = base_spans(body)
                spans = [(k, s, e) for k in KINDS for s, e in base[k]]
                mentions = []
                for seed, found in ((True, spans), (False, wide_spans(body, base))):
                    for kind, start, end in found:
                        mentions.append(
                            {
                                "kind": kind,
                                "start": start,
                                "end": end,
                                "value": normal(body[start:end]),
                                "seed": seed,
                                "patterns": [{"pattern": h, "words": w} for h, w in contexts(body, start)],
                            }
                        )
                yield uid, name, [{"kind": k, "start": s, "end": e} for k, s, e in spans], mentions

        return block

    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    mention = "array<struct<kind:string,start:long,end:long,value:string,seed:boolean,patterns:array<struct<pattern:long,words:string>>>>"
    return map_rows(chosen, make, f"uid long, `{key}` {kind}, base {span}, mentions {mention}", most=BLOCK_BYTES)


def _context_counts(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern occur in all rows, whatever follows them.

    A bit filter of fixed size goes to every task; contexts it lets through are added up
    and joined, so the filter only saves work.
    """
    slot = patterns.select(F.shiftrightunsigned("pattern", 64 - FILTER_BITS).alias("slot"))
    bits = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    # At most one row for each 64 bits of the filter.
    rows = bits.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def counted(bodies: list[str], table: np.ndarray) -> np.ndarray:
        """Hashes of the contexts that pass the filter, repeats included."""
        numbers: dict[str, int] = {}
        ids, sizes = [], []
        for body in bodies:
            words = tokens(body)
            sizes.append(len(words))
            ids += [numbers.setdefault(w, len(numbers)) for w in words]
        hashes = np.array([word_hash(w) for w in numbers], np.uint64)
        ends = np.cumsum(sizes)
        place = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        words = hashes[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
        passed = []
        for reach in range(1, REACH + 1):
            h = np.full(max(len(words) - reach + 1, 0), reach, np.uint64)
            for k in range(reach):
                h = ((h * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : k + len(h)]) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(32)
            h = h[place[reach - 1 :] >= reach - 1]
            bit = h >> np.uint64(64 - FILTER_BITS)
            held = table[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63))
            passed.append(h[(held & np.uint64(1)) == 1])
        return np.concatenate(passed).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, many = shared.value, [], 0

        def flush() -> pa.RecordBatch:
            patterns, total = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(total.astype(np.int64))], names=["pattern", "total"])

        for batch in batches:
            for at, rows in block_sizes(batch, 1024, BLOCK_BYTES):
                bodies = [b for b in batch.column(0).slice(at, rows).to_pylist() if b]
                waiting.append(counted(bodies, table))
                many += len(waiting[-1])
                if many > 10 * COUNTER_ROWS:
                    yield flush()
                    waiting, many = [], 0
        if many:
            yield flush()

    seen = docs.select(F.col(f"`{text}`").alias("_body")).mapInArrow(run, "pattern long, total long")
    return seen.groupBy("pattern").agg(F.sum("total").alias("total")).join(patterns, "pattern", "left_semi")


def pattern_graph(docs: DataFrame, mentions: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Scores of (kind, value) and of (kind, pattern), from rounds over the edges between them.

    ``mentions``: kind, value, seed, patterns. An edge joins a pattern and a value that
    stands in it, with the number of times. Base values score 1. A pattern's confidence
    is the sum of its values' scores over all places its words occur at, whatever
    follows; it counts only with SUPPORT different accepted values. A value's score is
    the chance that not all of its patterns are wrong.
    """
    edges = cut(
        mentions.select("kind", "value", "seed", F.explode("patterns").alias("p"))
        .groupBy("kind", F.col("p.pattern").alias("pattern"), "value")
        .agg(F.count(F.lit(1)).alias("times"), F.max("seed").alias("seed"), F.min("p.words").alias("words"))
    )
    # Patterns that could gain support: those of enough different values of a kind, seeds or not.
    able = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("values"), F.max("seed").alias("seeded")).where(F.col("values") >= SUPPORT)
    able = cut(able.select("kind", "pattern"))
    totals = cut(_context_counts(docs, text, able.select("pattern").distinct()))
    edges = cut(edges.join(able, ["kind", "pattern"], "left_semi").join(totals, "pattern"))
    seeds = cut(mentions.groupBy("kind", "value").agg(F.max("seed").alias("seed")))
    values = seeds.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    patterns = edges
    for _ in range(ROUNDS):
        patterns = cut(
            edges.join(values, ["kind", "value"])
            .groupBy("kind", "pattern")
            .agg(
                F.min("words").alias("words"),
                F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("support"),
                F.sum(F.col("times") * F.col("score")).alias("mass"),
                F.greatest(F.max("total"), F.sum("times")).alias("total"),
            )
            .withColumn("confidence", F.when(F.col("support") >= SUPPORT, F.col("mass") / F.col("total")).otherwise(F.lit(0.0)))
        )
        sure = patterns.where(F.col("confidence") >= CONFIDENCE).select("kind", "pattern", "confidence")
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        gained = edges.where("NOT seed").join(sure, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(doubt))).alias("gained"))
        values = cut(
            seeds.join(gained, ["kind", "value"], "left").select(
                "kind", "value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gained", F.lit(0.0))).alias("score")
            )
        )
    return values, patterns


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) of every row: arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds e-mail addresses, IP addresses, card and phone numbers of the plain
    forms, ordered by kind as in KINDS, then start. ``spans`` adds identifiers of wider
    forms (addresses with "(at)", numbers without a plus sign, masked card numbers and
    the like) that the corpus vouches for: words that stand before base entities of a
    kind are patterns, and a wider form is accepted where confident patterns lead to it.
    An accepted value is marked wherever it occurs; spans of a kind never overlap.

    A null or empty text has no spans. Copies count as often as they occur, but a pattern
    needs different values. Repeated rows and null keys are treated like any other row,
    an empty table gives no row, other columns are ignored. Texts are read whole, in one
    task each. Two passes read the texts; what is shuffled are mentions and counts of
    contexts, added up before.
    """
    facts = cut(_found_in(docs, key, text))
    mentions = facts.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    values, _ = pattern_graph(docs, mentions, text)
    accepted = values.where(F.col("score") >= ACCEPT).select("kind", "value")
    found = mentions.where("NOT seed").join(accepted, ["kind", "value"], "left_semi")
    more = found.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    joined = facts.select("uid", F.col(f"`{key}`"), "base").join(more, "uid", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>"))),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.sort_array(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col(f"`{key}`"), "base", spans.alias("spans"))

