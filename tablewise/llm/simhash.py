"""SimHash fingerprints joined by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tablewise.llm.common import LOWER, components, cut, map_rows, positional

BLOCK = 4096


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a text: bit is 1 if set in over half of the shingle hashes."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    shingles = max(len(words) - size + 1, 1)
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, shingles, BLOCK):
        to = min(at + BLOCK, shingles)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:to], ends[at + last : to + last])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > shingles):
        value |= 1 << int(bit)
    return value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp, extra columns) of every row, fp as a signed 64-bit number. A null text has no words: zero."""

    def make():
        def block(rows):
            for row in rows:
                value = fingerprint(row[1])
                yield (row[0], value - (1 << 64) if value >> 63 else value, *row[2:])

        return block

    chosen = docs.select(key, F.col(text).alias("_body"), *extra)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
    return map_rows(chosen, make, ", ".join([fields[0], "fp long", *fields[2:]]), ("_body",))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in one or two bits.

    Every fingerprint emits itself and its 64 one-bit variants. Two fingerprints within
    two bits share a variant, and those that share one are within two bits. A variant
    has at most 65 fingerprints, so no group is large; each member is linked to the
    smallest of its group, which keeps all of them connected with one link a member.
    """
    ball = F.concat(
        F.array(F.lit(0).cast("long")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    variants = distinct.select("fp", F.explode(ball).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    meet = Window.partitionBy("variant")
    linked = variants.select("fp", F.min("fp").over(meet).alias("least")).where("fp != least")
    return linked.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= 2).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``.

    Rows of equal fingerprint form one class before anything is compared, so copies
    cost one row. component_id is the smallest key reachable by links of at most two
    bits. A null key takes part; a component with no other key has a null
    component_id. Texts without words have fingerprint zero and are linked like any
    other. Repeated rows stay repeated, an empty table gives no row, and other columns
    are ignored.
    """
    prints = cut(fingerprints(docs, key, text))
    classes = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(near_links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(groups, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest key, nulls last.

    Of repeated rows with that key one is kept, the first by its place in the written
    intermediate table. All columns are returned, whatever their names.
    """
    plain, names = positional(docs)
    others = tuple(c for c in plain.columns if c != names[key])
    prints = cut(fingerprints(plain, names[key], names[text], others).withColumn("uid", F.monotonically_increasing_id()))
    first = F.struct(F.col(names[key]).isNull().alias("missing"), F.col(names[key]).alias("key"), "uid")
    classes = cut(prints.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(near_links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    kept = prints.join(winners, "uid", "left_semi")
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
