"""Record and key hashes.

Two hashes are kept apart: the content hash covers every field of a record, the
key hash only the fields that identify it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import lowered, strip


def content_hash(fields: Sequence[str]) -> Column:
    """SHA-256 of the record as JSON with sorted keys, nulls kept.

    The schema is known, so the keys are sorted once here and not per row.
    """
    record = F.struct(*[F.col(f"`{f}`") for f in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def key_hash(keys: Sequence[str], fields: Sequence[str]) -> Column:
    """SHA-256 of the lower-case key values; blank keys fall back to the record."""
    parts = [F.coalesce(lowered(F.col(f"`{k}`")), F.lit("")) for k in keys]
    joined = F.concat_ws("|", *parts)
    blank = F.replace(joined, F.lit("|"), F.lit("")) == ""
    return F.when(blank, content_hash(fields)).otherwise(F.sha2(joined, 256))


def short_id(prefix: str, c: Column, length: int) -> Column:
    """Group id: a prefix and the first hex digits of the key's MD5."""
    return F.concat(F.lit(prefix), F.left(F.md5(c), F.lit(length)))


def url_key(c: Column) -> Column:
    """URL as a match key; null when it is too short to identify anything."""
    text = strip(c)
    return F.when(F.length(text) > 8, F.regexp_replace(F.lower(text), "/+$", ""))


def compact_key(c: Column, longest: int = 256) -> Column:
    """Grouping key of a text: the text itself, or its SHA-256 when it is long.

    Keeps whole documents out of shuffles that only need equality.
    """
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))
