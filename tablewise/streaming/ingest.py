"""The ingest job for candidates that keep arriving.

The batch job's validation is one projection and runs unchanged on a stream. Copies
are dropped by key hash; with a watermark the state only holds recent keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import key_hash
from ..operators.dedup import default_keys
from ..operators.ingest import split_rejected, validate
from ..operators.profile import Field


def validated_stream(
    raw: DataFrame,
    fields: Sequence[Field],
    event_time: str,
    delay: str,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Accepted records of a stream, one per key within the watermark."""
    names = [f.name for f in fields]
    accepted, _ = split_rejected(validate(raw, fields))
    keyed = accepted.withColumn("key_hash", key_hash(keys or default_keys(names), names))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key_hash"])


def stream_ingest(
    raw: DataFrame,
    fields: Sequence[Field],
    event_time: str,
    target: str,
    checkpoint: str,
    delay: str = "1 day",
    keys: Sequence[str] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append accepted records to a Parquet table; exactly once by checkpoint."""
    writer = (
        validated_stream(raw, fields, event_time, delay, keys)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
