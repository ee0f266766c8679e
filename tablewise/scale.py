"""Building blocks that keep work spread when one key holds much of the data.

* ``spread_join``: equi-join whose hot keys are split over many tasks.
* ``keep_first``: first row per key without a window over the key.
* ``cut_lineage``: an intermediate table in the folder the cluster names.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A table of at most this many rows is small: it fits in one task, as do the rows of one of
# its keys.
SMALL_ROWS = 1_000_000

# A key is hot when it holds more than one part in this many of all rows, so fewer keys than
# this are hot. This bounds what is broadcast.
HOT_SHARE = 10_000

# A key with fewer rows is never split.
HOT_ROWS = 100_000

# Keys that a heavy-hitter sketch keeps. Its counts are wrong by less than a third of a hot
# key's rows, so it finds every hot key.
KEYS_TRACKED = 100_000

# Null keys match nothing; they are spread over this many values.
NULL_SPREAD = 4096

# Rank error of the sketch that brackets a quantile: one part in this many.
SKETCH_ACCURACY = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may do without: it gets a temporary one. Elsewhere executors
    would write to their own disks, so a missing setting raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tablewise-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, folder_by: str | None = None) -> DataFrame:
    """The table written to shared storage once and read back.

    Survives the loss of executors, and unlike a checkpoint each reader only loads
    the columns it needs. With ``folder_by`` each value of that column is a folder, and
    readers only open those they ask for.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tablewise-{uuid.uuid4().hex}"
    (df.write if folder_by is None else df.write.partitionBy(folder_by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(keys: DataFrame, least: int = HOT_ROWS) -> list[tuple[int, int]]:
    """(hash, copies) of the keys that hold much of a one-column table of key hashes.

    A heavy-hitter sketch runs along one scan: its size is fixed, and every key above
    1/10,000 of the rows (and above ``least`` rows) is in it. Estimates only decide into how
    many parts a key is dealt, so they need no exact count.
    """
    name = keys.columns[0]
    held = keys.where(F.col(name).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.call_function("approx_top_k", F.col(name), F.lit(HOT_SHARE), F.lit(KEYS_TRACKED)).alias("top")
    )
    row = held.first()
    share = max(math.ceil(row["rows"] / HOT_SHARE), least)
    # Fewer than HOT_SHARE hashes come to the driver.
    return [(t["item"], math.ceil(t["count"] / share)) for t in row["top"] or () if t["count"] > share]


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str | None = None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, whose ``key`` is unique, on equality.

    ``how`` is ``left`` or ``inner``. A sketch over one scan of the left keys finds those
    that hold more than 1/10,000 of the rows and more than ``hot_rows``. Their one right
    row is copied, and their left rows are dealt to the copies by a hash of ``spread_by``
    (default: all columns). Only 64-bit hashes of hot keys are broadcast, fewer than
    10,000. Where no key is hot, the join is a plain one. Nothing is written, every left
    row still meets its right row, and null keys, which meet none, are spread.

    ``spread_by`` must differ from ``key``, or the rows of a hot key would stay together.
    ``measured`` may be a frame with the same column ``key`` that is cheaper to scan, such
    as the input of earlier joins.
    """
    if spread_by == key:
        raise ValueError("rows of a hot key cannot be spread by the key itself")
    kind, other = left.schema[key].dataType, right.schema[key].dataType
    # Both sides hash the key as one type; keys that are equal have equal hashes.
    name = F.col(f"`{key}`")
    hashed = F.xxhash64(name if kind == other else name.try_cast(other))
    source = left if measured is None else measured
    hot = hot_keys(source.select(F.when(name.isNotNull(), hashed).alias("_hash")), hot_rows)
    if not hot:
        return left.join(right, key, how)
    listed = F.broadcast(left.sparkSession.createDataFrame(hot, "_hash long, _copies int"))
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in ([spread_by] if spread_by else left.columns)])
    salted_left = left.withColumn("_hash", hashed).join(listed, "_hash", "left").withColumn(
        "_salt",
        F.when(name.isNull(), F.pmod(dealt, F.lit(NULL_SPREAD)))
        .when(F.col("_copies").isNotNull(), F.pmod(dealt, F.col("_copies")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    salted_right = right.withColumn("_hash", F.xxhash64(name)).join(listed, "_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    )
    return salted_left.drop("_copies", "_hash").join(
        salted_right.drop("_copies", "_hash"), [key, "_salt"], how
    ).drop("_salt")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order``, which must be unique.

    A group of copies may be huge, so no window runs over it: the smallest order
    value per key is found with a combined aggregation, and rows are picked by
    that unique value.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")
