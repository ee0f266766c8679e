"""Shared helpers: intermediate tables, Arrow maps over rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Lower-casing of A-Z alone, for bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only in an unset local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tablewise-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_sizes(batch: pa.RecordBatch, rows: int, most: int | None) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the blocks of a batch: at most ``rows`` rows, and about ``most`` bytes of text."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns if most is not None else ():
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        many, size = 1, sizes[at]
        while many < rows and at + many < batch.num_rows and (most is None or size + sizes[at + many] <= most):
            size += sizes[at + many]
            many += 1
        yield at, many
        at += many


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list], Iterable[tuple]]],
    schema: str,
    binary: tuple[str, ...] = (),
    rows: int = 256,
    most: int | None = None,
) -> DataFrame:
    """Arrow map. ``make`` runs once per task and returns the function for a block of rows.

    The block function gets a list of tuples of the input columns and yields output tuples.
    Columns in ``binary`` arrive as UTF-8 bytes. A block ends after ``rows`` rows, and with
    ``most`` also before its texts exceed that many bytes (a longer text is a block of its
    own). Output is flushed after each block, so memory is bound by a block and not by the
    partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = make()
        for batch in batches:
            for at, many in block_sizes(batch, rows, most):
                part = batch.slice(at, many)
                columns = []
                for name in names:
                    column = part.column(part.schema.get_field_index(name))
                    columns.append((column.cast(pa.binary()) if name in binary else column).to_pylist())
                out = list(block(list(zip(*columns))))
                if out:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), target)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each, so that no name can clash."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), names


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in ``edges``; root is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows the pointers to
    their ends, and replaces nodes by their ends until no edge is left. Pointers are
    doubled, so a chain of n nodes takes log n joins. Joins are plain equi-joins on a
    unique right side, which adaptive execution splits where a root is hot.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            onward = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            points = cut(points.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            moved = not points.where("moved").isEmpty()
            points = points.drop("moved")
            if not moved:
                break
        rounds.append(points)
        ends_a = points.select(F.col("node").alias("a"), F.col("root").alias("x"))
        ends_b = points.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = cut(left.join(ends_a, "a").join(ends_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found if len(rounds) == 1 else cut(found)
