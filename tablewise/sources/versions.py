"""Versioned tables: immutable Parquet folders and an append-only log.

Layout of a store: ``data/version=N`` holds the rows of version N, ``log`` one row
per version, ``claims/N`` says that a writer has taken the number. A version becomes
visible with its log row, which is written last, so a job that dies half-way leaves no
half version behind, only an unused number. What was computed about a version
(quality, profile, moved evidence) lies under ``reports/NAME/version=N``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Marks the rows that a change altered; counted on the write, never stored.
HIT = "_altered"

LOG_SCHEMA = (
    "version long, change_type string, summary string, schema string, row_count long,"
    " folder string, created_at timestamp"
)
HISTORY_SCHEMA = (
    "entry_id string, version long, operation string, configuration string,"
    " records_affected long, created_at timestamp"
)


@dataclass(frozen=True)
class VersionStore:
    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        """A log table; empty as long as nothing was written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._table("log", LOG_SCHEMA)

    def history(self) -> DataFrame:
        return self._table("history", HISTORY_SCHEMA)

    def latest(self) -> int:
        """Number of the newest version, 0 when there is none."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def _claim(self) -> int:
        """The next number that no other writer has taken.

        A file that may not exist before is created for it, which the file system
        grants to one writer only.
        """
        jvm = self.spark._jvm
        number = self.latest() + 1
        while True:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{number}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            try:
                files.create(path, False).close()
                return number
            except Py4JJavaError as error:
                if not files.exists(path):
                    raise error
                number += 1

    def attach(self, name: str, number: int, df: DataFrame) -> None:
        """Store a table that belongs to a version."""
        df.write.mode("overwrite").parquet(f"{self.path}/reports/{name}/version={number}")

    def attached(self, name: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/reports/{name}/version={number}")

    def snapshot(self, df: DataFrame, change_type: str, summary: str = "") -> int:
        """Write the rows as the next version and log it; returns its number."""
        number = self._claim()
        folder, rows, _ = self._write(number, df)
        self._enter(number, change_type, summary, df, rows, folder)
        return number

    def _write(self, number: int, df: DataFrame) -> tuple[str, int, int]:
        """Folder, rows and rows marked in column ``HIT``, both observed on the write itself.

        The marks stand at the top of the plan, in the stage that writes, where every row
        is seen once however often tasks run again.
        """
        # A fresh folder per attempt: a retry never mixes with files of a dead job.
        folder = f"data/version={number}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        hits = F.count_if(F.col(HIT) if HIT in df.columns else F.lit(False))
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), hits.alias("hits"))
        counted.drop(HIT).write.parquet(f"{self.path}/{folder}")
        return folder, seen.get["rows"], seen.get["hits"]

    def _enter(self, number: int, change_type: str, summary: str, df: DataFrame, rows: int, folder: str) -> None:
        self.spark.createDataFrame(
            [(number, change_type, summary, df.drop(HIT).schema.json(), rows, folder)],
            "version long, change_type string, summary string, schema string, row_count long, folder string",
        ).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.path}/log"
        )

    def list_versions(self) -> DataFrame:
        return self.log().orderBy(F.desc("version"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        wanted = self.latest() if number is None else number
        entry = self.log().where(F.col("version") == wanted).select("folder").first()
        if entry is None:
            raise ValueError(f"Version {wanted} does not exist")
        return self.spark.read.parquet(f"{self.path}/{entry['folder']}")

    def restore(self, number: int) -> int:
        """Make the rows of an old version the newest one."""
        return self.snapshot(self.read(number), "restore", f"Restored version {number}")

    def record(self, version: int, operation: str, configuration: str, affected: int) -> None:
        """Append one entry to the transformation history."""
        self.spark.createDataFrame(
            [(uuid.uuid4().hex, version, operation, configuration, affected)],
            "entry_id string, version long, operation string, configuration string, records_affected long",
        ).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.path}/history"
        )

    def change(
        self, operation: str, config: Mapping[str, Any], apply: Callable[[DataFrame], DataFrame], affected: int | None = None
    ) -> int:
        """Run one change on the newest version and log it; returns the new number.

        ``apply`` may mark the rows it alters in a boolean column ``HIT``, which is counted on
        the write and not stored. Without it, the rows that are gone are the affected ones,
        unless ``affected`` tells their number. No job counts beside the write.
        """
        before = self.log().orderBy(F.desc("version")).select("version", "row_count").first()
        out = apply(self.read(before["version"] if before else None))
        number = self._claim()
        folder, rows, hits = self._write(number, out)
        if affected is None:
            affected = hits if HIT in out.columns else before["row_count"] - rows
        self._enter(number, operation, f"{operation}: {affected} records", out, rows, folder)
        self.record(number, operation, json.dumps(config, default=str, sort_keys=True), affected)
        return number
