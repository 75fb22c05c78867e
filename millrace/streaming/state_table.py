"""State tables that streams keep: each micro-batch appends its changes, readers take the newest row of a key.

A write is as large as its batch, whatever the size of the state, and replaces itself if the batch is repeated.  Compaction folds
the changes into a base of as many files as its bytes ask for; until it is complete the old base stays the current one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 128 << 20


class StateTable:
    """Rows of ``schema`` (a DDL string) with unique ``keys`` under ``path``; a change with ``removed`` deletes its key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def _files(self, name: str):
        location = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def _folders(self, name: str, prefix: str) -> list[int]:
        """Numbers of the complete folders ``name/prefix=N``."""
        system, location = self._files(name)
        if not system.exists(location):
            return []
        numbers = []
        for status in system.listStatus(location):
            folder = status.getPath()
            if folder.getName().startswith(prefix) and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                numbers.append(int(folder.getName().removeprefix(prefix)))
        return sorted(numbers)

    def append(self, changes: DataFrame, batch_id: int) -> None:
        """Changes of one micro-batch, at most one per key."""
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def _current(self) -> tuple[DataFrame, int, list[int]]:
        base = max(self._folders("base", "upto="), default=-2)  # -1: a base from before the first batch
        batches = [b for b in self._folders("changes", "batch=") if b > base]
        rows = self.spark.createDataFrame([], f"{self.schema}, removed boolean").withColumn("batch", F.lit(-1).cast("long"))
        if base >= -1:
            stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/base/upto={base}")
            rows = rows.unionByName(stored.withColumns({"removed": F.lit(False), "batch": F.lit(-1).cast("long")}))
        if batches:
            paths = [f"{self.path}/changes/batch={b}" for b in batches]
            read = self.spark.read.option("basePath", f"{self.path}/changes").schema(f"{self.schema}, removed boolean, batch long").parquet(*paths)
            rows = rows.unionByName(read)
        return rows, base, batches

    def read(self) -> DataFrame:
        """The newest row of every key, through a combinable aggregate."""
        rows, _, _ = self._current()
        rest = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        columns = [F.col("_row")[c].alias(c) for c in rest if c != "removed"]
        table = newest.filter(~F.col("_row")["removed"]).select(*self.keys, *columns)
        return table.select(*[c for c in rows.columns if c not in ("removed", "batch")])

    def compact(self) -> None:
        """Write a new base; older bases and the changes it holds are deleted afterwards."""
        _, base, batches = self._current()
        if not batches:
            return
        size = sum(self._bytes(f"changes/batch={b}") for b in batches) + (self._bytes(f"base/upto={base}") if base >= -1 else 0)
        rows = self.read().repartition(max(1, -(-size // FILE_BYTES)), *self.keys)
        rows.write.mode("overwrite").parquet(f"{self.path}/base/upto={batches[-1]}")
        for name in [f"changes/batch={b}" for b in batches] + ([f"base/upto={base}"] if base >= -1 else []):
            system, location = self._files(name)
            system.delete(location, True)

    def _bytes(self, name: str) -> int:
        system, location = self._files(name)
        return system.getContentSummary(location).getLength()
