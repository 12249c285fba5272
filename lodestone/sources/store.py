"""Versioned snapshots of tables: a commit writes all its tables, then moves one pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in the warehouse or, on a local master,
    in a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


class SnapshotStore:
    """Tables by name under one path. Readers see the last whole commit; a failed one leaves no trace but unread files.

    `version` is 0 before the first commit. Writers must be one at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        """The highest version with its mark, which is made last."""
        marks = self._path(f"{self.path}/_commits")
        if not self._fs.exists(marks):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(marks)), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version if version is None else version}/{name}")

    def commit(self, tables: dict[str, DataFrame], version: int | None = None) -> int:
        """All of the tables as the next version (or a given one, which is left alone if it exists, so a repeated batch is safe)."""
        now = self.version
        new = now + 1 if version is None else version
        if new <= now:
            return now
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{new}/{name}")
        self._fs.mkdirs(self._path(f"{self.path}/_commits/{new}"))
        return new

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions; readers of older ones must have ended."""
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= self.version - keep:
                self._fs.delete(s.getPath(), True)


class UpsertLog:
    """A table by key as a log of batches: a batch writes its own rows alone, and a reader takes the last row of each key.

    A batch counts once its mark is made, which comes last, so a repeated batch changes nothing and a reader never sees half
    of one. `compact` writes the table as one batch and deletes those it replaces.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        marks = self._path(f"{self.path}/_marks")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def write(self, rows: DataFrame, batch: int) -> None:
        """Rows with at most one row for each key; batches are numbered upwards."""
        if batch in self.batches():
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self._fs.mkdirs(self._path(f"{self.path}/_marks/{batch}"))

    def read(self) -> DataFrame:
        done = self.batches()
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in done])
        rest = [c for c in rows.columns if c not in (*self.keys, "batch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        return latest.select(*self.keys, "_last.*")

    def compact(self) -> None:
        """The whole table as the first batch; those between it and the last go. One writer at a time."""
        done = self.batches()
        if len(done) < 2:
            return
        whole = f"{self.path}/_whole"
        self.read().write.mode("overwrite").parquet(whole)
        # merged rows take the first batch's place: later batches, as long as they stand, say the same
        into = f"{self.path}/batch={done[0]}"
        self._fs.delete(self._path(f"{self.path}/_marks/{done[0]}"), True)
        self._fs.delete(self._path(into), True)
        self._fs.rename(self._path(whole), self._path(into))
        self._fs.mkdirs(self._path(f"{self.path}/_marks/{done[0]}"))
        for b in done[1:-1]:
            self._fs.delete(self._path(f"{self.path}/_marks/{b}"), True)
            self._fs.delete(self._path(f"{self.path}/batch={b}"), True)
