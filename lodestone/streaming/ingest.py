"""Structured Streaming: windowed counts with late data, and upserts of arriving nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.store import UpsertLog


def windowed_counts(stream: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by..., n): rows of each tumbling window; a window's state goes once `late` has passed."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("_w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("_w.start").alias("start"), *by, "n")


def to_log(stream: DataFrame, log: UpsertLog, checkpoint: str) -> StreamingQuery:
    """Update mode: each batch writes the keys that changed and nothing else."""
    return stream.writeStream.outputMode("update").foreachBatch(log.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append mode: a window is written once, when it is closed."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(stream: DataFrame, log: UpsertLog, values: list[str], checkpoint: str) -> StreamingQuery:
    """Merges arriving rows (the log's keys, values, seq): each batch writes the last row of each of its keys. A later batch wins."""

    def merge(batch: DataFrame, i: int) -> None:
        last = F.row_number().over(W.partitionBy(*log.keys).orderBy(F.desc("seq")))
        log.write(batch.withColumn("_rn", last).where("_rn = 1").select(*log.keys, *values), i)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
