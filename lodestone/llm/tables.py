"""Shared folders, written intermediates and bounded samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Where that is unset, a local master gets a temporary folder and any other master a folder
    beside its warehouse, and the setting is made for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] == "local":
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodestone"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back; removed when Spark ends.

    Its readers survive a lost executor, and its size is known to the planner of the next join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    give_back()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The union of parts as written() would give it; each is written after the one before, whose shuffle files then go."""
    path, out = None, None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path, out = f"{shared_dir(spark).rstrip('/')}/lodestone/{uuid.uuid4().hex}", spark.read.schema(df.schema)
        df.write.mode("append").option("compression", "zstd").parquet(path)
        swept(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    give_back()
    out = out.parquet(path)
    out._written_at = path
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column of long numbers, a row's own in every plan: the place of its file by path, and its place in the file.

    Rows that are not read from one Parquet folder or file are written first. The files' paths come to the driver.
    """
    plan = df._jdf.queryExecution().analyzed()
    told = lambda x: x.getClass().getSimpleName()
    if told(plan) != "LogicalRelation" or told(plan.relation()) != "HadoopFsRelation" or told(plan.relation().fileFormat()) != "ParquetFileFormat" or plan.relation().location().rootPaths().size() != 1:
        df = written(df)
    path, row, at, number = fresh(df, "path", "row", "at", "number")
    rows = df.select("*", df.metadataColumn("_metadata")["file_path"].alias(path), df.metadataColumn("_metadata")["row_index"].alias(row))
    paths = sorted(r[0] for r in rows.select(path).distinct().collect())
    files = df.sparkSession.createDataFrame([*enumerate(paths)], f"{number} long, {at} string")
    out = rows.join(F.broadcast(files), F.col(path) == F.col(at)).withColumn(name, F.shiftleft(F.col(number), 36) + F.col(row))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


def bits(df: DataFrame, number: str) -> DataFrame:
    """The numbers of df as a set of bits, 4 KB for each range of 32,768 numbers that holds any; written."""
    of = df.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return written(of.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def within(df: DataFrame, number: Column, found: DataFrame) -> DataFrame:
    """The rows of df whose number is in a set of bits, which is sent to every task: the rows are not shuffled."""
    bucket, held = fresh(df, "bucket", "bits")
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.join(F.broadcast(found.select(F.col("bucket").alias(bucket), F.col("bits").alias(held))), F.bitmap_bucket_number(number) == F.col(bucket))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def swept(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more, and waits until it is done with them or, at most, two seconds.

    Spark's cleaner runs beside the next step, whose files would otherwise lie beside those of the last one.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, still = None, 0
    for _ in range(20):
        now = known.size()
        before, still = now, still + 1 if now == before else 0
        if still == 3:
            break
        time.sleep(0.1)


def discard(df: DataFrame, sweep: bool = True) -> None:
    """Deletes what written() wrote for df, and (sweep) lets Spark remove shuffle files that nothing refers to any more.

    Only for a table whose readers have been written themselves: nothing derived from it may run again.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._written_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if sweep:
        swept(spark)


def give_back() -> None:
    """Returns freed memory of this Python process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for df not to have such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_rows(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Sets Arrow batches of at most so many rows and about so many bytes for the session (smaller settings stay).

    This bounds a worker's memory: many long texts make several batches, and only a text longer than that is a batch alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def crc_mod(column: str, n: int):
    """crc32 of the column's value as text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def sampled(df: DataFrame, key: str, rows: int, group: str | None = None) -> DataFrame:
    """About `rows` of df's rows with a non-null key (all, if fewer), of each value of `group` if one is given:
    those whose keyed hash falls below a threshold.

    The same rows come each time and on any partitioning; the number is binomial around `rows`. The counts by group
    come to the driver: groups are kinds such as languages, not keys.
    """
    df = df.where(F.col(key).isNotNull())
    parts = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(20177), F.col(key)), F.lit(parts))
    counts = {r[0]: r[1] for r in df.groupBy(F.col(group) if group else F.lit("")).count().collect()}
    rare = [g for g, n in counts.items() if n <= rows]
    if len(rare) == len(counts):
        return df
    if group is None:
        return df.where(place < F.lit(int(parts * rows / counts[""])))
    limits = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, parts if n <= rows else int(parts * rows / n))])
    return df.where(place < limits[F.col(group)])


def with_text(docs: DataFrame, keep: list[str], text_col: str):
    """(key struct of the kept columns[, text]), its schema string, and how a batch gives its texts.

    A text that is kept is sent to Python once.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("key")
    if text_col in keep:
        df = docs.select(key)
        texts = lambda batch: pc.struct_field(batch.column(0), [text_col])
    else:
        df = docs.select(key, F.col(f"`{text_col}`").alias("text"))
        texts = lambda batch: batch.column(1)
    return df, "key " + df.schema["key"].dataType.simpleString(), texts


def lean(run):
    """run, giving memory back to the system when a task ends: Python workers live on between tasks and stages."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return wrapped
