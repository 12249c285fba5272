"""Timestamped text: merging of segments, timeline windows, selection by windows or chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text

GAP = 15.0


def islands(segments: DataFrame, gap: float = GAP, forward: bool = True) -> DataFrame:
    """(video, seq, start, text, ...) with island, nth and the characters [from, to) of the segment in its island's joined text.

    A segment joins the one before if it starts within the gap after it (forward: not before it) and either that one dangles or this
    one begins with a connector. Segments without a start come last and join nothing. Gaps and islands, no fold: a segment's end
    alone decides whether the text so far dangles.
    """
    order = W.partitionBy("video").orderBy(F.col("start").asc_nulls_last(), "seq")
    since = F.col("start") - F.lag("start").over(order)
    near = (since <= gap) & (since >= 0) if forward else since <= gap
    joins = near & (text.dangling(F.lag("text").over(order)) | text.starts_with_connector(F.col("text")))
    marked = segments.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("nth", F.row_number().over(order))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    so_far = F.sum(F.length("text") + 1).over(W.partitionBy("video", "island").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)) - 1
    return numbered.withColumn("to", so_far.cast("int")).withColumn("from", F.col("to") - F.length("text"))


def merged(segments: DataFrame, gap: float = GAP, forward: bool = True) -> DataFrame:
    """(video, island, start, last_start, text, n, ranges) of each island; ranges: seq, from and to of its segments, in order."""
    rows = islands(segments, gap, forward)
    parts = F.array_sort(F.collect_list(F.struct("nth", "seq", "start", "text", "from", "to")))
    out = rows.groupBy("video", "island").agg(parts.alias("parts"))
    return out.select(
        "video", "island", F.element_at("parts", 1)["start"].alias("start"), F.element_at("parts", -1)["start"].alias("last_start"),
        F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), F.size("parts").cast("long").alias("n"),
        F.transform("parts", lambda p: F.struct(p["seq"].alias("seq"), p["from"].alias("from"), p["to"].alias("to"))).alias("ranges"),
    )


def window_of(seconds: float = 300.0, chunk: Column | None = None) -> Column:
    """The timeline window of `start`; without a start, the chunk if one is given and known, else -1."""
    own = F.floor(F.greatest(F.lit(0.0), F.col("start")) / max(60.0, seconds)).cast("long")
    rest = F.lit(-1) if chunk is None else F.coalesce(chunk.cast("long"), F.lit(-1))
    return F.when(F.col("start").isNull(), rest).otherwise(own)


def coverage(rows: DataFrame, seconds: float = 300.0) -> DataFrame:
    return rows.groupBy("video", window_of(seconds).alias("window")).agg(F.count("*").alias("n"))


def first_of_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each normalised text of a video."""
    rn = F.row_number().over(W.partitionBy("video", text.key(F.col("text"))).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def diverse(rows: DataFrame, most: int, least_windows: int | Column = 4, cap: int = 2, seconds: float = 300.0, chunk: Column | None = None) -> DataFrame:
    """(video, id, start, score) -> the selected rows: the best of each window, in window order, for the first windows;
    then by score with at most `cap` of a window; `most` of a video."""
    rows = rows.withColumn("window", window_of(seconds, chunk))
    best = W.partitionBy("video", "window").orderBy(F.desc("score"), "start", "id")
    ranked = rows.withColumn("nth", F.row_number().over(best)).withColumn("turn", F.dense_rank().over(W.partitionBy("video").orderBy("window")))
    wanted = F.least(F.lit(most), F.lit(least_windows) if isinstance(least_windows, int) else least_windows)
    ranked = ranked.withColumn("seed", (F.col("nth") == 1) & (F.col("turn") <= wanted)).where(F.col("nth") <= cap)
    final = W.partitionBy("video").orderBy(F.desc("seed"), F.desc("score"), "start", "id")
    return ranked.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most).select("video", "id", "start", "score", "window", "rank")


def diverse_by_chunk(rows: DataFrame, most: int, chunks: int) -> DataFrame:
    """(video, id, start, chunk, score) -> the best of each chunk 0 to chunks - 1, in their order, then the others by score; `most` of a video."""
    nth = F.row_number().over(W.partitionBy("video", "chunk").orderBy(F.desc("score"), "start", "id"))
    seed = (nth == 1) & F.coalesce(F.col("chunk").between(0, chunks - 1), F.lit(False))
    ranked = rows.withColumn("seed", seed)
    final = W.partitionBy("video").orderBy(F.desc("seed"), F.when(F.col("seed"), F.col("chunk")), F.desc("score"), "start", "id")
    return ranked.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most).select("video", "id", "start", "chunk", "score", "rank")
