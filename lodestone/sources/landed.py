"""What a downloader has landed: playlists, videos and subtitle files as tables; which track and which file is taken; fixtures."""

from __future__ import annotations

import json
from collections import deque

import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources import transcripts

#: Subtitle formats, the one tried first in front.
FORMATS = ("json3", "json", "vtt", "ttml", "xml")
SEGMENT = "struct<start:double,duration:double,text:string,speaker:string>"
TRANSCRIPT = f"videoId string, language string, segments array<{SEGMENT}>, fullText string"


def best_track(tracks: DataFrame) -> DataFrame:
    """(video, seq, language, kind, ...) -> of each video the first English track that isn't made by speech recognition, else the first
    English one, else the first."""
    english = F.lower("language").startswith("en")
    spoken = F.coalesce(F.col("kind") == "asr", F.lit(False))
    rank = F.when(english & ~spoken, 0).when(english, 1).otherwise(2)
    order = W.partitionBy("video").orderBy(rank, "seq")
    return tracks.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def best_file(files: DataFrame) -> DataFrame:
    """(video, path, format, payload) -> (video, path, segments): of each video the file whose segments reach furthest, then that
    with most segments, then by format and path. Files without segments are never taken."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, FORMATS)), F.col("format")), F.lit(0))
    rows = files.withColumn("_rank", F.when(rank == 0, len(FORMATS) + 1).otherwise(rank))
    form = F.when(F.col("format").isin("json3", "json"), "json3").when(F.col("format") == "vtt", "vtt").when(F.col("format").isin("ttml", "xml"), "ttml").otherwise("none")
    cues = transcripts.segments(rows.where(form != "none").select("video", "path", "_rank", "format", "payload"), "payload", form)
    parts = F.array_sort(F.collect_list(F.struct("seq", "start", "duration", "text")))
    whole = cues.groupBy("video", "path", "_rank").agg(parts.alias("segments"))
    last = F.element_at("segments", -1)
    reach = (last["start"] + last["duration"]) * 1000 + F.size("segments")
    order = W.partitionBy("video").orderBy(reach.desc(), "_rank", "path")
    return whole.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("video", "path", "segments")


def first_found(*tables: DataFrame) -> DataFrame:
    """(video, segments) -> of each video the segments of the first table that has some: tracks, direct file, service, downloader."""
    out = None
    for i, df in enumerate(tables):
        rows = df.where(F.size("segments") > 0).select("video", F.struct(F.lit(i).alias("rank"), "segments").alias("s"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("video").agg(F.min_by(F.col("s.segments"), F.col("s.rank")).alias("segments"), F.min("s.rank").alias("source"))


def cue_groups(payload: str | None) -> list[tuple[float, float, str]]:
    """(start, duration, text) of all cues in a nested JSON document, breadth first, then by start; bad JSON gives none."""
    try:
        queue = deque([json.loads(payload or "")])
    except ValueError:
        return []

    def number(x: object) -> float:
        try:
            return float(x) / 1000 if x is not None else 0.0
        except (TypeError, ValueError):
            return 0.0

    def said(cue: object) -> str:
        if not isinstance(cue, dict):
            return ""
        if isinstance(cue.get("simpleText"), str):
            return cue["simpleText"]
        return "".join(str(r.get("text", "")) for r in cue.get("runs", []) if isinstance(r, dict))

    out = []
    while queue:
        node = queue.popleft()
        if isinstance(node, list):
            queue.extend(node)
        elif isinstance(node, dict):
            group = node.get("transcriptCueGroupRenderer")
            for cue in group.get("cues", []) if isinstance(group, dict) and isinstance(group.get("cues"), list) else []:
                if isinstance(cue, dict):
                    own = cue.get("transcriptCueRenderer", cue)
                    words = " ".join(said(own.get("cue")).split())
                    if words:
                        start = own.get("startOffsetMs", own.get("startTimeMs"))
                        out.append((number(start), number(own.get("durationMs")), words))
            queue.extend(node.values())
    return sorted(out, key=lambda s: s[0])


def service_segments(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """payloads with `segments` of a service's nested JSON. The tree has no fixed depth, so it is walked in Python, a batch at a time."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType())]))
    walk = F.udf(lambda x: cue_groups(x), kind, useArrow=True)
    return payloads.withColumn("segments", walk(F.col(payload_col)))


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON files by a fixed schema; a file that doesn't fit fails."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def mismatched(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, video) of files whose own video id differs from that asked for: expected (path, video)."""
    return expected.join(rows.select("path", "videoId"), "path").where("video <> videoId").select("path", "video")


def prepared(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(video) and transcripts (videoId, segments, fullText) -> excerpts (video, id, seq, start, content, speaker) with ids
    excerpt-<video>-<place>, and (video, error) of videos without a transcript or with an empty one."""
    have = rows.select(F.col("videoId").alias("video"), "segments")
    joined = wanted.select("video").distinct().join(have, "video", "left")
    size = F.coalesce(F.size("segments"), F.lit(-1))
    errors = joined.where(size < 1).select("video", F.when(size < 0, "transcript missing").otherwise("transcript empty").alias("error"))
    each = joined.where(size > 0).select("video", F.posexplode("segments").alias("seq", "s"))
    return each.select("video", F.concat_ws("-", F.lit("excerpt"), "video", "seq").alias("id"), "seq", "s.start", F.col("s.text").alias("content"), "s.speaker"), errors


def fixtures(files: DataFrame) -> DataFrame:
    """(video, payload) of TTML -> transcripts with starts and durations to three decimals, the joined text and a hash over the
    segments: a stable test fixture."""
    cues = transcripts.segments(files.select("video", "payload"), "payload", "ttml")
    three = lambda c: F.round(c, 3).alias(c)
    rows = cues.select("video", "seq", three("start"), three("duration"), "text")
    parts = F.array_sort(F.collect_list(F.struct("seq", "start", "duration", "text")))
    told = F.transform("p", lambda s: F.concat_ws("|", text.plain_number(s["start"]), text.plain_number(s["duration"]), s["text"]))
    whole = rows.groupBy("video").agg(parts.alias("p"))
    return whole.select(F.col("video").alias("videoId"), F.transform("p", lambda s: F.struct(s["start"].alias("start"), s["duration"].alias("duration"), s["text"].alias("text"))).alias("segments"), F.array_join(F.transform("p", lambda s: s["text"]), " ").alias("fullText"), F.sha2(F.array_join(told, "\n"), 256).alias("hash"))


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a cache keyed by content hashes."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def cache_key(*parts: Column) -> Column:
    """A SHA-256 over the parts as JSON, nulls included, so no two lists of parts look alike."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def mock(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Playlists, videos and transcripts of a source without a network: two playlists and two videos with speakers."""
    playlists = spark.createDataFrame([("PL1", "First list", ["vid1", "vid2"]), ("PL2", "Second list", ["vid1"])], "playlist string, title string, videos array<string>")
    videos = spark.createDataFrame([("vid1", "On sleep", "Sleep well, see https://a.example/sleep.", "Channel A", 300.0), ("vid2", "On food", "Eat well.", "Channel B", 240.0)], "video string, title string, description string, channel string, duration double")
    said = [("vid1", [(0.0, 5.0, "Sleep eight hours a night.", "Host"), (6.0, 4.0, "And keep the room dark.", "Guest")]), ("vid2", [(0.0, 5.0, "Eat 30 g of fibre a day.", "Host")])]
    return playlists, videos, spark.createDataFrame(said, f"video string, segments array<{SEGMENT}>")
