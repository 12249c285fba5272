"""From excerpts to claims without a model: merging, sentences, candidates, the editor pass, claim nodes; references; purging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import editor, graph, segments

MIN_CHARS, MIN_WORDS, CAP = 20, 4, 3
#: Keys that an extraction run leaves on its resource.
RUN_KEYS = (
    "lastClaimRunAt", "lastClaimRunCandidates", "lastClaimRunCreated", "lastClaimRunUpdated", "lastClaimRunNoop", "lastClaimRunEdgesCreated",
    "lastClaimRunEdgesUpdated", "lastClaimRunEdgesNoop", "lastClaimRunExtractor", "lastClaimRunEditorVersion", "lastClaimRunModel",
    "lastClaimRunPromptVersion", "lastClaimRunValidated", "lastClaimRunValidationErrors", "lastClaimRunEditorDiagnostics",
)


def sentence_candidates(excerpts: DataFrame) -> DataFrame:
    """(video, id, seq, start, content) -> (video, seq, chunk, text, start, excerpt_ids, confidence): the sentences of merged excerpts.

    A sentence's excerpts are those whose characters it overlaps in the merged text; its time lies between the first and the last
    start of the island as its place lies in the text. Sentences both short and of few words go.
    """
    t = text.normalise(F.col("content"))
    rows = excerpts.select("video", "id", "seq", F.col("start").cast("double").alias("start"), t.alias("text")).where("text <> ''")
    islands = segments.merged(rows.select("video", F.struct("seq", "id").alias("seq"), "start", "text"))
    each = islands.select("*", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    before = F.sum(F.length("sentence") + 1).over(W.partitionBy("video", "island").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("a", F.coalesce(before, F.lit(0))).withColumn("b", F.col("a") + F.length("sentence"))
    overlaps = F.filter("ranges", lambda r: (F.col("a") < r["to"]) & (F.col("b") > r["from"]))
    words = F.size(F.split("sentence", " "))
    at = F.when(F.col("start").isNotNull() & F.col("last_start").isNotNull(), F.col("start") + (F.col("last_start") - F.col("start")) * (F.col("a") / F.length("text"))).otherwise(F.col("start"))
    chunk = F.dense_rank().over(W.partitionBy("video").orderBy("island")) - 1
    out = each.withColumn("chunk", chunk).where((F.length("sentence") >= MIN_CHARS) | (words >= MIN_WORDS))
    return out.select(
        "video", F.struct("island", "i").alias("seq"), "chunk", F.col("sentence").alias("text"), at.alias("start"),
        F.transform(overlaps, lambda r: r["seq"]["id"]).alias("excerpt_ids"), text.heuristic_confidence(F.col("sentence")).alias("confidence"),
    )


def heuristic_claims(excerpts: DataFrame, most: int = 20) -> DataFrame:
    """(video, id, chunk, text, start, excerpt_ids, confidence, echo): the best `most` claims of a video.

    Of sentences with one normalised text the first is kept; the editor's second pass selects, over as many windows as
    the video has, four at most; a video of which it selects none keeps them all. Order: confidence, then start.
    """
    unique = segments.first_of_key(sentence_candidates(excerpts), ["seq"])
    unique = unique.withColumn("id", F.concat_ws("-", "video", "seq.island", "seq.i")).drop("seq")
    window = F.when(F.col("start").isNotNull(), F.floor(F.col("start") / 300)).otherwise(F.col("chunk"))
    least = unique.groupBy("video").agg(F.least(F.lit(4), F.greatest(F.lit(1), F.count_distinct(F.when(window >= 0, window)))).cast("int").alias("least"))
    rows = unique.join(least, "video")
    fates = editor.editor_fates(rows, most, F.col("least"), CAP)
    chosen = fates.withColumn("any", F.max(F.col("fate") == "selected").over(W.partitionBy("video"))).where("fate = 'selected' OR NOT any")
    chosen = editor.echoes(chosen.select(*unique.columns), excerpts)
    order = W.partitionBy("video").orderBy(F.desc("confidence"), F.col("start").asc_nulls_last(), "id")
    return chosen.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def claim_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resource, video, text, excerpt_ids, start, confidence, ...) -> claim nodes and their claimDerivedFrom edges, to be upserted.

    The id hashes resource, text and sorted excerpt ids, so the same claim found again is the same node.
    """
    ids = F.array_sort(F.array_distinct("excerpt_ids"))
    known = F.sha2(F.concat_ws("|", F.lit("claim"), "resource", "text", F.array_join(ids, "|")), 256)
    optional = [F.col(c).alias(name) for c, name in (("start", "startSeconds"), ("type", "type"), ("classification", "classification"), ("domain", "domain"), ("echo", "echoOverlapRatio")) if c in claims.columns]
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in claims.columns else F.lit(default)
    data = F.to_json(F.struct(F.col("resource").alias("resourceId"), F.col("video").alias("videoId"), given("method", "heuristic").alias("method"), given("confidence", 0.4).alias("confidence"), given("state", "accepted").alias("state"), *optional))
    rows = claims.withColumn("claim_id", F.concat(F.lit("claim-"), F.substring(known, 1, 32)))
    nodes = rows.select(F.col("claim_id").alias("id"), F.lit("Claim").alias("type"), text.truncated(F.col("text"), 120).alias("label"), F.col("text").alias("content"), data.alias("metadata"))
    edges = rows.select(F.col("claim_id").alias("subject"), F.lit("claimDerivedFrom").alias("predicate"), F.explode(ids).alias("object"), F.to_json(F.struct(given("confidence", 0.4).alias("confidence"))).alias("metadata"))
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["subject", "object"])


def references(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference nodes for the addresses in resources' descriptions and excerpts' texts, and claimMentionsReference edges from the claims
    that derive from such an excerpt; an address has one node for all, of its first resource. Its metadata names one excerpt, the first."""
    resources = nodes.where("type = 'Resource'").select(F.col("id").alias("resource"), F.explode(text.urls(graph.meta("description"))).alias("url"))
    quoted = nodes.where("type = 'Excerpt'").select(F.col("id").alias("excerpt"), graph.meta("resourceId").alias("resource"), F.explode(text.urls(F.col("content"))).alias("url"))
    known = nodes.where("type = 'Resource'").select(F.col("id").alias("resource"))
    quoted = quoted.join(known, "resource", "left_semi")
    found = resources.unionByName(quoted.select("resource", "url")).groupBy("url").agg(F.min("resource").alias("resource"))
    own = text.hash_id("reference", F.col("url"))
    data = F.to_json(F.struct("url", F.col("resource").alias("resourceId")))
    made = found.select(own.alias("id"), F.lit("Reference").alias("type"), F.col("url").alias("label"), F.col("url").alias("content"), data.alias("metadata"))
    derived = graph.get_edges(edges, predicate="claimDerivedFrom").select("subject", F.col("object").alias("excerpt"))
    links = derived.join(quoted, "excerpt").groupBy("subject", "url").agg(F.min("excerpt").alias("excerpt"))
    return made, links.select("subject", F.lit("claimMentionsReference").alias("predicate"), own.alias("object"), F.to_json(F.struct(F.col("excerpt").alias("excerptId"))).alias("metadata"))


def purged(nodes: DataFrame, edges: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the claims of resources(id) and with no run keys on these."""
    gone = nodes.where("type = 'Claim'").select("id", graph.meta("resourceId").alias("r")).join(resources.select(F.col("id").alias("r")), "r", "left_semi").select("id")
    kept, links = graph.delete_nodes(nodes, edges, gone, cascade=True)
    marked = kept.join(resources.select("id", F.lit(True).alias("_purged")), "id", "left")
    held = F.map_filter(F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>"), lambda k, v: ~k.isin(*RUN_KEYS))
    stripped = F.when(F.col("_purged") & (F.col("type") == "Resource") & F.col("metadata").contains("lastClaimRun"), F.coalesce(F.to_json(held), F.col("metadata"))).otherwise(F.col("metadata"))
    return marked.withColumn("metadata", stripped).select(kept.columns), links


def ingested(videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(video, title, description, channel, url, segments array<struct<start, duration, text, speaker>>) -> resource and excerpt nodes and
    resourceHasExcerpt edges, to be upserted. A resource's content is its segments' texts, joined by a space; null segments mean
    that there is no transcript. An excerpt's id hashes video, place, start, duration and text."""
    resource = F.concat(F.lit("youtube-"), "video")
    said = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    status = F.when(F.col("segments").isNull(), "missing").otherwise("available")
    data = F.to_json(F.struct(F.col("video").alias("videoId"), F.col("channel").alias("channelName"), "description", "url", status.alias("transcriptStatus")))
    resources = videos.select(resource.alias("id"), F.lit("Resource").alias("type"), F.col("title").alias("label"), said.alias("content"), data.alias("metadata"))
    each = videos.select(resource.alias("resource"), "video", F.posexplode("segments").alias("i", "s"))
    start, length = F.col("s.start"), F.col("s.duration")
    each = each.withColumn("id", text.hash_id("excerpt", F.col("video"), F.col("i"), text.plain_number(start), text.plain_number(length), F.col("s.text")))
    speaker = F.when(F.col("s.speaker") != "", F.col("s.speaker"))
    own = F.to_json(F.struct(F.col("video").alias("videoId"), F.col("resource").alias("resourceId"), start.alias("start"), length.alias("duration"), (start + length).alias("end"), F.col("i").alias("sequence"), speaker.alias("speaker")))
    label = F.concat(F.lit("Excerpt "), "video", F.lit(" @"), text.plain_number(start), F.lit("s"))
    excerpts = each.select("id", F.lit("Excerpt").alias("type"), label.alias("label"), F.col("s.text").alias("content"), own.alias("metadata"))
    held = F.to_json(F.struct(F.col("i").alias("sequence"), start.alias("start"), length.alias("duration")))
    edges = each.select(F.col("resource").alias("subject"), F.lit("resourceHasExcerpt").alias("predicate"), F.col("id").alias("object"), held.alias("metadata"))
    return resources.unionByName(excerpts), edges


def refreshed(nodes: DataFrame, edges: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the excerpts of resources(id), whose transcripts are read anew."""
    own = nodes.where("type = 'Excerpt'").select("id", graph.meta("resourceId").alias("r"))
    return graph.delete_nodes(nodes, edges, own.join(resources.select(F.col("id").alias("r")), "r", "left_semi").select("id"), cascade=True)
