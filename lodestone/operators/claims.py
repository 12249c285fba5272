"""Claims with their resource and first excerpt: review queue, related claims, dossiers, status and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.graph import meta

STATES = ("draft", "accepted", "rejected")


def state() -> Column:
    """The claim's state; a missing or unknown one counts as accepted."""
    return F.when(meta("state").isin(*STATES), meta("state")).otherwise("accepted")


def first_excerpts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, excerpt<at, eid, content, speaker>): of each claim's excerpts the earliest, ties by id."""
    at = F.coalesce(meta("start").try_cast("double"), F.lit(0.0))
    excerpts = nodes.where("type = 'Excerpt'").select(F.col("id").alias("object"), F.struct(at.alias("at"), F.col("id").alias("eid"), text.normalise(F.col("content")).alias("content"), meta("speaker").alias("speaker")).alias("e"))
    derived = edges.where("predicate = 'claimDerivedFrom'").select(F.col("subject").alias("id"), "object")
    return derived.join(excerpts, "object").groupBy("id").agg(F.min("e").alias("excerpt"))


def located(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims of a known resource: id, text, state, resource_id, resource_title, url, excerpt and the claim's metadata."""
    claims = nodes.where("type = 'Claim'").select("id", text.normalise(F.coalesce("content", "label")).alias("text"), state().alias("state"), meta("resourceId").alias("resource_id"), "metadata")
    resources = nodes.where("type = 'Resource'").select(F.col("id").alias("resource_id"), F.col("label").alias("resource_title"), meta("url").alias("url"))
    return claims.join(resources, "resource_id").join(first_excerpts(nodes, edges), "id", "left")


def review_queue(nodes: DataFrame, edges: DataFrame, states: tuple[str, ...] = ("draft",), resource: str | None = None, limit: int | None = None) -> DataFrame:
    """Claims that wait for review, by time, then id; without an excerpt the time is 0."""
    rows = located(nodes, edges).where(F.col("state").isin(*states))
    if resource is not None:
        rows = rows.where(F.col("resource_id") == resource)
    at = F.coalesce("excerpt.at", F.lit(0.0))
    out = rows.select("id", "text", "state", "resource_id", "resource_title", at.alias("at"), text.timestamp(at).alias("time"), text.timestamp_url(F.col("url"), at).alias("link"), F.col("excerpt.content").alias("excerpt")).orderBy("at", "id")
    return out if limit is None else out.limit(limit)


def _shared(edges: DataFrame, predicate: str, claim: str, out: str) -> DataFrame:
    links = edges.where(F.col("predicate") == predicate).select("subject", "object").distinct()
    own = links.where(F.col("subject") == claim).select("object")
    return links.join(own, "object", "left_semi").groupBy(F.col("subject").alias("id")).agg(F.count("*").alias(out))


def related(nodes: DataFrame, edges: DataFrame, claim: str, drafts: bool = False, limit: int | None = None) -> DataFrame:
    """Other claims by 3 for each shared reference, 2 for each shared tag, the Jaccard similarity of the words and 0.5 for the
    same resource; best first, then by time and id. The claim itself is one row, which is broadcast."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    own = nodes.where((F.col("type") == "Claim") & (F.col("id") == claim)).limit(1)
    own = own.select(words(F.coalesce("content", "label")).alias("_words"), meta("resourceId").alias("_resource"))
    rows = located(nodes, edges).where((F.col("id") != claim) & F.col("state").isin(*(["accepted", "draft"] if drafts else ["accepted"])))
    rows = rows.join(_shared(edges, "claimMentionsReference", claim, "refs"), "id", "left").join(_shared(edges, "aboutTag", claim, "tags"), "id", "left")
    rows = rows.join(F.broadcast(own)).na.fill(0, ["refs", "tags"])
    alike = text.jaccard(words(F.col("text")), F.col("_words"))
    same = F.when(F.col("_resource") == F.col("resource_id"), 0.5).otherwise(0.0)
    out = rows.select("id", "text", "resource_id", F.coalesce("excerpt.at", F.lit(0.0)).alias("at"), (F.col("refs") * 3 + F.col("tags") * 2 + alike + same).alias("score"), "refs", "tags", F.round(alike, 3).alias("similarity"))
    out = out.where("score > 0").orderBy(F.desc("score"), "at", "id")
    return out if limit is None else out.limit(limit)


def dossiers(nodes: DataFrame, edges: DataFrame, states: tuple[str, ...] = ("accepted",), level: str = "#") -> DataFrame:
    """(resource_id, title, n_claims, markdown): each resource's claims by time and id, numbered, with excerpt, metadata and
    references; a resource without claims says so. Without an excerpt a claim's own start is its time.

    level: # for a document of its own, ## for a section of a playlist's."""
    urls = nodes.where("type = 'Reference'").select(F.col("id").alias("object"), meta("url").alias("u")).where("u <> ''")
    cited = edges.where("predicate = 'claimMentionsReference'").join(urls, "object").groupBy(F.col("subject").alias("id")).agg(F.array_sort(F.collect_set("u")).alias("urls"))
    rows = located(nodes, edges).where(F.col("state").isin(*states)).join(cited, "id", "left")
    at = F.coalesce("excerpt.at", meta("startSeconds").try_cast("double"), F.lit(0.0))
    said = lambda lead, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c))
    bits = F.concat_ws(" | ", said("**Domain:** ", meta("domain")), said("**Classification:** ", meta("classification")))
    confidence, echo = meta("confidence").try_cast("double"), meta("echoOverlapRatio").try_cast("double")
    marks = F.concat_ws(", ", said("type=", meta("type")), F.when(confidence.isNotNull(), F.format_string("confidence=%.2f", confidence)), said("method=", meta("method")), F.when(echo.isNotNull(), F.format_string("echo=%.0f%%", echo * 100)))
    prefix = F.when(F.col("state") == "accepted", "").otherwise(F.concat(F.lit("["), "state", F.lit("] ")))
    head = F.concat(F.lit("["), text.timestamp(at), F.lit("]("), F.coalesce(text.timestamp_url(F.col("url"), at), F.lit("")), F.lit(") "), prefix, "text")
    line = F.concat_ws(
        "\n", head, F.concat(F.lit("   - Excerpt: "), F.coalesce("excerpt.content", F.lit(""))), said("   - Speaker: ", F.col("excerpt.speaker")), said("   - ", bits),
        said("   - **Evidence:** ", meta("evidenceType")), said("   - Meta: ", marks), said("   - References: ", F.array_join("urls", ", ")),
    )
    claims = rows.select("resource_id", F.struct(at.alias("at"), "id", line.alias("line")).alias("c"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))
    claims = claims.groupBy("resource_id").agg(F.array_sort(F.collect_list("c")).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"))
    all_ = nodes.where("type = 'Resource'").select(F.col("id").alias("resource_id"), F.col("label").alias("title"), meta("url").alias("url"), meta("channelName").alias("channel")).join(claims, "resource_id", "left")
    numbered = F.array_join(F.transform("c", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["line"])), "\n")
    listed = F.array_join(F.transform("urls", lambda u: F.concat(F.lit("- "), u)), "\n")
    or_none = lambda c, found, none: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, found).otherwise(none)
    alone = level == "#"
    about = [said("- Channel: ", F.col("channel")), F.concat(F.lit("- Video: "), F.coalesce("url", F.lit("")))]
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Dossier: " if alone else f"{level} "), F.coalesce("title", F.lit(""))), F.lit(""), *(about if alone else about[::-1]), F.lit(""),
        F.lit(f"{level}# Claims"), F.lit(""), or_none("c", numbered, "_No claims extracted._"), F.lit(""), F.lit(f"{level}# References"), F.lit(""), or_none("urls", listed, "_No references extracted._"), F.lit(""),
    )
    return all_.select("resource_id", "title", F.greatest(F.coalesce(F.size("c"), F.lit(0)), F.lit(0)).alias("n_claims"), body.alias("markdown"))


def status(nodes: DataFrame) -> DataFrame:
    """(resource_id, excerpts, claims, references) of every resource."""
    of = lambda kind: F.count_if(F.col("type") == kind)
    counts = nodes.where("type IN ('Excerpt', 'Claim', 'Reference')").groupBy(meta("resourceId").alias("resource_id")).agg(of("Excerpt").alias("excerpts"), of("Claim").alias("claims"), of("Reference").alias("references"))
    return nodes.where("type = 'Resource'").select(F.col("id").alias("resource_id")).join(counts, "resource_id", "left").na.fill(0)


def diagnosis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(resource_id, state, method, claims, without_source): counts of claims, and of those that derive from nothing."""
    sourced = edges.where("predicate = 'claimDerivedFrom'").select(F.col("subject").alias("id"), F.lit(1).alias("_s")).distinct()
    claims = nodes.where("type = 'Claim'").select("id", meta("resourceId").alias("resource_id"), state().alias("state"), F.coalesce(meta("method"), F.lit("unknown")).alias("method"))
    return claims.join(sourced, "id", "left").groupBy("resource_id", "state", "method").agg(F.count("*").alias("claims"), F.count_if(F.col("_s").isNull()).alias("without_source"))


def transcript_diagnosis(excerpts: DataFrame) -> DataFrame:
    """(video, start, duration, text) -> (video, segments, seconds, first, last): their number, summed durations, the earliest start
    and where the latest one ends."""
    length = F.coalesce("duration", F.lit(0.0))
    last = F.max_by(F.col("start") + length, F.struct("start", length.alias("d")))
    return excerpts.groupBy("video").agg(F.count("*").alias("segments"), F.sum(length).alias("seconds"), F.min("start").alias("first"), last.alias("last"))


def issues(diagnosed: DataFrame, transcript: DataFrame) -> DataFrame:
    """(resource_id, issue) of `diagnosis` and of resources with excerpts or without (resource_id, excerpts): no transcript, no claims,
    claims that derive from nothing."""
    totals = diagnosed.groupBy("resource_id").agg(F.sum("claims").alias("claims"), F.sum("without_source").alias("bare"))
    rows = transcript.select("resource_id", "excerpts").join(totals, "resource_id", "left").na.fill(0)
    found = F.array(F.when(F.col("excerpts") == 0, "no-transcript"), F.when(F.col("claims") == 0, "no-claims"), F.when(F.col("bare") > 0, "claims-without-provenance"))
    return rows.select("resource_id", F.explode(F.array_compact(found)).alias("issue"))


def transcripts(excerpts: DataFrame) -> DataFrame:
    """(video, id, start, duration, end?, text) -> (video, n, seconds, segments): by start and id, with ends and durations filled in."""
    end = F.coalesce("end", F.col("start") + F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0))))
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.greatest(F.lit(0.0), end - F.col("start")))
    rows = F.array_sort(F.collect_list(F.struct("start", "id", end.alias("end"), length.alias("duration"), "text")))
    return excerpts.groupBy("video").agg(F.count("*").alias("n"), F.sum(length).alias("seconds"), rows.alias("segments"))
