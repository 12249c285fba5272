"""Queries over transcripts, sentences, claims, full text and streams, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import claims, editor, fulltext
from lodestone.plans.queries import query
from lodestone.sources import adapters, store, transcripts
from lodestone.sources.adapters import table
from lodestone.streaming import ingest

_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ABBREVIATIONS = ", ".join(f"'{a}'" for a in text.ABBREVIATIONS)
_STATE = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'draft' WHEN 2 THEN 'rejected' ELSE 'accepted' END"
_CLAIMS = f"""turns AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT 'claim-' || conv_id || '-' || turn AS id, conv_id, turn, text, {_STATE} AS state,
  coalesce((SELECT min(x.turn) FROM turns x WHERE x.conv_id = t.conv_id AND x.turn IN (t.turn - 1, t.turn)) * 30.0, 0.0)::DOUBLE AS "at" FROM turns t WHERE role = 'assistant')"""
#: The same cues whatever the format they went through.
_CUES = f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER - 1 AS seq, (turn * 30)::DOUBLE AS start, 10.0::DOUBLE AS duration, md5(t) AS digest
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM conversations) WHERE t <> ''"""


def _cues(spark, d, line, head: str = "", tail: str = "", sep: str = "\n"):
    """One file a conversation: `line(start, role, text)` for each turn."""
    turns = table(spark, d, "conversations").withColumn("t", text.normalise(F.col("text"))).where("t <> ''")
    lines = F.array_sort(F.collect_list(F.struct("turn", line(F.col("turn") * 30, F.col("role"), F.col("t")).alias("l"))))
    return turns.groupBy("conv_id").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda p: p["l"]), sep), F.lit(tail)).alias("payload"))


def _escaped(x):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def _told(files, form: str = ""):
    return transcripts.segments(files, "payload", form).select("conv_id", "seq", "start", "duration", F.md5("text").alias("digest"))


def _mmss(s):
    return F.format_string("%02d:%02d.000", F.floor(s / 60), s % 60)


@query(_CUES)
def transcript_xml(spark, d):
    line = lambda s, role, t: F.concat(F.format_string('<text start="%d" dur="10">', s), _escaped(t), F.lit("</text>"))
    return _told(_cues(spark, d, line, "<transcript>", "</transcript>"))


@query(_CUES)
def transcript_json(spark, d):
    line = lambda s, role, t: F.to_json(F.struct((s * 1000).alias("tStartMs"), F.lit(10000).alias("dDurationMs"), F.array(F.struct(t.alias("utf8"))).alias("segs")))
    return _told(_cues(spark, d, line, ")]}'\n{\"events\": [", "]}", ","), "json3")


@query(f"WITH q AS ({_CUES}) SELECT q.*, role AS speaker FROM q JOIN conversations t ON t.conv_id = q.conv_id AND t.turn * 30 = q.start")
def transcript_vtt(spark, d):
    line = lambda s, role, t: F.concat(_mmss(s), F.lit(" --> "), _mmss(s + 10), F.lit(" align:start\n<v "), role, F.lit(">"), t, F.lit("</v>\n"))
    files = _cues(spark, d, line, "WEBVTT\nKind: captions\n\n")
    return transcripts.segments(files, "payload", "vtt").select("conv_id", "seq", "start", "duration", F.md5("text").alias("digest"), "speaker")


@query(_CUES)
def transcript_ttml(spark, d):
    line = lambda s, role, t: F.concat(F.lit('<p begin="'), _mmss(s), F.format_string('" end="%ds">', s + 10), _escaped(t), F.lit("</p>"))
    return _told(_cues(spark, d, line, "<tt><body>", "</body></tt>"), "ttml")


@query(f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{_SPACE}', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: x || CASE WHEN regexp_matches(x, '[.!?]["'')\\]}}]?$')
  AND NOT list_contains([{_ABBREVIATIONS}], regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) THEN chr(1) ELSE ' ' END), ''), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM w)
SELECT doc_id, len(s)::INTEGER AS n, sha256(array_to_string(s, chr(10))) AS digest FROM s""")
def text_sentences(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


@query()
def text_token_chunks(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(editor.text_chunks(F.col("text"), 200)).alias("seq", "chunk"))
    return chunks.select("doc_id", "seq", text.estimated_tokens(F.col("chunk")).alias("n_tokens"), F.sha2("chunk", 256).alias("digest"))


@query(f"""WITH {_CLAIMS} SELECT id, state, 'resource-' || conv_id AS resource_id, "at", floor("at" / 60)::BIGINT || ':' || lpad(("at" % 60)::BIGINT::VARCHAR, 2, '0') AS time,
'https://example.org/v?id=' || conv_id || '&t=' || "at"::BIGINT AS link FROM c WHERE state = 'draft'""")
def review_queue(spark, d):
    return claims.review_queue(*adapters.clips(spark, d)).select("id", "state", "resource_id", "at", "time", "link")


@query(f"""WITH {_CLAIMS}, k AS (SELECT *, (conv_id * 7 + turn) % 25 AS ref, turn % 5 AS tag,
  list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM c),
o AS (SELECT * FROM k WHERE id = 'claim-0-1'),
j AS (SELECT k.id, k."at", (k.ref = o.ref)::BIGINT AS refs, (k.tag = o.tag)::BIGINT AS tags, k.conv_id = o.conv_id AS same,
  len(list_intersect(k.w, o.w)) / len(list_distinct(list_concat(k.w, o.w))) AS alike FROM k, o WHERE k.id <> o.id AND k.state IN ('accepted', 'draft'))
SELECT id, "at", refs, tags, round(refs * 3 + tags * 2 + alike + CASE WHEN same THEN 0.5 ELSE 0 END, 6)::DOUBLE AS score FROM j
WHERE refs * 3 + tags * 2 + alike + CASE WHEN same THEN 0.5 ELSE 0 END > 0""")
def related_claims(spark, d):
    out = claims.related(*adapters.clips(spark, d), "claim-0-1", drafts=True)
    return out.select("id", "at", "refs", "tags", F.round("score", 6).alias("score"))


@query(f"""WITH {_CLAIMS} SELECT 'resource-' || t.conv_id AS resource_id, count(*) AS excerpts, count_if(role = 'assistant')::BIGINT AS claims, 0::BIGINT AS "references" FROM turns t GROUP BY t.conv_id""")
def ingestion_status(spark, d):
    return claims.status(adapters.clips(spark, d)[0])


@query(f"""WITH {_CLAIMS} SELECT 'resource-' || conv_id AS resource_id, state, CASE WHEN turn = 1 THEN 'heuristic' ELSE 'unknown' END AS method, count(*) AS claims, 0::BIGINT AS without_source FROM c GROUP BY ALL""")
def extraction_diagnosis(spark, d):
    return claims.diagnosis(*adapters.clips(spark, d))


@query(rf"""WITH {_CLAIMS}, w AS (SELECT 'Resource' AS type, 'resource-' || conv_id AS id, 'Conversation ' || conv_id AS t FROM turns
UNION SELECT 'Excerpt', 'excerpt-' || conv_id || '-' || turn, coalesce(text, '') FROM turns UNION SELECT 'Claim', id, coalesce(text, '') FROM c)
SELECT type, id FROM w WHERE regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}])conversations?($|[^\p{{L}}\p{{N}}])')""")
def fulltext_search(spark, d):
    return fulltext.search(fulltext.index(adapters.clips(spark, d)[0]), "conversations")


def _candidates(spark, d):
    """The sentences of the conversations as candidates."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("i", "text"))
    return turns.select(
        F.col("conv_id").alias("video"), F.concat_ws("-", "conv_id", "turn", F.lpad(F.col("i").cast("string"), 5, "0")).alias("id"), "text", (F.col("turn") * 60.0 + F.col("i")).alias("start"),
        text.heuristic_confidence(F.col("text")).alias("confidence"), F.array(F.concat_ws("-", "conv_id", "turn")).alias("excerpt_ids"),
    )


@query()
def claim_editor_pass(spark, d):
    return editor.editor_pass(_candidates(spark, d)).withColumn("score", F.round("score", 6))


@query()
def claim_dedupe(spark, d):
    rows = _candidates(spark, d)
    return editor.deduped(rows.withColumn("score", editor.score_v2(rows))).select("video", "id")


@query()
def time_chunks(spark, d):
    return editor.time_chunks(table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("id"), (F.col("turn") * 70.0).alias("start")), 2)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_event_counts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    out = store.scratch(spark, "event-counts")
    log = store.UpsertLog(spark, f"{out}/log", ["start", "event_type"])
    ingest.to_log(ingest.windowed_counts(stream, "ts", ["event_type"]), log, f"{out}/checkpoint").awaitTermination()
    return log.read().withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def stream_upserts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where("user_id IS NOT NULL").select("user_id", "event_type", F.col("event_id").alias("seq"))
    out = store.scratch(spark, "users")
    log = store.UpsertLog(spark, f"{out}/log", ["user_id"])
    ingest.upserts(stream, log, ["event_type"], f"{out}/checkpoint").awaitTermination()
    return log.read()
