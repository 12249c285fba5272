"""Queries over extraction, references, tasks, planning and exports, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars, text
from lodestone.operators import claims, editor, exports, extract, graph, planning, segments
from lodestone.plans.queries import _LIBRARY, query
from lodestone.sources import adapters
from lodestone.sources.adapters import table

_CONNECTORS = "|".join(text.CONNECTORS)
#: What ends or begins a segment so that it is joined with its neighbour.
_DANGLES = rf"(?i)(?:\.\.\.|…|[,:;]|(?:^|\s)(?:{_CONNECTORS})[.,;:!?)\]]?)\s*$"
_CONNECTS = rf"""(?i)^\s*["''(\[]?(?:{_CONNECTORS})(?:\s|$)"""


@query(rf"""WITH s AS (SELECT conv_id AS video, turn AS seq, CASE WHEN turn % 5 <> 4 THEN turn * 10.0 END AS start, CASE WHEN turn % 2 = 0 THEN text || ',' ELSE text END AS t FROM conversations WHERE text IS NOT NULL),
l AS (SELECT *, lag(start) OVER w AS s0, lag(t) OVER w AS t0, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY video ORDER BY start NULLS LAST, seq)),
f AS (SELECT *, CASE WHEN coalesce(start - s0 BETWEEN 0 AND 15 AND (regexp_matches(t0, '{_DANGLES}') OR regexp_matches(t, '{_CONNECTS}')), false) THEN 0 ELSE 1 END AS new FROM l),
i AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY n) AS island FROM f)
SELECT video, island::BIGINT AS island, min(start)::DOUBLE AS start, sha256(string_agg(t, ' ' ORDER BY n)) AS digest, count(*) AS n FROM i GROUP BY 1, 2""")
def merged_segments(spark, d):
    turn = F.col("turn")
    said = F.when(turn % 2 == 0, F.concat("text", F.lit(","))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), turn.alias("seq"), F.when(turn % 5 != 4, turn * 10.0).alias("start"), said.alias("text"))
    return segments.merged(rows.where("text IS NOT NULL")).select("video", "island", "start", F.sha2("text", 256).alias("digest"), "n")


def _excerpts(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("seq"), (F.col("turn") * 40.0).alias("start"), F.col("text").alias("content"))


@query()
def heuristic_claims(spark, d):
    out = extract.heuristic_claims(_excerpts(spark, d))
    return out.select("video", "id", F.sha2("text", 256).alias("digest"), F.round("start", 6).alias("start"), F.round("confidence", 6).alias("confidence"), F.array_join("excerpt_ids", "|").alias("excerpts"), F.round("echo", 6).alias("echo"))


@query("""WITH c AS (SELECT 'resource-' || (p_partkey % 12) AS r, p_name AS t, list_sort(list_distinct(['excerpt-' || p_partkey, 'excerpt-' || (p_partkey // 2)])) AS e, p_size * 1.0 AS s FROM part),
k AS (SELECT *, 'claim-' || substr(sha256('claim|' || r || '|' || t || '|' || array_to_string(e, '|')), 1, 32) AS id FROM c)
SELECT id, any_value(t) AS content, any_value(r) AS resource, any_value(unnested) AS target FROM (SELECT *, unnest(e) AS unnested FROM k) GROUP BY id, unnested""")
def claim_nodes(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("resource-"), k % 12).alias("resource"), F.lit("v").alias("video"), F.col("p_name").alias("text"), F.array(F.concat(F.lit("excerpt-"), k), F.concat(F.lit("excerpt-"), F.floor(k / 2))).alias("excerpt_ids"), (F.col("p_size") * 1.0).alias("start"))
    nodes, edges = extract.claim_graph(rows)
    return nodes.select("id", "content", graph.meta("resourceId").alias("resource")).join(edges.select(F.col("subject").alias("id"), F.col("object").alias("target")), "id")


def _linked(spark, d):
    """The library with addresses in excerpts' texts and resources' descriptions."""
    nodes, edges = adapters.library(spark, d)
    k = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    said = F.when(F.col("type") == "Excerpt", F.when(k % 3 == 0, F.concat(F.lit("see https://a.example/p"), k % 20, F.lit(", and (http://b.example/q"), k % 5, F.lit(").")))).otherwise(F.col("content"))
    described = F.to_json(F.struct(F.concat(F.lit("https://a.example/p"), k % 20, F.lit("!")).alias("description"), graph.meta("url").alias("url")))
    return nodes.withColumn("content", said).withColumn("metadata", F.when(F.col("type") == "Resource", described).otherwise(F.col("metadata"))), edges


_LINKED = _LIBRARY + """, q AS (SELECT ex.id AS excerpt, resource_id AS resource, unnest(['https://a.example/p' || (k % 20), 'http://b.example/q' || (k % 5)]) AS url FROM ex WHERE k % 3 = 0 AND resource_id IN (SELECT id FROM res)),
o AS (SELECT id AS resource, 'https://a.example/p' || (regexp_extract(id, '[0-9]+')::BIGINT % 20) AS url FROM res),
u AS (SELECT url, min(resource) AS resource, 'reference-' || substr(sha256('reference|' || url), 1, 32) AS id FROM (SELECT url, resource FROM o UNION ALL SELECT url, resource FROM q) GROUP BY url)"""


@query(f"WITH {_LINKED} SELECT id, url AS label, resource FROM u")
def reference_nodes(spark, d):
    return extract.references(*_linked(spark, d))[0].select("id", "label", graph.meta("resourceId").alias("resource"))


@query(f"WITH {_LINKED} SELECT derived.id AS subject, u.id AS object, min(q.excerpt) AS excerpt FROM derived JOIN q ON q.excerpt = excerpt_id JOIN u USING (url) GROUP BY 1, 2")
def reference_links(spark, d):
    return extract.references(*_linked(spark, d))[1].select("subject", "object", graph.meta("excerptId").alias("excerpt"))


@query(f"""WITH {_LIBRARY}, gone AS (SELECT id FROM cl WHERE resource_id IN ('resource-3', 'resource-5'))
SELECT 'node' AS kind, count(*) AS n FROM cl WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'derived', count(*) FROM derived WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'motivated', count(*) FROM edges WHERE predicate = 'taskMotivatedBy' AND object NOT IN (SELECT id FROM gone)""")
def purged_claims(spark, d):
    nodes, edges = adapters.library(spark, d)
    kept, links = extract.purged(nodes, edges, spark.createDataFrame([("resource-3",), ("resource-5",)], "id string"))
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("node", kept.where("type = 'Claim'")).unionByName(one("derived", links.where("predicate = 'claimDerivedFrom'"))).unionByName(one("motivated", links.where("predicate = 'taskMotivatedBy'")))


@query("""WITH t AS (SELECT conv_id AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, text, CASE WHEN role = 'user' THEN 'u' END AS speaker FROM conversations WHERE text IS NOT NULL)
SELECT 'youtube-' || v AS subject, 'excerpt-' || substr(sha256('excerpt|' || v || '|' || i || '|' || (turn * 30) || '|' || (turn % 3 + 0.5) || '|' || text), 1, 32) AS object, 'Excerpt ' || v || ' @' || (turn * 30) || 's' AS label, (turn * 30 + turn % 3 + 0.5)::DOUBLE AS "end", speaker FROM t""")
def ingested_excerpts(spark, d):
    turn = F.col("turn")
    segment = F.struct("turn", (turn * 30.0).alias("start"), (turn % 3 + 0.5).cast("double").alias("duration"), "text", F.when(F.col("role") == "user", "u").alias("speaker"))
    videos = table(spark, d, "conversations").where("text IS NOT NULL").groupBy(F.col("conv_id").cast("string").alias("video")).agg(F.array_sort(F.collect_list(segment)).alias("s"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    videos = videos.select("video", none("title"), none("description"), none("channel"), none("url"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["duration"].alias("duration"), x["text"].alias("text"), x["speaker"].alias("speaker"))).alias("segments"))
    nodes, edges = extract.ingested(videos)
    own = nodes.where("type = 'Excerpt'").select(F.col("id").alias("object"), "label", graph.meta_number("end").alias("end"), graph.meta_string("speaker").alias("speaker"))
    return edges.select("subject", "object").join(own, "object")


_TASKS = """rq AS (SELECT 'claim-' || p_partkey AS claim_id, CASE WHEN p_partkey % 4 <> 0 THEN ' Do ' || p_brand || ' ' END AS title, CASE p_partkey % 3 WHEN 0 THEN 'Inbox' WHEN 1 THEN 'project-' || (p_partkey % 50) ELSE 'new ' || (p_partkey % 7) END AS project, p_name FROM part),
tk AS (SELECT claim_id, CASE WHEN project = 'Inbox' THEN 'project-inbox' ELSE project END AS project, coalesce(trim(title), p_name) AS title FROM rq)"""


def _requests(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("claim-"), k).alias("claim_id"), F.when(k % 4 != 0, F.concat(F.lit(" Do "), "p_brand", F.lit(" "))).alias("title"),
        F.when(k % 3 == 0, "Inbox").when(k % 3 == 1, F.concat(F.lit("project-"), k % 50)).otherwise(F.concat(F.lit("new "), k % 7)).alias("project"), F.array(F.lit(" Red Tag! "), F.lit(" "), F.col("p_type")).alias("tags"), k.alias("seq"),
    )


@query(f"""WITH {_TASKS} SELECT claim_id, project, 'task-' || substr(sha256('task|' || project || '|' || claim_id || '|' || title), 1, 32) AS task_id FROM tk""")
def tasks_from_claims(spark, d):
    return planning.tasks_from_claims(adapters.library(spark, d)[0], _requests(spark, d))[2]


@query(f"""WITH {_LIBRARY}, {_TASKS}, t AS (SELECT *, 'task-' || substr(sha256('task|' || project || '|' || claim_id || '|' || title), 1, 32) AS id FROM tk),
tags AS (SELECT DISTINCT 'tag-' || lower(p_type) AS id FROM part UNION SELECT 'tag-red-tag')
SELECT 'Task' AS type, count(DISTINCT id) AS n FROM t UNION ALL SELECT 'Project', count(DISTINCT project) FROM t WHERE project NOT IN (SELECT 'project-' || c_custkey FROM customer)
UNION ALL SELECT 'TopicTag', count(*) FROM tags UNION ALL SELECT 'taskMotivatedBy', count(*) FROM t UNION ALL SELECT 'taskPartOfProject', count(*) FROM t UNION ALL SELECT 'aboutTag', 2 * count(*) FROM t""")
def task_upserts(spark, d):
    nodes, _ = adapters.library(spark, d)
    made, links, _ = planning.tasks_from_claims(nodes, _requests(spark, d))
    counts = links.groupBy(F.col("predicate").alias("type")).agg(F.count("*").alias("n"))
    return made.dropDuplicates(["id"]).groupBy("type").agg(F.count("*").alias("n")).unionByName(counts)


@query(f"""WITH {_LIBRARY}, a AS (SELECT 'claim-' || (p_partkey * 2) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'rejected' END AS state, CASE WHEN p_partkey % 5 = 0 THEN ' New  text ' || p_partkey END AS said FROM part)
SELECT a.id, substr(coalesce('New text ' || trim(split_part(said, 'text ', 2)), content, label), 1, 120) AS label, coalesce(a.state, raw_state) AS state, domain FROM a JOIN cl ON cl.id = a.id""")
def review_actions(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    acts = table(spark, d, "part").select(F.concat(F.lit(" claim-"), k * 2).alias("claim_id"), F.when(k % 3 == 0, "rejected").alias("state"), F.when(k % 5 == 0, F.concat(F.lit(" New  text "), k)).alias("text"), F.array().cast("array<string>").alias("tags"), none.alias("task_title"), none.alias("task_project"), k.alias("seq"))
    made, _, _ = planning.reviewed(adapters.library(spark, d)[0], acts)
    return made.where("type = 'Claim'").select("id", "label", graph.meta("state").alias("state"), graph.meta("domain").alias("domain"))


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'goal-x' || s_suppkey END AS given, CASE WHEN s_suppkey % 9 = 0 THEN '  ' WHEN s_suppkey % 9 = 1 THEN '!!' ELSE ' ' || s_name END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'area-' || (s_suppkey % 40) END AS area FROM supplier),
ok AS (SELECT *, trim(name) AS n FROM r WHERE trim(name) <> '' AND (area IS NULL OR area IN (SELECT 'area-' || n_nationkey FROM nation)))
SELECT coalesce(given, CASE WHEN n = '!!' THEN 'goal-' || substr(sha256('goal|!!'), 1, 32) ELSE 'goal-' || trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') END) AS id, n AS label, area FROM ok""")
def planned_goals(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    asked = table(spark, d, "supplier").select(F.when(k % 4 == 0, F.concat(F.lit("goal-x"), k)).alias("given_id"), F.when(k % 9 == 0, "  ").when(k % 9 == 1, "!!").otherwise(F.concat(F.lit(" "), "s_name")).alias("name"), none.alias("description"), F.when(k % 3 != 0, F.concat(F.lit("area-"), k % 40)).alias("area"), none.alias("goal"), k.alias("seq"))
    made, _, _ = planning.created("Goal", adapters.library(spark, d)[0], asked)
    return made.select("id", "label", graph.meta("areaId").alias("area"))


_TIME = """CASE WHEN "at" >= 3600 THEN ("at"::BIGINT // 3600) || ':' || lpad(("at"::BIGINT % 3600 // 60)::VARCHAR, 2, '0') ELSE ("at"::BIGINT // 60)::VARCHAR END || ':' || lpad(("at"::BIGINT % 60)::VARCHAR, 2, '0')"""


@query(f"""WITH {_LIBRARY}, m AS (SELECT subject AS task_id, cl.id, trim(coalesce(content, label)) AS claim, resource_id, e."at" AS "at", e.content AS excerpt FROM edges JOIN cl ON cl.id = object LEFT JOIN first ON first.id = cl.id WHERE predicate = 'taskMotivatedBy'),
u AS (SELECT m.*, title, coalesce(url, 'https://www.youtube.com/watch?v=' || resource_id) AS url FROM m LEFT JOIN res ON res.id = resource_id),
t AS (SELECT task_id, id, '- ' || coalesce('[' || {_TIME} || '] ', '') || claim || coalesce(chr(10) || '  ' || url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || "at"::BIGINT, '')
  || coalesce(chr(10) || '  Excerpt: ' || excerpt, '') || coalesce(chr(10) || '  Source: ' || title, '') AS told FROM u),
g AS (SELECT task_id, string_agg(told, chr(10) ORDER BY id) AS told FROM t GROUP BY 1)
SELECT 'task-' || o_orderkey AS task_id, sha256('Task: ' || o_orderpriority || ' (task-' || o_orderkey || ')' || chr(10) || 'Project: ' || c_name || ' (project-' || c_custkey || ')' || chr(10) || 'Claims:' || chr(10) || coalesce(told, '- None')) AS digest
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN g ON g.task_id = 'task-' || o_orderkey""")
def task_contexts(spark, d):
    return planning.task_contexts(*adapters.library(spark, d)).select("task_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_LIBRARY}, w AS (SELECT cl.*, coalesce(e."at", 0.0) AS "at", regexp_replace(coalesce(e.content, ''), '\\s+', ' ', 'g') AS excerpt FROM cl LEFT JOIN first ON first.id = cl.id WHERE state IN ('accepted', 'draft')),
l AS (SELECT resource_id, row_number() OVER (PARTITION BY resource_id ORDER BY "at", w.id) AS n, '. [' || {_TIME} || '](' || coalesce(url || '&t=' || "at"::BIGINT, '') || ') ' || CASE WHEN state = 'accepted' THEN '' ELSE '[draft] ' END
  || trim(regexp_replace(coalesce(content, label), '\\s+', ' ', 'g')) || chr(10) || '   - Excerpt: ' || excerpt || coalesce(chr(10) || '   - **Domain:** ' || domain, '')
  || chr(10) || '   - Meta: confidence=' || printf('%.2f', confidence::DOUBLE) || coalesce(', method=' || method, '') AS line FROM w JOIN res ON res.id = resource_id),
g AS (SELECT resource_id, count(*) AS n, string_agg(n || line, chr(10) ORDER BY n) AS body FROM l GROUP BY 1)
SELECT res.id AS resource_id, title, coalesce(n, 0)::INTEGER AS n_claims, sha256('# Dossier: ' || title || chr(10) || chr(10) || coalesce('- Channel: ' || channel || chr(10), '') || '- Video: ' || coalesce(url, '') || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10)
  || coalesce(body, '_No claims extracted._') || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '_No references extracted._' || chr(10)) AS digest FROM res LEFT JOIN g ON g.resource_id = res.id""")
def video_dossiers(spark, d):
    out = claims.dossiers(*adapters.library(spark, d), states=("accepted", "draft"))
    return out.select("resource_id", "title", "n_claims", F.sha2("markdown", 256).alias("digest"))


@query()
def playlist_dossiers(spark, d):
    lists = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 4).alias("k")).agg(F.array_sort(F.collect_list(F.concat(F.lit("resource-"), "s_suppkey"))).alias("videos"))
    lists = lists.select(F.concat(F.lit("list-"), "k").alias("playlist"), F.lit("Parts").alias("title"), F.lit(None).cast("string").alias("url"), "videos")
    out, _ = exports.playlist_dossiers(*adapters.library(spark, d), lists)
    return out.select("playlist", "n_videos", "n_claims", F.sha2("markdown", 256).alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, turn * 30.0 AS start, (turn % 3)::DOUBLE AS d, turn * 30.0 + 20 AS e, text FROM conversations)
SELECT conv_id AS video, count(*) AS n, sum(CASE WHEN d > 0 THEN d ELSE 20 END)::DOUBLE AS seconds, sha256(string_agg(turn || '|' || e::BIGINT || '|' || (CASE WHEN d > 0 THEN d ELSE 20 END)::BIGINT || '|' || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM s GROUP BY 1""")
def transcript_export(spark, d):
    start = F.col("turn") * 30.0
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("id"), start.alias("start"), (F.col("turn") % 3).cast("double").alias("duration"), (start + 20).alias("end"), "text")
    told = F.transform("segments", lambda s: F.concat_ws("|", s["id"], s["end"].cast("long"), s["duration"].cast("long"), F.coalesce(s["text"], F.lit(""))))
    return claims.transcripts(rows).select("video", "n", "seconds", F.sha2(F.array_join(told, "\n"), 256).alias("digest"))


@query("""SELECT conv_id AS video, count(*) AS segments, sum(turn % 4)::DOUBLE AS seconds, min(turn * 30)::DOUBLE AS first, (max(turn) * 30 + arg_max(turn % 4, turn))::DOUBLE AS last FROM conversations GROUP BY 1""")
def transcript_diagnosis(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), (F.col("turn") * 30.0).alias("start"), (F.col("turn") % 4).cast("double").alias("duration"))
    return claims.transcript_diagnosis(rows)


@query(f"""WITH {_LIBRARY}, n AS (SELECT id, 'Claim' AS type, label, content, raw_state AS state, resource_id, video_id, domain, confidence, method FROM cl),
p AS (SELECT subject, predicate, list_sort(list(object)) AS o FROM (SELECT id AS subject, 'claimDerivedFrom' AS predicate, excerpt_id AS object FROM derived) GROUP BY ALL)
SELECT n.id, sha256('{{"@id":"urn:graph:node:' || n.id || '","@type":"Claim","label":"' || label || '"' || coalesce(',"content":"' || content || '"', '') || ',"confidence":' || CASE WHEN confidence = 0 THEN '0' ELSE confidence::VARCHAR END || coalesce(',"domain":"' || domain || '"', '')
  || coalesce(',"method":"' || method || '"', '') || coalesce(',"resourceId":"' || resource_id || '"', '') || coalesce(',"state":"' || state || '"', '') || coalesce(',"videoId":"' || video_id || '"', '')
  || CASE len(o) WHEN 1 THEN ',"claimDerivedFrom":"urn:graph:node:' || o[1] || '"' WHEN 2 THEN ',"claimDerivedFrom":["urn:graph:node:' || o[1] || '","urn:graph:node:' || o[2] || '"]' ELSE '' END || '}}') AS digest
FROM n LEFT JOIN p ON p.subject = n.id""")
def json_ld_documents(spark, d):
    nodes, edges = adapters.library(spark, d)
    return exports.json_ld(nodes.where("type = 'Claim'"), edges).select("id", F.sha2("document", 256).alias("digest"))


@query(f"""WITH {_LIBRARY}, t AS (SELECT subject AS id FROM edges WHERE predicate = 'projectInArea' UNION SELECT object FROM edges WHERE predicate = 'projectInArea')
SELECT 'project-' || c_custkey AS key, 'project-' || c_custkey || ',' || c_name || ',Project' AS line FROM customer WHERE 'project-' || c_custkey IN (SELECT id FROM t)
UNION ALL SELECT 'area-' || n_nationkey, 'area-' || n_nationkey || ',' || n_name || ',Area' FROM nation WHERE 'area-' || n_nationkey IN (SELECT id FROM t)
UNION ALL SELECT 'project-' || c_custkey || '|projectInArea|area-' || c_nationkey, 'project-' || c_custkey || ',area-' || c_nationkey || ',projectInArea,1' FROM customer""")
def gephi_lines(spark, d):
    nodes, links = exports.gephi_lines(*adapters.library(spark, d), predicates=["projectInArea"], types=["Project", "Area"], labels=True)
    return nodes.unionByName(links)


@query(f"""WITH {_LIBRARY}, n AS (SELECT id FROM cl UNION ALL SELECT id FROM ex UNION ALL SELECT id FROM res)
SELECT 'node' AS kind, id AS a, '' AS p, '' AS o FROM n UNION ALL SELECT 'edge', id, 'claimDerivedFrom', excerpt_id FROM derived WHERE excerpt_id IN (SELECT id FROM n)""")
def graph_snapshot(spark, d):
    nodes, edges = adapters.library(spark, d)
    kept, links = graph.snapshot(nodes.where("type IN ('Claim', 'Excerpt', 'Resource')"), edges, "knowledge")
    return kept.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("p"), F.lit("").alias("o")).unionByName(links.select(F.lit("edge").alias("kind"), F.col("subject").alias("a"), F.col("predicate").alias("p"), F.col("object").alias("o")))


@query(f"WITH {_LIBRARY} SELECT CASE WHEN predicate = '_node' THEN 'node' ELSE 'edge' END AS kind, count(*) AS n FROM (SELECT '_node' AS predicate FROM cl UNION ALL SELECT 'claimDerivedFrom' FROM derived) GROUP BY 1")
def graph_triples(spark, d):
    nodes, edges = adapters.library(spark, d)
    rows = graph.triples(nodes.where("type = 'Claim'"), graph.get_edges(edges, predicate="claimDerivedFrom"))
    back, links = graph.of_triples(rows, {"type": "string", "label": "string", "content": "string", "metadata": "string"})
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("node", back.where("type = 'Claim' AND label IS NOT NULL")).unionByName(one("edge", links))


def _candidates(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("i", "text"))
    return turns.select(
        F.col("conv_id").alias("video"), F.concat_ws("-", "conv_id", "turn", F.lpad(F.col("i").cast("string"), 5, "0")).alias("id"), "text", (F.col("turn") * 60.0 + F.col("i")).alias("start"),
        F.col("turn").cast("int").alias("chunk"), text.heuristic_confidence(F.col("text")).alias("confidence"), F.array(F.concat_ws("-", "conv_id", "turn")).alias("excerpt_ids"),
    )


@query()
def editor_diagnostics(spark, d):
    return editor.diagnostics(editor.editor_fates(_candidates(spark, d)))


@query()
def editor_diagnostics_v1(spark, d):
    return editor.diagnostics(editor.editor_fates_v1(_candidates(spark, d), chunks=3))


@query()
def semantic_chunks(spark, d):
    return editor.semantic_chunks(_excerpts(spark, d), 200, 400, 1)


@query("""SELECT conv_id AS video, 0 AS chunk, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn)::INTEGER - 1 AS place, conv_id || '-' || turn AS id FROM conversations""")
def whole_chunks(spark, d):
    return editor.whole_chunk(_excerpts(spark, d))


@query()
def budget_split_chunks(spark, d):
    rows = _excerpts(spark, d).withColumn("tokens", text.estimated_tokens(F.col("content")))
    return editor.budget_split(editor.whole_chunk(rows).join(rows.select("video", "id", "tokens"), ["video", "id"]), 300, 50)


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(u, 'v=([^&#]*)', 1) WHEN page_id % 3 = 1 THEN 'id' || page_id ELSE 'e' || page_id END AS video,
regexp_replace(CASE WHEN page_id % 2 = 0 THEN 'a:b"' || page_id || '.txt' ELSE 'con.' || page_id END, '^con.*$|[<>:"/\\|?*]', CASE WHEN page_id % 2 = 0 THEN '_' ELSE '_' END, 'g') AS file
FROM (SELECT page_id, 'https://www.youtube.com/watch?v=x' || page_id || '&list=L' AS u FROM pages)""")
def identifiers(spark, d):
    k = F.col("page_id")
    address = F.when(k % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=x"), k, F.lit("&list=L"))).when(k % 3 == 1, F.concat(F.lit("https://youtu.be/id"), k)).otherwise(F.concat(F.lit("https://x.example/embed/e"), k))
    name = F.when(k % 2 == 0, F.concat(F.lit('a:b"'), k, F.lit(".txt"))).otherwise(F.concat(F.lit("con."), k))
    rows = table(spark, d, "pages").select(k, address.alias("a"), name.alias("n"))
    return rows.select("page_id", scalars.video_id(F.col("a")).alias("video"), scalars.file_name(F.col("n")).alias("file"))
