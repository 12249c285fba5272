"""Queries over the driver's tables, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import evaluate, fulltext, graph, segments, taxonomy
from lodestone.sources import adapters
from lodestone.sources.adapters import table

_NODES = """nodes AS (
  SELECT 'area-' || n_nationkey AS id, 'Area' AS type, n_name AS label, NULL AS state FROM nation
  UNION ALL SELECT 'goal-' || r_regionkey, 'Goal', r_name, NULL FROM region
  UNION ALL SELECT 'project-' || c_custkey, 'Project', c_name, NULL FROM customer
  UNION ALL SELECT 'task-' || o_orderkey, 'Task', o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'claim-' || p_partkey, 'Claim', p_name, CASE p_size % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'draft' WHEN 2 THEN 'rejected' END FROM part)"""
_EDGES = """edges AS (
  SELECT DISTINCT 'task-' || l_orderkey AS subject, 'taskMotivatedBy' AS predicate, 'claim-' || l_partkey AS object FROM lineitem
  UNION ALL SELECT 'task-' || o_orderkey, 'taskPartOfProject', 'project-' || o_custkey FROM orders
  UNION ALL SELECT 'project-' || c_custkey, 'projectInArea', 'area-' || c_nationkey FROM customer
  UNION ALL SELECT 'area-' || n_nationkey, 'relatedTo', 'goal-' || n_regionkey FROM nation)"""
_BOTH = f"WITH {_NODES}, {_EDGES} "

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapters.nodes(spark, d), adapters.edges(spark, d)


@query(_BOTH + """, e AS (SELECT subject AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT object, 1, 0 FROM edges),
g AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 10)
SELECT g.id, coalesce(type, 'unknown') AS type, in_degree, out_degree, degree FROM g LEFT JOIN nodes USING (id)""")
def graph_top_degree(spark, d):
    return graph.top_degree(*_graph(spark, d))


@query(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def graph_node_counts(spark, d):
    return graph.node_counts(adapters.nodes(spark, d))


@query(f"WITH {_EDGES} SELECT predicate, count(*) AS n FROM edges GROUP BY predicate")
def graph_edge_counts(spark, d):
    return graph.edge_counts(adapters.edges(spark, d))


@query(f"WITH {_NODES} SELECT coalesce(state, 'unknown') AS state, count(*) AS n FROM nodes WHERE type = 'Claim' GROUP BY 1")
def graph_claim_states(spark, d):
    return graph.claim_states(adapters.nodes(spark, d))


@query(f"WITH {_NODES} SELECT id, label FROM nodes WHERE type = 'Claim' AND state = 'draft'")
def graph_query_nodes(spark, d):
    return graph.query_nodes(adapters.nodes(spark, d), "Claim", {"state": "draft"}).select("id", "label")


@query(f"WITH {_EDGES} SELECT subject, object FROM edges WHERE predicate = 'projectInArea' AND object = 'area-3'")
def graph_get_edges(spark, d):
    return graph.get_edges(adapters.edges(spark, d), "", "projectInArea", "area-3").select("subject", "object")


@query(f"WITH {_NODES} SELECT type, id, label FROM nodes WHERE (type, id) > ('Claim', 'claim-17') ORDER BY type, id LIMIT 25")
def graph_page(spark, d):
    return graph.page(adapters.nodes(spark, d), graph.NODE_ORDER, 25, "Claim|claim-17").select("type", "id", "label")


@query("""WITH t AS (SELECT 'claim-' || p_partkey AS id, p_name AS label FROM part WHERE p_partkey % 3 <> 0),
i AS (SELECT 'claim-' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS label FROM part WHERE p_partkey % 2 = 0)
SELECT id, coalesce(i.label, t.label) AS label, CASE WHEN t.id IS NULL THEN 'created' WHEN i.id IS NULL THEN 'kept' WHEN t.label = i.label THEN 'noop' ELSE 'updated' END AS action
FROM t FULL JOIN i USING (id)""")
def graph_upsert(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("claim-"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("k"))
    new = part.where("k % 2 = 0").select("id", F.when(F.col("k") % 5 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"), F.lit(1).alias("seq"))
    return graph.upsert(part.where("k % 3 <> 0"), new, ["id"], ["label"])


@query(_BOTH + """, gone AS (SELECT 'claim-' || p_partkey AS id FROM part WHERE p_size = 1)
SELECT predicate, count(*) AS n FROM edges WHERE subject NOT IN (SELECT id FROM gone) AND object NOT IN (SELECT id FROM gone) GROUP BY predicate""")
def graph_delete_cascade(spark, d):
    gone = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("claim-"), F.col("p_partkey")).alias("id"))
    return graph.edge_counts(graph.delete_nodes(*_graph(spark, d), gone, cascade=True)[1])


@query(_BOTH + "SELECT subject, predicate, object FROM edges WHERE subject IN (SELECT id FROM nodes) AND object IN (SELECT id FROM nodes)")
def graph_snapshot_edges(spark, d):
    return graph.snapshot(*_graph(spark, d))[1]


@query(_BOTH + "SELECT subject AS source, object AS target, predicate AS type, 1 AS weight FROM edges WHERE predicate = 'projectInArea'")
def graph_gephi_edges(spark, d):
    return graph.gephi(*_graph(spark, d), predicates=["projectInArea"])[1]


@query(_BOTH + "SELECT subject, predicate, array_to_string(list_sort(list(object)), ' ') AS targets FROM edges GROUP BY ALL")
def graph_json_ld(spark, d):
    return graph.json_ld_links(*_graph(spark, d)).withColumn("targets", F.array_join("targets", " "))


_LIBRARY = _EDGES + """,
res AS (SELECT 'resource-' || s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 5 <> 0 THEN 'https://example.org/w?id=' || s_suppkey END AS url,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Channel' END AS channel FROM supplier),
cl AS (SELECT 'claim-' || p_partkey AS id, p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_type || '  ' || p_name END AS content, p_name AS label,
  CASE p_size % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'draft' WHEN 2 THEN 'rejected' ELSE 'accepted' END AS state,
  CASE p_size % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'draft' WHEN 2 THEN 'rejected' WHEN 3 THEN 'odd' END AS raw_state,
  CASE WHEN p_partkey % 11 <> 0 THEN 'resource-' || (p_partkey % 12) END AS resource_id, CASE WHEN p_partkey % 2 = 0 THEN 'v-' || p_partkey END AS video_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS domain, p_partkey % 100 / 100 AS confidence, CASE WHEN p_partkey % 4 <> 0 THEN 'heuristic' END AS method FROM part),
ex AS (SELECT 'excerpt-' || p_partkey AS id, p_partkey AS k, CASE WHEN p_partkey % 6 <> 0 THEN p_size * 10.0 ELSE 0.0 END::DOUBLE AS "at", concat_ws(' ', p_brand, p_type, p_name) AS content,
  'resource-' || (p_partkey % 12) AS resource_id FROM part),
derived AS (SELECT 'claim-' || p_partkey AS id, 'excerpt-' || p_partkey AS excerpt_id FROM part WHERE p_partkey % 4 <> 0
  UNION ALL SELECT 'claim-' || p_partkey, 'excerpt-' || (p_partkey + 1) FROM part WHERE p_partkey % 7 <> 0),
first AS (SELECT d.id, min(struct_pack("at" := e."at", eid := e.id, content := e.content)) AS e FROM derived d JOIN ex e ON e.id = d.excerpt_id GROUP BY d.id),
hit AS (SELECT cl.id AS claim_id, trim(coalesce(content, label)) AS claim_text, cl.resource_id, title AS resource_title, video_id, coalesce(e."at", 0.0) AS "at",
  coalesce(url, 'https://www.youtube.com/watch?v=' || video_id) AS url, coalesce(e.content, '') AS excerpt, state, lower(coalesce(content, label)) AS low, lower(title) AS low_title
  FROM cl JOIN res ON res.id = cl.resource_id LEFT JOIN first ON first.id = cl.id WHERE coalesce(url, video_id) IS NOT NULL)"""
_HIT = """claim_id, claim_text, resource_id, resource_title, video_id, "at", CASE WHEN "at" >= 3600 THEN ("at"::BIGINT // 3600) || ':' || lpad(("at"::BIGINT % 3600 // 60)::VARCHAR, 2, '0') ELSE ("at"::BIGINT // 60)::VARCHAR END
  || ':' || lpad(("at"::BIGINT % 60)::VARCHAR, 2, '0') AS time, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || "at"::BIGINT AS link, excerpt"""


@query(f"""WITH {_LIBRARY}, s AS (SELECT {_HIT}, (CASE WHEN contains(low, 'red') THEN 2 ELSE 0 END + CASE WHEN contains(low_title, 'red') THEN 1 ELSE 0 END)::INTEGER AS score FROM hit WHERE state = 'accepted')
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, "at", claim_id LIMIT 40""")
def search_claims(spark, d):
    return graph.search_claims(*adapters.library(spark, d), "Red", limit=40)


@query(f"""WITH {_LIBRARY}, s AS (SELECT {_HIT}, (CASE WHEN contains(low, 'e') THEN 2 ELSE 0 END + CASE WHEN contains(low_title, 'e') THEN 1 ELSE 0 END)::INTEGER AS score FROM hit WHERE state IN ('accepted', 'draft')),
p AS (SELECT subject AS task, object AS project FROM edges WHERE predicate = 'taskPartOfProject'),
t AS (SELECT task FROM p WHERE project IN (SELECT subject FROM edges WHERE predicate = 'projectInArea' AND object = 'area-7')
  INTERSECT SELECT task FROM p WHERE project IN (SELECT 'project-' || c_custkey FROM customer WHERE c_custkey % 5 = 3))
SELECT * FROM s WHERE score > 0 AND claim_id IN (SELECT object FROM edges WHERE predicate = 'taskMotivatedBy' AND subject IN (SELECT task FROM t))""")
def search_claims_in_scopes(spark, d):
    return graph.search_claims(*adapters.library(spark, d), "e", ("accepted", "draft"), area="area-7", goal="goal-3")


@query(f"""WITH {_LIBRARY}, w AS (SELECT unnest(['red', 'widget']) AS term),
own AS (SELECT cl.id FROM cl JOIN w ON list_contains(string_split(lower(coalesce(label, '') || ' ' || coalesce(content, '')), ' '), term) GROUP BY 1 HAVING count(DISTINCT term) = 2),
exs AS (SELECT e.id FROM ex e JOIN w ON list_contains(string_split(lower(e.content), ' '), term) GROUP BY 1 HAVING count(DISTINCT term) = 2),
q AS (SELECT DISTINCT id FROM derived WHERE excerpt_id IN (SELECT id FROM exs)),
s AS (SELECT {_HIT}, (CASE WHEN claim_id IN (SELECT id FROM own) THEN 2 ELSE 0 END + CASE WHEN claim_id IN (SELECT id FROM q) THEN 1 ELSE 0 END)::INTEGER AS score FROM hit WHERE state = 'accepted')
SELECT * FROM s WHERE score > 0""")
def search_claims_fulltext(spark, d):
    nodes, edges = adapters.library(spark, d)
    return graph.search_claims(nodes, edges, "widgets red", postings=fulltext.index(nodes))


@query(f"""WITH {_LIBRARY} SELECT cl.id, label, excerpt_id AS source_id, CASE WHEN ex.id IS NOT NULL THEN 'Excerpt' END AS source_type FROM cl LEFT JOIN derived ON derived.id = cl.id LEFT JOIN ex ON ex.id = excerpt_id""")
def claims_with_sources(spark, d):
    return graph.claims_with_sources(*adapters.library(spark, d)).drop("source_label")


@query(f"""WITH {_NODES}, c AS (SELECT state AS s FROM nodes WHERE id = 'claim-5')
SELECT type, id, label, state FROM nodes, c WHERE type = 'Claim' AND CASE WHEN s IS NULL THEN state IS NOT NULL OR (type, id) > ('Claim', 'claim-5')
  ELSE state > s OR state = s AND (type, id) > ('Claim', 'claim-5') END ORDER BY state NULLS FIRST, type, id LIMIT 30""")
def graph_page_sorted(spark, d):
    nodes = adapters.nodes(spark, d).where("type = 'Claim'").withColumn("state", graph.meta("state"))
    return graph.page(nodes, graph.NODE_ORDER, 30, "Claim|claim-5", first="state").select("type", "id", "label", "state")


@query(r"""SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')).len()::INTEGER AS n_tokens,
sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS label,
'claim-' || substr(sha256('claim|' || doc_id || '|' || coalesce(lang, '')), 1, 32) AS id FROM documents""")
def text_scalars(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(text.tokens(x))).alias("n_tokens"), F.sha2(text.slug(x), 256).alias("slug"), text.truncated(x, 120).alias("label"), text.hash_id("claim", F.col("doc_id"), F.col("lang")).alias("id"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS at FROM (SELECT event_id, event_id % 9000 AS s FROM events)""")
def text_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", text.timestamp(F.col("event_id") % 9000).alias("at"))


@query("""SELECT conv_id AS video, floor(30.0 * turn / 300)::BIGINT AS "window", count(*) AS n FROM conversations GROUP BY ALL""")
def timeline_coverage(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), (F.col("turn") * 30.0).alias("start"))
    return segments.coverage(rows)


@query("""WITH r AS (SELECT p_brand AS video, p_partkey AS id, p_size * 30.0 AS start, p_retailprice AS score, floor(p_size * 30.0 / 300)::BIGINT AS "window" FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY video, "window" ORDER BY score DESC, start, id) AS nth, dense_rank() OVER (PARTITION BY video ORDER BY "window") AS turn FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY (nth = 1 AND turn <= 4) DESC, score DESC, start, id)::INTEGER AS rank FROM a WHERE nth <= 2)
SELECT video, id, start::DOUBLE AS start, score, "window", rank FROM b WHERE rank <= 8""")
def diverse_selection(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("video"), F.col("p_partkey").alias("id"), (F.col("p_size") * 30.0).alias("start"), F.col("p_retailprice").alias("score"))
    return segments.diverse(rows, 8)


_TAXONOMY = """c AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN n_nationkey + 100 ELSE (n_nationkey * 7 + 3) % 25 END AS parent FROM nation),
t AS (SELECT p_partkey AS id, p_size AS category FROM part),
g AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE -l_partkey END AS p FROM lineitem)"""


def _taxonomy(spark, d):
    """Nations as categories (with cycles and unknown parents), parts as topics, orders as tags of their lines' parts; suppliers are tags without topics."""
    k = F.col("n_nationkey")
    parent = F.when(k % 6 == 0, None).when(k % 6 == 1, k + 100).otherwise((k * 7 + 3) % 25)
    categories = table(spark, d, "nation").select(F.concat(F.lit("category-"), k).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("category-"), parent).alias("parent_id"), (k % 5).alias("sort_order"))
    topics = table(spark, d, "part").select(F.concat(F.lit("topic-"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("category-"), "p_size").alias("category_id"), (F.col("p_partkey") % 9).alias("sort_order"))
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("tag-"), "l_orderkey").alias("id"), F.concat(F.lit("topic-"), F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).otherwise(-F.col("l_partkey"))).alias("t"))
    tags = lines.groupBy("id").agg(F.collect_set("t").alias("topic_ids"))
    none = table(spark, d, "supplier").select(F.concat(F.lit("tag-s"), "s_suppkey").alias("id"), F.array().cast("array<string>").alias("topic_ids"))
    return categories, topics, tags.unionByName(none)


@query(f"""WITH RECURSIVE {_TAXONOMY},
up(id, pos, n) AS (SELECT id, parent, 1 FROM c WHERE parent IN (SELECT id FROM c) UNION ALL SELECT up.id, c.parent, n + 1 FROM up JOIN c ON c.id = up.pos WHERE n < 60 AND c.parent IN (SELECT id FROM c))
SELECT 'error' AS severity, 'ORPHANED_TOPIC' AS code, 'topic-' || id AS id FROM t WHERE category NOT IN (SELECT id FROM c)
UNION ALL SELECT CASE WHEN f = 0 THEN 'error' ELSE 'warning' END, CASE WHEN f = 0 THEN 'ORPHANED_TAG' ELSE 'PARTIAL_ORPHAN_TAG' END, 'tag-' || id FROM
  (SELECT g.id, count(*) AS n, count(t.id) AS f FROM g LEFT JOIN t ON t.id = p GROUP BY 1) WHERE f < n
UNION ALL SELECT 'error', 'ORPHANED_TAG', 'tag-s' || s_suppkey FROM supplier
UNION ALL SELECT 'error', 'CIRCULAR_CATEGORY', 'category-' || id FROM up WHERE n = 60""")
def taxonomy_issues(spark, d):
    return taxonomy.issues(*_taxonomy(spark, d))


@query(f"""WITH {_TAXONOMY} SELECT 'topic-' || id AS id, category, (id % 9)::BIGINT AS sort_order FROM t WHERE category = 7 ORDER BY sort_order, id""")
def taxonomy_topics(spark, d):
    rows = taxonomy.list_topics(_taxonomy(spark, d)[1], "category-7")
    return rows.select("id", F.regexp_extract("category_id", "[0-9]+", 0).cast("int").alias("category"), "sort_order")


@query("""WITH a AS (SELECT 'task-' || l_orderkey AS node_id, 'tag-' || (l_partkey % 50) AS tag_id, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END AS confidence,
  CASE WHEN l_linenumber % 3 = 0 THEN 'automatic' WHEN l_linenumber % 3 = 1 THEN 'guess' END AS source, l_linenumber AS seq FROM lineitem),
ok AS (SELECT * FROM a WHERE coalesce(confidence BETWEEN 0 AND 1, true) AND coalesce(source IN ('manual', 'automatic', 'imported', 'inferred'), true))
SELECT node_id, tag_id, coalesce(arg_max(confidence IS NULL, seq), true) AS by_default, arg_max(coalesce(confidence, 1.0), seq) AS confidence, arg_max(coalesce(source, 'manual'), seq) AS source FROM ok GROUP BY 1, 2""")
def taxonomy_assignments(spark, d):
    rows = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    # lines of an order may have the same number: of these the first in the table counts, as in SQL on one thread
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    rows = rows.select(
        F.concat(F.lit("task-"), "l_orderkey").alias("node_id"), F.concat(F.lit("tag-"), F.col("l_partkey") % 50).alias("tag_id"), F.when(n % 2 == 0, F.col("l_discount") * 10).alias("confidence"),
        F.when(n % 3 == 0, "automatic").when(n % 3 == 1, "guess").alias("source"), n.alias("seq"), place,
    )
    good = rows.where(taxonomy.assignment_errors().isNull()).withColumn("by_default", F.col("confidence").isNull())
    held = good.drop("seq", "place").limit(0)
    return taxonomy.assigned(held, good)


@query("""WITH tags AS (SELECT s_suppkey AS seq, 'tag-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN ['Red', 'x' || s_suppkey] ELSE ['alias' || (s_suppkey % 4)] END AS aliases, s_name AS name FROM supplier),
k AS (SELECT seq, id, lower(unnest(list_concat([name], aliases))) AS k FROM tags)
SELECT alias, arg_max(id, seq) AS id FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part UNION ALL SELECT 'ALIAS1') JOIN k ON k.k = lower(alias) GROUP BY alias""")
def taxonomy_aliases(spark, d):
    s = F.col("s_suppkey")
    tags = table(spark, d, "supplier").select(s.alias("seq"), F.concat(F.lit("tag-"), s).alias("id"), F.when(s % 3 == 0, F.array(F.lit("Red"), F.concat(F.lit("x"), s))).otherwise(F.array(F.concat(F.lit("alias"), s % 4))).alias("aliases"), F.col("s_name").alias("name"))
    asked = table(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("alias")).distinct().unionByName(spark.createDataFrame([("ALIAS1",)], "alias string"))
    return taxonomy.find_by_alias(tags, asked)


@query("""WITH tags AS (SELECT 'tag-' || p AS id, unnest([lower(w), lower(w2)]) AS name FROM (SELECT min(p_partkey) AS p, split_part(p_name, ' ', 2) AS w, upper(substr(p_brand, 1, 2)) AS w2 FROM part GROUP BY 2, 3))
SELECT DISTINCT 'claim-' || p_partkey AS node_id, tags.id AS tag_id FROM part JOIN tags ON contains(lower(p_type || ' ' || p_name), name)""")
def taxonomy_tagged_content(spark, d):
    part = table(spark, d, "part")
    tags = part.groupBy(F.substring_index("p_name", " ", -1).alias("name"), F.upper(F.substring("p_brand", 1, 2)).alias("w2")).agg(F.min("p_partkey").alias("p"))
    tags = tags.select(F.concat(F.lit("tag-"), "p").alias("id"), "name", F.array("w2").alias("aliases"))
    nodes = part.select(F.concat(F.lit("claim-"), "p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("content"))
    return taxonomy.tagged_content(nodes, tags)


@query("SELECT l_returnflag AS model, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_pop(l_quantity), 6) AS stddev FROM lineitem GROUP BY 1")
def score_distribution(spark, d):
    out = evaluate.distribution(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "model"), ["model"], "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho, count(*) >= 15 AS reliable FROM r""")
def human_ai_correlation(spark, d):
    return evaluate.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").withColumn("rho", F.round("rho", 6))


@query(r"""WITH u AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(url || ' (see ' || url || '). ' || html, 'https?://[^\s>\]]+'), lambda x: regexp_replace(x, '[.,!?]+$', ''))) AS u FROM pages),
e AS (SELECT page_id, unnest(u) AS u FROM u),
t AS (SELECT page_id, u, least(greatest(length(u) - length(replace(u, ')', '')) - (length(u) - length(replace(u, '(', ''))), 0), length(u) - length(rtrim(u, ')'))) AS x FROM e)
SELECT DISTINCT page_id, substr(u, 1, length(u) - x) AS url, lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) AS host FROM t""")
def page_urls(spark, d):
    told = F.concat("url", F.lit(" (see "), "url", F.lit("). "), "html")
    each = table(spark, d, "pages").select("page_id", F.explode(text.urls(told)).alias("url")).distinct()
    return each.select("page_id", "url", text.host(F.col("url")).alias("host"))
