"""The property graph over node and edge tables: filters, paging, upserts, deletes, statistics, exports, search.

Nodes: id, type, label, content, metadata (canonical JSON), created_at, updated_at.
Edges: subject, predicate, object, metadata, created_at.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.operators import fulltext

NODE_FIELDS = ("id", "type", "label", "content", "created_at", "updated_at")
NODE_ORDER, EDGE_ORDER = ("type", "id"), ("subject", "predicate", "object")
STATES = ("draft", "accepted", "rejected")


def meta(key: str, column: str = "metadata") -> Column:
    return F.get_json_object(column, f"$.{key}")


def meta_kind(key: str, column: str = "metadata") -> Column:
    """The JSON type of a metadata value as SQL names it: STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY<...> and so on; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "variant"))


def meta_string(key: str, column: str = "metadata") -> Column:
    """The value if it is a JSON string."""
    return F.when(meta_kind(key, column) == "STRING", meta(key, column))


def meta_number(key: str, column: str = "metadata") -> Column:
    """The value if it is a JSON number; a string of digits is none."""
    return F.when(meta_kind(key, column).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|TINYINT|SMALLINT|FLOAT)"), meta(key, column).try_cast("double"))


def metadata(column: str = "metadata") -> Column:
    """The metadata if it is a JSON object, else an empty one."""
    return F.when(F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("OBJECT"), F.col(column)).otherwise(F.lit("{}"))


def canonical(column: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.try_parse_json(column))


def query_nodes(nodes: DataFrame, type: str | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """AND of deep equalities; a node's own field goes before a metadata key of that name, and an unknown key matches nothing."""
    if type is not None:
        nodes = nodes.where(F.col("type") == type)
    for key, value in (filters or {}).items():
        if key in NODE_FIELDS:
            nodes = nodes.where(F.col(key) == F.lit(value))
        elif isinstance(value, str):
            nodes = nodes.where(meta_string(key) == F.lit(value))
        elif isinstance(value, int | float) and not isinstance(value, bool):
            nodes = nodes.where(meta_number(key) == F.lit(float(value)))
        else:
            held = F.to_json(F.try_variant_get(F.try_parse_json(F.col("metadata")), f"$.{key}", "variant"))
            nodes = nodes.where(held == canonical(F.lit(json.dumps(value))))
    return nodes


def get_node(nodes: DataFrame, id: str) -> DataFrame:
    """At most one row."""
    return nodes.where(F.col("id") == id).limit(1)


def get_edges(edges: DataFrame, subject: str = "", predicate: str = "", object: str = "") -> DataFrame:
    """AND of equalities; an empty string is no condition."""
    for key, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value:
            edges = edges.where(F.col(key) == value)
    return edges


def ordered(first: str | None, descending: bool, rest: tuple[str, ...]) -> list[Column]:
    """An optional field, nulls first (last if descending), then the key."""
    lead = [] if first is None else [F.col(first).desc_nulls_last() if descending else F.col(first).asc_nulls_first()]
    return [*lead, *map(F.col, rest)]


def page(rows: DataFrame, keys: tuple[str, ...], limit: int, cursor: str | None = None, first: str | None = None, descending: bool = False) -> DataFrame:
    """`limit` rows after the cursor: a number is an offset, `a|b` the key of the row before, an unknown one starts anew.

    The cursor row's sort field is looked up, so the page is a filter that reaches the scan, and a top k.
    """
    order = ordered(first, descending, keys)
    if cursor is None or "|" not in cursor:
        offset = int(cursor) if cursor and cursor.lstrip("-").isdigit() else 0
        return rows.orderBy(*order).offset(max(0, offset)).limit(limit)
    values = dict(zip(keys, cursor.split("|"), strict=False))
    at = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()])
    there = rows.where(at).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate([*keys, *([first] if first else [])])]).first()
    if there is None:
        return rows.orderBy(*order).limit(limit)
    later = F.lit(False)
    for k, v in reversed(list(zip(keys, there, strict=False))):
        later = (F.col(k) > v) | ((F.col(k) == v) & later)
    if first is not None:
        mark, field = there[-1], F.col(first)
        if mark is None:
            beyond, same = F.lit(False) if descending else field.isNotNull(), field.isNull()
        else:
            beyond, same = field.isNull() | (field < F.lit(mark)) if descending else field > F.lit(mark), field == F.lit(mark)
        later = F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & later)
    return rows.where(later).orderBy(*order).limit(limit)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Classifies a batch: keys, values after it, action created, updated or noop; the last row of `seq` of a key wins.

    Of rows with equal `seq` the first by `place` wins, where incoming has that column; without it, any of them.
    """
    order = [F.desc("seq"), *[F.col(c) for c in incoming.columns if c == "place"]]
    last = incoming.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1")
    new = last.select(*keys, *[F.col(v).alias("_" + v) for v in values], F.lit(True).alias("_new"))
    old = target.select(*keys, *values, F.lit(True).alias("_old"))
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col("_" + v)) for v in values])
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(same, "noop").otherwise("updated")
    return old.join(new, keys, "full_outer").select(*keys, *[F.when(F.col("_new"), F.col("_" + v)).otherwise(F.col(v)).alias(v) for v in values], action.alias("action"))


def upsert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """The key is the triple, and only its metadata can change."""
    return upsert(edges, incoming, list(EDGE_ORDER), ["metadata"])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """ids(id). Without cascade edges may dangle."""
    nodes = nodes.join(ids, "id", "left_anti")
    if cascade:
        for end in ("subject", "object"):
            edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return nodes, edges


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table of triples: a node is (id, _node, _data) with its fields as JSON."""
    data = F.to_json(F.struct(*[c for c in nodes.columns if c != "id"]), {"ignoreNullFields": "false"})
    own = nodes.select(F.col("id").alias("subject"), F.lit("_node").alias("predicate"), F.lit("_data").alias("object"), data.alias("data"))
    return own.unionByName(edges.select(*EDGE_ORDER, F.lit(None).cast("string").alias("data")))


def of_triples(rows: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The nodes (id and fields by name and type) and edges that `triples` put together."""
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    nodes = rows.where("predicate = '_node'").select(F.col("subject").alias("id"), F.from_json("data", schema).alias("d")).select("id", *[F.col(f"d.`{k}`").alias(k) for k in fields])
    return nodes, rows.where("predicate <> '_node'").select(*EDGE_ORDER)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n"))


def claim_states(nodes: DataFrame) -> DataFrame:
    """Claims by state; a missing state, or one that is no string, counts as unknown."""
    return nodes.where("type = 'Claim'").groupBy(F.coalesce(meta_string("state"), F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


def top_degree(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """(id, type, in_degree, out_degree, degree) of the n endpoints with most edges; ids without a node have type unknown."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("object").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    degree = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    best = degree.withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "id").limit(n)
    return best.join(nodes.select("id", "type"), "id", "left").select("id", F.coalesce("type", F.lit("unknown")).alias("type"), "in_degree", "out_degree", "degree")


def snapshot(nodes: DataFrame, edges: DataFrame, scope: str = "all") -> tuple[DataFrame, DataFrame]:
    """Nodes (without operational ones for the knowledge scope) and the edges whose ends are both among them."""
    if scope == "knowledge":
        nodes = nodes.where(~meta("scope").eqNullSafe("operational"))
    for end in ("subject", "object"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select("subject", "predicate", "object", *[c for c in edges.columns if c not in EDGE_ORDER])


def gephi(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None, types: list[str] | None = None, labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for graph drawing; with predicates only nodes that such edges touch."""
    if predicates:
        edges = edges.where(F.col("predicate").isin(predicates))
    if types:
        nodes = nodes.where(F.col("type").isin(types))
    if predicates:
        touched = edges.select(F.col("subject").alias("id")).union(edges.select(F.col("object").alias("id"))).distinct()
        nodes = nodes.join(touched, "id", "left_semi")
    _, kept = snapshot(nodes, edges)
    return nodes.select("id", *(["label"] if labels else []), "type"), kept.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("type"), F.lit(1).alias("weight"))


def json_ld_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, predicate, targets): sorted targets of each known subject and predicate; unknown objects stay."""
    known = edges.join(nodes.select(F.col("id").alias("subject")), "subject", "left_semi")
    return known.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("targets"))


def claims_with_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each claim with the nodes it derives from, if any."""
    derived = edges.where("predicate = 'claimDerivedFrom'").select(F.col("subject").alias("id"), F.col("object").alias("source_id"))
    source = nodes.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("label").alias("source_label"))
    return nodes.where("type = 'Claim'").select("id", "label").join(derived, "id", "left").join(source, "source_id", "left").select("id", "label", "source_id", "source_type", "source_label")


def scoped_claims(edges: DataFrame, project: str | None = None, area: str | None = None, goal: str | None = None) -> DataFrame:
    """(id): claims that motivate a task of the project, of a project in the area and of one that serves the goal: tasks in every scope given."""
    part = get_edges(edges, predicate="taskPartOfProject").select(F.col("subject").alias("task"), F.col("object").alias("project"))
    tasks = None
    for value, predicate in ((project, None), (area, "projectInArea"), (goal, "projectServesGoal")):
        if value is None:
            continue
        if predicate is None:
            mine = part.where(F.col("project") == value)
        else:
            mine = part.join(get_edges(edges, predicate=predicate, object=value).select(F.col("subject").alias("project")), "project", "left_semi")
        mine = mine.select("task")
        tasks = mine if tasks is None else tasks.join(mine, "task", "left_semi")
    motivated = get_edges(edges, predicate="taskMotivatedBy").select(F.col("subject").alias("task"), F.col("object").alias("id"))
    return (motivated if tasks is None else motivated.join(tasks, "task", "left_semi")).select("id").distinct()


def search_claims(
    nodes: DataFrame,
    edges: DataFrame,
    query: str,
    states: tuple[str, ...] = ("accepted",),
    limit: int | None = None,
    project: str | None = None,
    area: str | None = None,
    goal: str | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Claims of a known resource with an address that match the query: best first, then by time and id.

    Without postings a claim scores 2 if its content (its label, where there is none) holds the query and 1 if its resource's
    title does, in any case. With postings (of a full-text index) it scores 2 for a match of its own, 1 for one of an excerpt
    it derives from and 1 for one of its resource; a query that full text refuses is searched as a substring. The time is that of its earliest excerpt, 0 without one.
    An empty query, and one that full text finds nowhere, give no rows. A missing or unknown state counts as accepted.
    """
    state = F.when(meta("state").isin(*STATES), meta("state")).otherwise("accepted")
    claims = nodes.where("type = 'Claim'").where(state.isin(*states))
    claims = claims.select("id", F.coalesce("content", "label").alias("text"), meta_string("resourceId").alias("resource_id"), meta_string("videoId").alias("video_id"))
    if project is not None or area is not None or goal is not None:
        claims = claims.join(scoped_claims(edges, project, area, goal), "id", "left_semi")
    resources = nodes.where("type = 'Resource'").select(F.col("id").alias("resource_id"), F.col("label").alias("resource_title"), meta_string("url").alias("url"))
    watched = F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")
    found = claims.where("resource_id <> ''").join(resources, "resource_id")
    found = found.withColumn("url", F.coalesce(F.when(F.col("url") != "", F.col("url")), F.when(F.col("video_id") != "", watched))).where("url IS NOT NULL")
    derived = get_edges(edges, predicate="claimDerivedFrom").select(F.col("subject").alias("id"), F.col("object").alias("excerpt_id"))
    if postings is not None:
        try:
            fulltext.parsed(query)
        except fulltext.QueryError:
            postings = None
    if postings is None:
        needle = query.lower()
        holds = lambda c: F.lower(c).contains(needle)
        points = F.when(holds("text"), 2).otherwise(0) + F.when(holds("resource_title"), 1).otherwise(0)
        found = found.where(F.lit(needle != "")).withColumn("score", points)
    else:
        hits = fulltext.search(postings, query)
        of = lambda kind, name: hits.where(F.col("type") == kind).select(F.col("id").alias(name))
        quoted = derived.join(of("Excerpt", "excerpt_id"), "excerpt_id", "left_semi").select("id").distinct()
        for rows, key, worth in ((of("Claim", "id"), "id", 2), (quoted, "id", 1), (of("Resource", "resource_id"), "resource_id", 1)):
            found = found.join(rows.withColumn(f"_{key}{worth}", F.lit(worth)), key, "left")
        found = found.withColumn("score", F.coalesce("_id2", F.lit(0)) + F.coalesce("_id1", F.lit(0)) + F.coalesce("_resource_id1", F.lit(0)))
    found = found.where("score > 0")
    start = F.coalesce(meta("start").try_cast("double"), F.lit(0.0))
    excerpts = nodes.where("type = 'Excerpt'").select(F.col("id").alias("excerpt_id"), F.struct(start.alias("at"), F.col("id").alias("eid"), F.col("content").alias("content")).alias("e"))
    first = derived.join(excerpts, "excerpt_id").groupBy("id").agg(F.min("e").alias("e"))
    at = F.coalesce("e.at", F.lit(0.0))
    out = found.join(first, "id", "left").select(
        F.col("id").alias("claim_id"), F.trim("text").alias("claim_text"), "resource_id", "resource_title", "video_id", at.alias("at"), texts.timestamp(at).alias("time"),
        texts.timestamp_url(F.col("url"), at).alias("link"), texts.normalise(F.coalesce("e.content", F.lit(""))).alias("excerpt"), F.col("score").cast("int").alias("score"),
    )
    out = out.orderBy(F.desc("score"), "at", "claim_id")
    return out if limit is None else out.limit(limit)
