"""Exports as text: JSON-LD documents, tables for graph drawing, playlist dossiers, statistics, evaluation reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import claims, graph

# Predicates of the graph, and keys that metadata cannot take over in a JSON-LD node.
PREDICATES = (
    "relatedTo", "partOf", "references", "derivedFrom", "createdBy", "taggedWith", "supersedes", "resourceHasExcerpt", "claimDerivedFrom",
    "claimMentionsReference", "aboutTag", "taskMotivatedBy", "taskPartOfProject", "projectServesGoal", "projectInArea", "taskDependsOn",
)
RESERVED = ("@id", "@type", "id", "type", "schemaVersion", "label", "content", "createdAt", "updatedAt", "constructor", "prototype", *PREDICATES)


def _quoted(x: Column) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.array(x))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def json_ld(nodes: DataFrame, edges: DataFrame, base: str = "urn:graph:node:") -> DataFrame:
    """(id, document) of each node: its fields, its metadata but for reserved keys and those that begin with __, and by predicate the
    address of its target, or of its targets in order where it has several. Empty content is left out; targets need not exist."""
    uri = lambda x: _quoted(F.concat(F.lit(base), x))
    grouped = graph.json_ld_links(nodes, edges)
    several = F.concat(F.lit("["), F.array_join(F.transform("targets", uri), ","), F.lit("]"))
    value = F.when(F.size("targets") == 1, uri(F.element_at("targets", 1))).otherwise(several)
    links = grouped.select(F.col("subject").alias("id"), F.struct("predicate", value.alias("v")).alias("l")).groupBy("id").agg(F.array_sort(F.collect_list("l")).alias("links"))
    held = F.map_filter(F.try_variant_get(F.try_parse_json(graph.metadata()), "$", "map<string,variant>"), lambda k, v: ~k.isin(*RESERVED) & ~k.startswith("__"))
    own = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(_quoted(k), F.lit(":"), F.to_json(F.element_at(held, k))))
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), _quoted(c))
    stamps = [field(name, F.col(c)) for c, name in (("created_at", "createdAt"), ("updated_at", "updatedAt")) if c in nodes.columns]
    fixed = [field("@id", F.concat(F.lit(base), "id")), field("@type", F.col("type")), field("label", F.coalesce("label", F.lit(""))), F.when(F.col("content") != "", field("content", F.col("content"))), *stamps]
    parts = F.concat_ws(",", *fixed, F.coalesce(own, F.array().cast("array<string>")), F.coalesce(F.transform("links", lambda x: F.concat(_quoted(x["predicate"]), F.lit(":"), x["v"])), F.array().cast("array<string>")))
    return nodes.join(links, "id", "left").select("id", F.concat(F.lit("{"), parts, F.lit("}")).alias("document"))


def json_ld_file(documents: DataFrame, path: str, context: dict, version: int = 1) -> None:
    """One document: context, version and the nodes by id, written as lines of text in parts; each line but the first and last is a node."""
    spark = documents.sparkSession
    head = spark.createDataFrame([(0, "", '{"@context":' + json.dumps(context) + f',"schemaVersion":{version},"@graph":[')], "part int, id string, value string")
    tail = spark.createDataFrame([(2, "", "]}")], "part int, id string, value string")
    last = documents.agg(F.max("id").alias("m"))
    lines = documents.join(F.broadcast(last)).select(F.lit(1).alias("part"), "id", F.concat("document", F.when(F.col("id") == F.col("m"), "").otherwise(",")).alias("value"))
    head.unionByName(lines).unionByName(tail).orderBy("part", "id").select("value").write.text(path)


def gephi_lines(nodes: DataFrame, edges: DataFrame, predicates: list[str] | None = None, types: list[str] | None = None, labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, line) of the node and edge tables for graph drawing, without their headers: a field is quoted where it must be."""
    kept, links = graph.gephi(nodes, edges, predicates, types)
    field = lambda c: scalars.csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = ["id", *(["label"] if labels else []), "type"]
    return kept.select(F.col("id").alias("key"), F.concat_ws(",", *map(field, own)).alias("line")), links.select(F.concat_ws("|", "source", "type", "target").alias("key"), F.concat_ws(",", *map(field, ("source", "target", "type", "weight"))).alias("line"))


def statistics_text(nodes: DataFrame, edges: DataFrame, top: int = 10) -> str:
    """Counts by type, predicate and claim state, sorted by name, and the nodes with most edges; empty sections are left out."""
    sections = []
    for title, df, key in (("Nodes", graph.node_counts(nodes), "type"), ("Edges", graph.edge_counts(edges), "predicate"), ("Claim states", graph.claim_states(nodes), "state")):
        rows = sorted((r[key], r["n"]) for r in df.collect())
        if rows:
            sections.append("\n".join([f"{title}:", *(f"  {k}: {n}" for k, n in rows)]))
    best = sorted(graph.top_degree(nodes, edges, top).collect(), key=lambda r: (-r["degree"], r["id"]))
    if best:
        sections.append("\n".join(["Top nodes:", *(f"  {r['id']} ({r['type']}): in={r['in_degree']} out={r['out_degree']} total={r['degree']}" for r in best)]))
    return "\n".join(sections)


def playlist_dossiers(nodes: DataFrame, edges: DataFrame, playlists: DataFrame, states: tuple[str, ...] = ("accepted",)) -> tuple[DataFrame, DataFrame]:
    """(playlist, title, url, videos array<resource id>) -> (playlist, n_videos, n_claims, markdown), and (playlist, missing) of those
    with a video that is no resource; these have no dossier. A video's claims are the lines its own dossier has."""
    wanted = playlists.select("playlist", F.posexplode("videos").alias("place", "resource_id"))
    parts = claims.dossiers(nodes, edges, states, level="##")
    joined = wanted.join(parts, "resource_id", "left")
    missing = joined.where("title IS NULL AND markdown IS NULL").groupBy("playlist").agg(F.array_sort(F.collect_list("resource_id")).alias("missing"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    mark = F.when(slug == "", F.concat(F.lit("video-"), (F.col("place") + 1).cast("string"))).otherwise(slug)
    entry = F.concat((F.col("place") + 1).cast("string"), F.lit(". ["), F.coalesce("title", F.lit("")), F.lit("](#"), mark, F.lit(")"))
    each = joined.select("playlist", F.struct("place", entry.alias("entry"), "markdown", "n_claims").alias("v"))
    grouped = each.join(missing.select("playlist"), "playlist", "left_anti").groupBy("playlist").agg(F.array_sort(F.collect_list("v")).alias("v"))
    rows = playlists.select("playlist", "title", "url").join(grouped, "playlist")
    said = lambda lead, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c)).otherwise("")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Playlist Dossier"), said(": ", F.col("title"))), F.lit(""), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("- Playlist: "), "url")),
        F.concat(F.lit("- Videos: "), F.size("v").cast("string")), F.lit(""), F.lit("## Index"), F.lit(""), F.array_join(F.transform("v", lambda x: x["entry"]), "\n"), F.lit(""), F.array_join(F.transform("v", lambda x: x["markdown"]), "\n"),
    )
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n_claims"])
    return rows.select("playlist", F.size("v").alias("n_videos"), total.alias("n_claims"), body.alias("markdown")), missing


def report_markdown(leaderboard: DataFrame, dimension: str = "overall", most: int = 50) -> str:
    """The first `most` of a leaderboard as a Markdown table."""
    rows = leaderboard.where(F.col("dimension") == dimension).where(F.col("rank") <= most).orderBy("rank").select("rank", scalars.table_cell(F.col("model")).alias("model"), "mean").collect()
    return "\n".join(["| Rank | Model | Score |", "| --- | --- | --- |", *(f"| {r['rank']} | {r['model']} | {r['mean']:.2f} |" for r in rows)])


def report_json(tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """A report's tables (statistics, leaderboards, caveats; each of at most `most` rows, or it is refused) as one JSON object."""
    out = {}
    for name, df in tables.items():
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows; write it as a table")
        out[name] = sorted((json.loads(r["r"]) for r in rows), key=lambda r: json.dumps(r, sort_keys=True))
    return json.dumps(out, indent=2, sort_keys=True)


def draft_path(path: str) -> str:
    """Where the second dossier goes, which holds drafts as well."""
    return path if path.endswith(".draft.md") else (path[:-3] if path.endswith(".md") else path) + ".draft.md"


def split_states(nodes: DataFrame, edges: DataFrame, path: str, states: tuple[str, ...] = ("accepted",)) -> None:
    """Two tables of dossiers: of the states asked for, and of accepted claims and drafts."""
    claims.dossiers(nodes, edges, states).write.mode("overwrite").parquet(path)
    claims.dossiers(nodes, edges, ("accepted", "draft")).write.mode("overwrite").parquet(draft_path(path))
