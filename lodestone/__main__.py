"""python -m lodestone VERB ...: the graph's verbs over Parquet tables `nodes` and `edges` in a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import claims, exports, fulltext, graph, planning, taxonomy


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("verb", choices=["stats", "search", "related", "review", "task", "dossier", "gephi", "json-ld", "validate"])
    parser.add_argument("folder", help="holds nodes and edges; for validate, categories, topics and tags")
    parser.add_argument("subject", nargs="?", default="", help="a query, claim or task")
    parser.add_argument("--out", help="a folder to write to; without it, rows are printed")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--states")
    parser.add_argument("--include-drafts", action="store_true")
    parser.add_argument("--include-rejected", action="store_true")
    for scope in ("project", "area", "goal", "resource"):
        parser.add_argument(f"--{scope}")
    parser.add_argument("--predicates", default="")
    parser.add_argument("--types", default="")
    parser.add_argument("--labels", action="store_true")
    parser.add_argument("--fulltext", action="store_true")
    return parser


def rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What a verb gives as a table."""
    read = lambda name: spark.read.parquet(f"{args.folder}/{name}")
    if args.verb == "validate":
        return taxonomy.issues(read("categories"), read("topics"), read("tags"))
    nodes, edges = read("nodes"), read("edges")
    states = planning.claim_states(args.states, args.include_drafts, args.include_rejected)
    listed = lambda x: [p.strip() for p in x.split(",") if p.strip()]
    if args.verb == "search":
        return graph.search_claims(nodes, edges, args.subject, states, args.limit, args.project, args.area, args.goal, fulltext.index(nodes) if args.fulltext else None)
    if args.verb == "related":
        return claims.related(nodes, edges, args.subject, args.include_drafts, args.limit)
    if args.verb == "review":
        return claims.review_queue(nodes, edges, states if args.states else ("draft",), args.resource, args.limit)
    if args.verb == "task":
        return planning.task_contexts(nodes, edges).where(f"task_id = '{args.subject}'" if args.subject else "true")
    if args.verb == "dossier":
        return claims.dossiers(nodes, edges, states)
    if args.verb == "gephi":
        kept, links = exports.gephi_lines(nodes, edges, listed(args.predicates), listed(args.types), args.labels)
        return kept.unionByName(links)
    if args.verb == "json-ld":
        return exports.json_ld(nodes, edges)
    return graph.top_degree(nodes, edges, args.limit)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.verb == "stats" and not args.out:
        print(exports.statistics_text(spark.read.parquet(f"{args.folder}/nodes"), spark.read.parquet(f"{args.folder}/edges"), args.limit))
        return 0
    out = rows(spark, args)
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        for r in out.limit(args.limit).collect():
            print("\t".join("" if v is None else str(v) for v in r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
