"""Operators outside llm: expectations restated, and every query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import evaluate, graph, segments, taxonomy
from lodestone.plans import queries as base
from lodestone.plans import claim_queries, eval_queries, text_queries  # noqa: F401 - add their queries to base

DATA = "/root/testdata/sf0.001"


def values(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(base.ORACLE[name])
    got = base.QUERIES[name](spark, DATA)
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    order = [want.columns.index(c) for c in names]
    assert values(got) == sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in want.fetchall()), key=repr)


def edges(spark, *triples):
    return spark.createDataFrame([(s, "p", o) for s, o in triples], "subject string, predicate string, object string")


def test_degree_ties_and_dangling_ends(spark):
    nodes = spark.createDataFrame([("topic-1", "Topic")], "id string, type string")
    out = graph.top_degree(nodes, edges(spark, ("topic-1", "ghost-1"), ("ghost-2", "topic-1"), ("ghost-1", "ghost-3")), 10)
    rows = sorted(map(tuple, out.collect()), key=lambda r: (-r[4], r[0]))
    assert rows == [("ghost-1", "unknown", 1, 1, 2), ("topic-1", "Topic", 1, 1, 2), ("ghost-2", "unknown", 0, 1, 1), ("ghost-3", "unknown", 1, 0, 1)]


def test_deleting_leaves_edges_unless_it_cascades(spark):
    nodes = spark.createDataFrame([("a", "T"), ("b", "T")], "id string, type string")
    links = edges(spark, ("a", "b"), ("b", "c"), ("c", "c"))
    gone = spark.createDataFrame([("a",)], "id string")
    kept, dangling = graph.delete_nodes(nodes, links, gone)
    assert [r["id"] for r in kept.collect()] == ["b"] and dangling.count() == 3
    assert graph.delete_nodes(nodes, links, gone, cascade=True)[1].count() == 2


def test_pages(spark):
    nodes = spark.createDataFrame([("task-2", "Task"), ("area-1", "Area"), ("task-1", "Task")], "id string, type string")
    ids = lambda **k: [r["id"] for r in graph.page(nodes, graph.NODE_ORDER, 1, **k).collect()]
    assert ids() == ["area-1"]
    assert ids(cursor="Area|area-1") == ["task-1"]
    assert ids(cursor="2") == ["task-2"]
    assert ids(cursor="No|such") == ["area-1"]


def test_pages_by_a_field_with_nulls(spark):
    """Pages of two, one after the other, give every row once and in order, from a null field on, too, both ways."""
    rows = [(f"n{i}", "T", None if i % 3 == 0 else f"c{i % 2}") for i in range(9)]
    nodes = spark.createDataFrame(rows, "id string, type string, content string")
    for descending in (False, True):
        want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
        if descending:
            want = sorted([r for r in rows if r[2]], key=lambda r: r[0])
            want = sorted(want, key=lambda r: r[2], reverse=True) + [r for r in rows if r[2] is None]
        got, cursor = [], None
        while True:
            part = graph.page(nodes, graph.NODE_ORDER, 2, cursor=cursor, first="content", descending=descending).collect()
            if not part:
                break
            got += [r["id"] for r in part]
            cursor = f"{part[-1]['type']}|{part[-1]['id']}"
        assert got == [r[0] for r in want]


def test_json_ld_groups_all_edges(spark):
    edges = base._graph(spark, DATA)[1]
    targets = base.QUERIES["graph_json_ld"](spark, DATA).select(F.size(F.split("targets", " ")).alias("n"))
    assert targets.agg(F.sum("n")).first()[0] == edges.count() and targets.where("n > 1").count() > 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    t = lambda s: text.tokens(F.lit(s))
    assert one(text.jaccard(t("cat dog"), t("cat dog bird"))) == pytest.approx(2 / 3)
    assert one(text.jaccard(t(""), t("a"))) == 0
    assert one(text.timestamp(F.lit(3670))) == "1:01:10"
    assert one(text.without_markup(F.lit("Hello <font>world</font> &amp; friend"))) == "Hello world & friend"
    assert one(text.without_markup(F.lit("I &lt;3 this talk"))) == "I <3 this talk"


def test_windows_and_selection(spark):
    rows = spark.createDataFrame([("v", i, s, 1.0 - i / 10) for i, s in enumerate([0.0, 120.0, 360.0])], "video string, id int, start double, score double")
    assert {r["window"]: r["n"] for r in segments.coverage(rows).collect()} == {0: 2, 1: 1}
    rows = spark.createDataFrame([("v", i, s, p) for i, (s, p) in enumerate([(0.0, 0.9), (10.0, 0.95), (310.0, 0.2), (320.0, 0.3), (700.0, 0.1)])], "video string, id int, start double, score double")
    assert sorted(r["id"] for r in segments.diverse(rows, 3, cap=1).collect()) == [1, 3, 4]


def test_circular_categories(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "d")], "id string, parent_id string")
    none = spark.createDataFrame([], "id string, category_id string")
    tags = spark.createDataFrame([], "id string, topic_ids array<string>")
    assert sorted(r["id"] for r in taxonomy.issues(c, none, tags).collect()) == ["a", "b", "c"]
    chain = spark.range(200).selectExpr("string(id) AS id", "CASE WHEN id > 0 THEN string(id - 1) END AS parent_id")
    assert taxonomy.circular(chain).count() == 0
    assert taxonomy.circular(chain.selectExpr("id", "CASE WHEN id = '0' THEN '199' ELSE parent_id END AS parent_id")).count() == 200


def test_correlation(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 4)], "a int, b int")
    assert 0.9 < evaluate.spearman(df, "a", "b").first()["rho"] < 1
    row = evaluate.spearman(df.selectExpr("a", "1 AS b"), "a", "b").first()
    assert row["rho"] is None and row["n"] == 4 and not row["reliable"]
    assert evaluate.spearman(df.limit(1), "a", "b").first()["rho"] is None
    assert evaluate.spearman(df.selectExpr("a", "double('NaN') AS b"), "a", "b").first()["rho"] is None
    many = spark.range(500).selectExpr("double(id * id % 101) AS a", "double(id * 7 % 37) AS b")
    want = many.toPandas().corr("spearman").iloc[0, 1]
    assert evaluate.spearman(many, "a", "b", buckets=8).first()["rho"] == pytest.approx(want)
