"""Categories, topics, tags and their assignment: registry tables as batch operations, alias lookup, consistency.

Tables: categories (id, name, parent_id, sort_order), topics (id, name, category_id, sort_order),
tags (id, name, topic_ids, aliases, color), assignments (node_id, tag_id, confidence, source). Adding, updating and assigning
is one upsert by key, in which the last row by `seq` wins (of equal ones the first by `place`, if given); deleting never cascades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources import store

SOURCES = ("manual", "automatic", "imported", "inferred")
KEYS = {"categories": ["id"], "topics": ["id"], "tags": ["id"], "assignments": ["node_id", "tag_id"]}


def put(table: str, held: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after a batch of adds or updates (all columns of `held`, and seq); an existing key is overwritten."""
    keys = KEYS[table]
    return graph.upsert(held, incoming, keys, [c for c in held.columns if c not in keys]).drop("action")


def remove(table: str, held: DataFrame, keys: DataFrame) -> DataFrame:
    return held.join(keys.select(*KEYS[table]), KEYS[table], "left_anti")


def assigned(assignments: DataFrame, incoming: DataFrame) -> DataFrame:
    """assignments after a batch (node_id, tag_id, confidence, source, seq[, place]): confidence is 1 and source manual where they are null."""
    filled = incoming.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "source": F.coalesce("source", F.lit("manual"))})
    return put("assignments", assignments, filled)


def assignments_of(assignments: DataFrame, node: str) -> DataFrame:
    return assignments.where(F.col("node_id") == node)


def list_categories(categories: DataFrame, parent: str | None = None) -> DataFrame:
    rows = categories if parent is None else categories.where(F.col("parent_id") == parent)
    return rows.orderBy("sort_order", "id")


def list_topics(topics: DataFrame, category: str | None = None) -> DataFrame:
    rows = topics if category is None else topics.where(F.col("category_id") == category)
    return rows.orderBy("sort_order", "id")


def list_tags(tags: DataFrame, topic: str | None = None) -> DataFrame:
    if topic is not None:
        tags = tags.where(F.array_contains("topic_ids", topic))
    return tags.orderBy("name", "id")


def tag_errors() -> Column:
    """Why a tag is refused, or null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(empty("id"), "id")
        .when(empty("name"), "name")
        .when(F.coalesce(F.size("topic_ids"), F.lit(0)) < 1, "topic_ids")
        .when(F.col("color").isNotNull() & ~F.col("color").rlike("^#[0-9A-Fa-f]{6}\\z"), "color")
    )


def assignment_errors() -> Column:
    """Why an assignment is refused, or null."""
    return (
        F.when(F.coalesce(F.col("node_id"), F.lit("")) == "", "node_id")
        .when(F.coalesce(F.col("tag_id"), F.lit("")) == "", "tag_id")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")
        .when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(True)), "source")
    )


def find_by_alias(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases(alias) -> (alias, id): names and aliases without case; the later tag (by seq) wins."""
    known = tags.select("id", "seq", F.explode(F.concat(F.array("name"), "aliases")).alias("a")).select(F.lower("a").alias("k"), "id", "seq")
    last = known.withColumn("_rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("seq")))).where("_rn = 1")
    return aliases.withColumn("k", F.lower("alias")).join(last, "k").select("alias", "id")


def tagged_content(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """(node_id, tag_id): tags whose name or an alias stands in a node's content, in any case.

    A content meets only the names whose first three characters it holds (the first one, for names shorter than that).
    """
    names = tags.select(F.col("id").alias("tag_id"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.lower(a)))).alias("name")).where("name <> ''")
    told = nodes.select(F.col("id").alias("node_id"), F.lower("content").alias("text")).where("text <> ''")
    # equal contents are searched once; merged, as Spark takes exploded contents for small and would send them to the driver
    held = told.select("text").distinct()
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    long = names.where(F.length("name") >= 3).withColumn("gram", F.substring("name", 1, 3))
    texts = held.where(F.length("text") >= 3).withColumn("gram", F.explode(F.array_distinct(grams(F.col("text")))))
    met = texts.join(long.hint("merge"), "gram").where(F.contains("text", "name")).select("text", "tag_id")
    short = names.where(F.length("name") < 3).withColumn("gram", F.substring("name", 1, 1))
    chars = held.withColumn("gram", F.explode(F.array_distinct(F.split("text", ""))))
    met = met.unionByName(chars.join(short.hint("merge"), "gram").where(F.contains("text", "name")).select("text", "tag_id")).distinct()
    return told.join(met.hint("merge"), "text").select("node_id", "tag_id").distinct()


def circular(categories: DataFrame) -> DataFrame:
    """(id): categories in a cycle of parents, and those that lead into one; a parent that doesn't exist ends the walk.

    Parents are followed by doubling: after k rounds `up` is the ancestor 2^k steps up, or null past a root. Each round is
    written to the shared folder, so the plan doesn't grow, and the rounds end when all are null or their number passes log2.
    """
    spark = categories.sparkSession
    known = categories.select("id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("up"))
    up = known.join(categories.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select("id", "up")
    for _ in range(max(1, categories.count().bit_length())):
        path = store.scratch(spark, "ancestors")
        up.write.parquet(path)
        up = spark.read.schema(up.schema).parquet(path)
        if up.isEmpty():
            break
        up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up"))
    return up.select("id").distinct()


def issues(categories: DataFrame, topics: DataFrame, tags: DataFrame) -> DataFrame:
    """(severity, code, id): topics without their category, tags none or not all of whose topics exist (a tag without topics
    has none), categories in or into a cycle."""
    orphans = topics.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti").select(F.lit("error").alias("severity"), F.lit("ORPHANED_TOPIC").alias("code"), "id")
    each = tags.select("id", F.explode_outer("topic_ids").alias("t")).join(topics.select(F.col("id").alias("t"), F.lit(1).alias("there")), "t", "left")
    counted = each.groupBy("id").agg(F.count("*").alias("n"), F.count("there").alias("found")).where("found < n")
    none = F.col("found") == 0
    partial = counted.select(F.when(none, "error").otherwise("warning").alias("severity"), F.when(none, "ORPHANED_TAG").otherwise("PARTIAL_ORPHAN_TAG").alias("code"), "id")
    return orphans.unionByName(partial).unionByName(circular(categories).select(F.lit("error").alias("severity"), F.lit("CIRCULAR_CATEGORY").alias("code"), "id"))


def summary(found: DataFrame) -> DataFrame:
    """(valid, errors, warnings) of the issues."""
    of = lambda kind: F.count_if(F.col("severity") == kind)
    return found.agg((of("error") == 0).alias("valid"), of("error").alias("errors"), of("warning").alias("warnings"))
