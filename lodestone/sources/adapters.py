"""Graph tables from the star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, key: str, label: str, metadata, content=None) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind.lower()}-"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("label"),
        (F.lit(None) if content is None else content).cast("string").alias("content"), F.to_json(metadata).alias("metadata"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, goals, projects, tasks and claims from nation, region, customer, orders and part."""
    read = lambda name: table(spark, sf_dir, name)
    none = F.struct(F.lit(1).alias("v"))
    state = F.when(F.col("p_size") % 4 == 0, "accepted").when(F.col("p_size") % 4 == 1, "draft").when(F.col("p_size") % 4 == 2, "rejected")
    parts = [
        _node(read("nation"), "Area", "n_nationkey", "n_name", none),
        _node(read("region"), "Goal", "r_regionkey", "r_name", none),
        _node(read("customer"), "Project", "c_custkey", "c_name", none),
        _node(read("orders"), "Task", "o_orderkey", "o_orderpriority", F.struct(F.col("o_orderstatus").alias("status"))),
        _node(read("part"), "Claim", "p_partkey", "p_name", F.struct(state.alias("state"), F.col("p_brand").alias("domain"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(df: DataFrame, s: str, sk: str, predicate: str, o: str, ok: str) -> DataFrame:
        return df.select(F.concat(F.lit(s), F.col(sk)).alias("subject"), F.lit(predicate).alias("predicate"), F.concat(F.lit(o), F.col(ok)).alias("object"))

    read = lambda name: table(spark, sf_dir, name)
    return (
        link(read("lineitem").select("l_orderkey", "l_partkey").distinct(), "task-", "l_orderkey", "taskMotivatedBy", "claim-", "l_partkey")
        .unionByName(link(read("orders"), "task-", "o_orderkey", "taskPartOfProject", "project-", "o_custkey"))
        .unionByName(link(read("customer"), "project-", "c_custkey", "projectInArea", "area-", "c_nationkey"))
        .unionByName(link(read("nation"), "area-", "n_nationkey", "relatedTo", "goal-", "n_regionkey"))
    )


def clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of conversations as resources, their turns as excerpts, what the assistant said as claims, and
    nations as references."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    key = lambda kind, *cols: F.concat_ws("-", F.lit(kind), *cols)
    resource = key("resource", "conv_id")

    def node(df: DataFrame, kind: str, id_, label, content, **meta) -> DataFrame:
        packed = F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()]))
        return df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), content.cast("string").alias("content"), packed.alias("metadata"))

    said = turns.where("role = 'assistant'")
    n = (F.col("conv_id") + F.col("turn")) % 4
    state = F.when(n == 0, "accepted").when(n == 1, "draft").when(n == 2, "rejected")
    nothing, x = F.lit(None), F.col("text")
    nations = table(spark, sf_dir, "nation")
    parts = [
        node(turns.select("conv_id").distinct(), "Resource", resource, F.concat(F.lit("Conversation "), "conv_id"), nothing, url=F.concat(F.lit("https://example.org/v?id="), "conv_id")),
        node(turns, "Excerpt", key("excerpt", "conv_id", "turn"), F.substring(x, 1, 40), x, resourceId=resource, start=F.col("turn") * 30.0, speaker=F.col("role")),
        node(said, "Claim", key("claim", "conv_id", "turn"), F.substring(x, 1, 120), x, resourceId=resource, state=state, method=F.when(F.col("turn") == 1, "heuristic")),
        node(nations, "Reference", key("reference", "n_nationkey"), F.col("n_name"), nothing, url=F.concat(F.lit("https://example.org/"), F.lower("n_name"))),
    ]
    def link(predicate: str, *to):
        return F.struct(F.lit(predicate).alias("predicate"), key(*to).alias("object"))

    before, ref, tag = (c.cast("string") for c in (F.col("turn") - 1, (F.col("conv_id") * 7 + F.col("turn")) % 25, F.col("turn") % 5))
    each = F.array(link("claimDerivedFrom", "excerpt", "conv_id", "turn"), link("claimDerivedFrom", "excerpt", "conv_id", before), link("claimMentionsReference", "reference", ref), link("aboutTag", "tag", tag))
    links = said.select(key("claim", "conv_id", "turn").alias("subject"), F.explode(each).alias("e")).select("subject", "e.*")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, links


def library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with sources: suppliers as resources (some without an address), parts as claims (some without content,
    resource or state) and as excerpts (some without a start), and the tasks, projects, areas and goals of `edges`."""
    read = lambda name: table(spark, sf_dir, name)
    k = F.col("p_partkey")
    name = lambda kind, key: F.concat(F.lit(kind + "-"), key)
    state = F.when(F.col("p_size") % 5 == 0, "accepted").when(F.col("p_size") % 5 == 1, "draft").when(F.col("p_size") % 5 == 2, "rejected").when(F.col("p_size") % 5 == 3, "odd")
    claim = F.struct(
        state.alias("state"), F.when(k % 11 != 0, name("resource", k % 12)).alias("resourceId"), F.when(k % 2 == 0, name("v", k)).alias("videoId"),
        F.when(k % 3 == 0, F.col("p_brand")).alias("domain"), (k % 100 / 100).alias("confidence"), F.when(k % 4 != 0, "heuristic").alias("method"),
    )
    supplier = F.col("s_suppkey")
    resource = F.struct(F.when(supplier % 5 != 0, F.concat(F.lit("https://example.org/w?id="), supplier)).alias("url"), F.when(supplier % 3 == 0, "Channel").alias("channelName"))
    excerpt = F.struct(F.when(k % 6 != 0, F.col("p_size") * 10.0).alias("start"), name("resource", k % 12).alias("resourceId"))
    parts = [
        _node(read("supplier"), "Resource", "s_suppkey", "s_name", resource),
        _node(read("part"), "Claim", "p_partkey", "p_name", claim, F.when(k % 3 != 0, F.concat("p_type", F.lit("  "), "p_name"))),
        _node(read("part"), "Excerpt", "p_partkey", "p_brand", excerpt, F.concat_ws(" ", "p_brand", "p_type", "p_name")),
    ]
    out = nodes(spark, sf_dir).where("type <> 'Claim'")
    for p in parts:
        out = out.unionByName(p)
    link = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    links = (
        edges(spark, sf_dir)
        .unionByName(link(read("part").where("p_partkey % 4 <> 0"), name("claim", k), "claimDerivedFrom", name("excerpt", k)))
        .unionByName(link(read("part").where("p_partkey % 7 <> 0"), name("claim", k), "claimDerivedFrom", name("excerpt", k + 1)))
        .unionByName(link(read("customer"), name("project", F.col("c_custkey")), "projectServesGoal", name("goal", F.col("c_custkey") % 5)))
    )
    return out, links
