"""Reviewing claims, tasks, and the areas, goals and projects they belong to, as batches of upserts.

Each command takes the graph's nodes and edges and a table of requests, and gives the nodes and edges to upsert (with seq, by which
the last of a key wins); `applied` puts them into the graph. Commands refuse requests instead of failing: `refused` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import claims, graph

INBOX = "project-inbox"
NODE_COLUMNS = ("id", "type", "label", "content", "metadata", "seq")
EDGE_COLUMNS = ("subject", "predicate", "object", "metadata", "seq")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _given(c: str) -> Column:
    """The trimmed value, or null where it is blank."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))


def _node(df: DataFrame, kind: str, id_: Column, label: Column, content: Column, metadata: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), content.cast("string").alias("content"), metadata.alias("metadata"), "seq")


def _edge(df: DataFrame, subject: str, predicate: str, object_: str) -> DataFrame:
    return df.select(F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.col(object_).alias("object"), F.lit("{}").alias("metadata"), "seq")


def applied(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the batch, with `action` for each node and edge."""
    return graph.upsert(nodes, new_nodes, ["id"], ["type", "label", "content", "metadata"]), graph.upsert_edges(edges, new_edges)


def project_id(c: str) -> Column:
    """The inbox where none is given."""
    given = _given(c)
    return F.when(given.isNull() | (F.lower(given) == "inbox"), F.lit(INBOX)).otherwise(given)


def _missing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted nodes whose id the graph lacks: existing tags and projects stay as they are."""
    return wanted.join(nodes.select("id"), "id", "left_anti")


def _tags(nodes: DataFrame, requests: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """TopicTag nodes still missing and aboutTag edges for requests (subject, tags array, seq); blank tags go."""
    each = requests.select(subject, "seq", F.explode("tags").alias("tag")).where(F.trim("tag") != "")
    each = each.withColumn("tag_id", text.slug_id("tag", F.col("tag")))
    made = _node(each, "TopicTag", F.col("tag_id"), F.trim("tag"), F.lit(None), _json(slug=F.regexp_replace("tag_id", "^tag-", "")))
    return _missing(nodes, made.dropDuplicates(["id"])), _edge(each, subject, "aboutTag", "tag_id")


def _projects(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    inbox = F.col("project") == INBOX
    made = rows.select("project", "seq").dropDuplicates(["project"])
    label, slug = F.when(inbox, "Inbox").otherwise(F.col("project")), F.when(inbox, "inbox").otherwise(F.col("project"))
    return _missing(nodes, _node(made, "Project", F.col("project"), label, F.lit(None), _json(slug=slug, default=inbox)))


def tasks_from_claims(nodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claim_id, title, project, tags, seq) -> nodes, edges and (claim_id, task_id, project) of each task; requests for no claim are refused."""
    known = nodes.where("type = 'Claim'").select(F.col("id").alias("claim_id"), F.col("label").alias("_label"))
    rows = requests.join(known, "claim_id").withColumn("project", project_id("project")).withColumn("title", F.coalesce(_given("title"), F.col("_label")))
    rows = rows.withColumn("task", text.hash_id("task", F.col("project"), F.col("claim_id"), F.col("title")))
    data = _json(projectId=F.col("project"), sourceClaimId=F.col("claim_id"), status=F.lit("open"))
    tags, about = _tags(nodes, rows, "task")
    made = _node(rows, "Task", F.col("task"), F.col("title"), F.col("title"), data).unionByName(_projects(nodes, rows)).unionByName(tags)
    links = _edge(rows, "task", "taskMotivatedBy", "claim_id").unionByName(_edge(rows, "task", "taskPartOfProject", "project")).unionByName(about)
    return made, links, rows.select("claim_id", F.col("task").alias("task_id"), "project")


def standalone_tasks(nodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title, project, tags, seq) -> nodes and edges; blank titles are refused."""
    rows = requests.withColumn("title", _given("title")).where("title IS NOT NULL").withColumn("project", project_id("project"))
    rows = rows.withColumn("task", text.hash_id("task", F.col("project"), F.col("title")))
    data = _json(projectId=F.col("project"), status=F.lit("open"), source=F.lit("manual"))
    tags, about = _tags(nodes, rows, "task")
    made = _node(rows, "Task", F.col("task"), F.col("title"), F.col("title"), data).unionByName(_projects(nodes, rows)).unionByName(tags)
    return made, _edge(rows, "task", "taskPartOfProject", "project").unionByName(about)


def reviewed(nodes: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claim_id, state, text, tags, task_title, task_project, seq) -> nodes and edges to upsert, and the refused actions.

    State and text are changed where they are given, the label is the text cut to 120 characters; tags are made and linked; with a task
    title a task is made of the claim. Actions on no claim are refused: with any refused, an all-or-nothing caller applies nothing.
    """
    wanted = actions.withColumn("claim_id", F.trim("claim_id"))
    held = nodes.where("type = 'Claim'").select(F.col("id").alias("claim_id"), "label", "content", "metadata")
    refused = wanted.join(held.select("claim_id"), "claim_id", "left_anti")
    rows = wanted.join(held, "claim_id")
    said = F.coalesce(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", text.normalise(F.col("text"))), F.col("content"))
    parsed = F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>")
    changed = F.map_concat(F.map_filter(parsed, lambda k, v: k != "state"), F.create_map(F.lit("state"), F.to_variant_object(F.array("state")).cast("array<variant>")[0]))
    data = F.when(F.col("state").isNotNull(), F.to_json(changed)).otherwise(F.col("metadata"))
    made = _node(rows, "Claim", F.col("claim_id"), F.substring(F.coalesce(said, "label"), 1, 120), said, data)
    tags, about = _tags(nodes, rows, "claim_id")
    asked = rows.where(F.trim(F.coalesce("task_title", F.lit(""))) != "").select("claim_id", F.col("task_title").alias("title"), F.col("task_project").alias("project"), "tags", "seq")
    task_nodes, task_edges, _ = tasks_from_claims(nodes, asked)
    both = tags.unionByName(task_nodes).dropDuplicates(["id"])
    return made.unionByName(both), about.unionByName(task_edges).dropDuplicates(["subject", "predicate", "object"]), refused


def created(kind: str, nodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas, goals or projects: (given_id, name, description, area, goal, seq) -> nodes, edges, and the refused requests.

    The id is the given one, or a slug of the name. A blank name, or an area or goal that is given and isn't there, is refused. Goals link
    from their area (relatedTo), projects to their area (projectInArea) and goal (projectServesGoal).
    """
    lower = kind.lower()
    rows = requests.withColumn("name", F.trim("name")).withColumn("id", text.slug_id(lower, F.col("name"), F.col("given_id")))
    rows = rows.withColumns({"area": _given("area") if kind != "Area" else F.lit(None).cast("string"), "goal": _given("goal") if kind == "Project" else F.lit(None).cast("string")})
    for column, type_ in (("area", "Area"), ("goal", "Goal")):
        there = nodes.where(F.col("type") == type_).select(F.col("id").alias(column), F.lit(True).alias(f"_{column}"))
        rows = rows.join(there, column, "left")
    fine = (F.coalesce("name", F.lit("")) != "") & (F.col("area").isNull() | F.col("_area")) & (F.col("goal").isNull() | F.col("_goal"))
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    good, refused = rows.where("_fine"), rows.where("NOT _fine").select(*requests.columns)
    slug = F.when(F.col("id").startswith(lower + "-"), F.substring("id", len(lower) + 2, 1 << 20)).otherwise(text.slug(F.col("name")))
    described = _given("description")
    made = _node(good, kind, F.col("id"), F.col("name"), described, _json(description=described, slug=slug, areaId=F.col("area"), goalId=F.col("goal")))
    in_area, in_goal = good.where("area IS NOT NULL"), good.where("goal IS NOT NULL")
    links = _edge(in_area, "area", "relatedTo", "id") if kind == "Goal" else _edge(in_area, "id", "projectInArea", "area")
    return made, links.unionByName(_edge(in_goal, "id", "projectServesGoal", "goal")), refused


def task_contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, title, project_id, project, tags, claims, text) of every task: its first project, the labels of its known tags, its known
    claims with first excerpt, time and source, and all of it told as text. Tags and claims come in the order of their ids."""
    tasks = nodes.where("type = 'Task'").select(F.col("id").alias("task_id"), F.col("label").alias("title"))
    first = graph.get_edges(edges, predicate="taskPartOfProject").groupBy(F.col("subject").alias("task_id")).agg(F.min("object").alias("project_id"))
    projects = nodes.select(F.col("id").alias("project_id"), F.col("label").alias("project"))
    label = nodes.select(F.col("id").alias("object"), F.col("label").alias("tag"))
    tags = graph.get_edges(edges, predicate="aboutTag").join(label, "object").groupBy(F.col("subject").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("object", "tag"))).alias("tags"))
    motivated = graph.get_edges(edges, predicate="taskMotivatedBy").select(F.col("subject").alias("task_id"), F.col("object").alias("id"))
    known = nodes.select("id", F.trim(F.coalesce("content", "label")).alias("claim"), graph.meta("resourceId").alias("resource"))
    source = nodes.select(F.col("id").alias("resource"), F.col("label").alias("source"), graph.meta("url").alias("own_url"))
    rows = motivated.join(known, "id").join(source, "resource", "left").join(claims.first_excerpts(nodes, edges), "id", "left")
    url = F.coalesce("own_url", F.when(F.col("resource") != "", F.concat(F.lit("https://www.youtube.com/watch?v="), F.regexp_replace("resource", "youtube-", ""))))
    at = F.col("excerpt.at")
    told = F.concat_ws(
        "\n", F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("["), text.timestamp(at), F.lit("] ")), F.lit("")), "claim"), F.concat(F.lit("  "), text.timestamp_url(url, at)),
        F.concat(F.lit("  Excerpt: "), text.shortened(F.col("excerpt.content"))), F.concat(F.lit("  Source: "), F.when(F.col("source") != "", F.col("source"))),
    )
    each = rows.select("task_id", F.struct("id", told.alias("told")).alias("c")).groupBy("task_id").agg(F.array_sort(F.collect_list("c")).alias("claims"))
    out = tasks.join(first, "task_id", "left").join(projects, "project_id", "left").join(tags, "task_id", "left").join(each, "task_id", "left")
    labels = F.transform("tags", lambda t: t["tag"])
    body = F.concat_ws(
        "\n", F.concat(F.lit("Task: "), "title", F.lit(" ("), "task_id", F.lit(")")), F.concat(F.lit("Project: "), "project", F.lit(" ("), "project_id", F.lit(")")),
        F.concat(F.lit("Tags: "), F.when(F.size("tags") > 0, F.array_join(labels, ", "))), F.lit("Claims:"), F.coalesce(F.array_join(F.transform("claims", lambda c: c["told"]), "\n"), F.lit("- None")),
    )
    return out.select("task_id", "title", F.when(F.col("project").isNotNull(), F.col("project_id")).alias("project_id"), "project", labels.alias("tags"), F.transform("claims", lambda c: c["id"]).alias("claims"), body.alias("text"))


def claim_states(states: str | None, drafts: bool = False, rejected: bool = False) -> tuple[str, ...]:
    """The states a comma-separated list names; without any known one, accepted and what the flags add."""
    named = [s for part in (states or "").split(",") if (s := part.strip().lower()) in graph.STATES]
    if named:
        return tuple(dict.fromkeys(named))
    return ("accepted", *(["draft"] if drafts else []), *(["rejected"] if rejected else []))
