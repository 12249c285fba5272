"""Routing, runs with an injected client, resumable stages, full-text queries and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as cli
from lodestone.functions import routing
from lodestone.operators import fulltext, graph, matrix


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_routing(spark):
    def route(said, domain=None):
        p = routing.profile(F.lit(said))
        return tuple(one(spark, routing.routed(F.lit(domain).cast("string"), p)))[:3]

    assert route("We use slides and a deck for the client.") == ("business-framework", "transcript-profile", pytest.approx(0.8))
    assert route("plain talk") == ("generic-hierarchy", "fallback-default", pytest.approx(0.4))
    assert route("LDL and apob and cholesterol, lipoprotein and aspirin", "Finance") == ("clinical-risk-management", "transcript-profile", pytest.approx(0.95))
    assert route("plain", "Cardiology") == ("clinical-risk-management", "metadata", pytest.approx(0.85))
    p = one(spark, routing.profile(F.lit("Five types. Two steps! mg/dl, slides")))
    assert (p["lists"], p["clinical"], p["business"]) == (4, 1, 1) and p["signals"] == ["list:five", "list:types", "list:steps", "list:enumeration-pattern", "clinical:mg/dl", "business:slides"]
    lists = routing.profile(F.lit("There are five types and four steps of a framework"))
    none = F.array().cast("array<string>")
    claims = lambda *c: F.array(*map(F.lit, c))
    retry = lambda c, pack, prof=lists: tuple(one(spark, routing.retried(c, F.lit(pack), prof)))
    assert retry(none, "x") == (True, "too-few-claims", "enumeration-framework-v2") and retry(none, "enumeration-framework-v2") == (False, None, None)
    assert retry(claims("a"), "x") == (True, "missing-root-claim", "enumeration-framework-v2")
    assert retry(claims("there is a framework"), "business-framework") == (True, "missing-enumeration-framework", "enumeration-framework")
    assert retry(claims("There are five types of framework"), "x") == (False, None, None)
    clinical = routing.profile(F.lit("ldl apob niacin"))
    assert retry(claims("there is"), "x", clinical) == (True, "low-domain-term-recall", "clinical-risk-management-v2")
    assert one(spark, routing.completeness(claims("There are five types of framework"), lists)) == pytest.approx(0.35 + 0.2 + 0.25 + 0.2 / 8)
    s = one(spark, routing.structure(F.lit("Three core slide layouts. First, avoid clutter; a model is a matrix.")))
    assert s["tags"] == ["finite-set", "definition-first", "framework", "process", "recommendation"] and (s["numbers"], s["nouns"], s["avoids"]) == (["three"], ["layouts"], True)
    wanted = routing.structure(F.lit("Three core layouts. Avoid clutter."))
    assert tuple(one(spark, routing.assessed(claims("There are three layouts: a, b and c"), wanted))) == (0.8, True, True, False, True)
    assert tuple(one(spark, routing.assessed(claims("x"), routing.structure(F.lit("nothing"))))) == (0.0, False, False, False, False)


def client():
    """What a partition asks; made inside a function, so that it travels by value."""

    def answer(prompt):
        if "fail" in prompt:
            raise TimeoutError("client timeout")
        if prompt.startswith("judge: "):
            n = 9.0 if "judge: a" in prompt else 20.0
            return json.dumps({"completeness": n, "accuracy": n, "topic_coverage": n, "atomicity": n, "overall": n})
        if "odd" in prompt:
            return "no json"
        return "```json\n" + json.dumps({"claims": [{"text": "One claim", "start": 1, "confidence": 0.5, "excerpt_ids": ["e"]}, {"text": " ", "excerpt_ids": ["e"]}]}) + "\n```"

    return lambda: answer


def test_extraction_with_a_client_and_a_cache(spark):
    excerpts = spark.createDataFrame([("v", "e1", 0.0, "good words"), ("v", "e2", 65.0, 'and """more"""'), ("w", "e3", 0.0, "odd"), ("x", "e4", 0.0, "fail")], "video string, id string, start double, content string")
    chunks = excerpts.selectExpr("video", "0 AS chunk", "int(start) AS place", "id")
    prompts = matrix.chunk_prompts(chunks, excerpts)
    assert prompts.where("video = 'v'").first()["prompt"] == "[0:00] (e1) good words\n[1:05] (e2) and '''more'''"
    cache = spark.createDataFrame([], "key string, answer string")
    answers, fresh = matrix.cached_answers(prompts, cache, client(), F.lit("model"))
    claims, bad = matrix.claims_of(answers)
    assert [(r["video"], r["text"], r["excerpt_ids"]) for r in claims.collect()] == [("v", "One claim", ["e"])]
    assert [r["video"] for r in bad.collect()] == ["w"] and [r["error"] for r in answers.where("error IS NOT NULL").collect()] == ["client timeout"]
    assert fresh.count() == 2

    again, _ = matrix.cached_answers(prompts.where("video <> 'x'"), spark.createDataFrame(fresh.collect(), fresh.schema), lambda: lambda p: 1 / 0, F.lit("model"))
    assert again.where("error IS NULL").count() == 2


def test_cells_and_judges(spark):
    videos = spark.createDataFrame([("v", "talk"), ("w", "fail")], "video string, prompt string")
    grid = matrix.cells(videos, ["m1", "m2"], ["raw", "v1"])
    assert grid.count() == 8
    scores, failures = matrix.judged(grid.where("model = 'm1' AND variant = 'raw'"), ["a", "b"], client())
    assert [(r["video"], r["judge"], r["overall"]) for r in scores.collect()] == [("v", "a", 9.0)]
    assert sorted((r["video"], r["judge"], r["class"]) for r in failures.collect()) == [("v", "b", "parse-or-schema"), ("w", "a", "timeout"), ("w", "b", "timeout")]
    passes = spark.createDataFrame([("v", 0, 0.5, "x"), ("v", 1, 0.5, "y"), ("w", 0, 0.1, "x"), ("w", 1, 0.2, "y")], "video string, pass int, score double, pack string")
    assert sorted((r["video"], r["pack"]) for r in matrix.better_pass(passes).collect()) == [("v", "x"), ("w", "y")]
    usage = spark.createDataFrame([("m", 1000, 500, 2000, 1000), ("m", 1000, 500, None, None)], "model string, input_tokens int, output_tokens int, actual_input int, actual_output int")
    priced = matrix.projected_costs(usage, spark.createDataFrame([("m", 0.01, 0.02)], "model string, input_price double, output_price double")).collect()
    assert [(r["estimated_usd"], r["actual_usd"], r["availability"]) for r in priced] == [(0.02, 0.04, "complete-actual"), (0.02, None, "estimated-only")]
    assert one(spark, matrix.judge_tokens(F.lit("x" * 40), F.array(F.lit("y" * 8)))) == 10 + 2 + 1000


def test_hashes_stages_and_rounds(spark, tmp_path):
    rows = [("v", "a b", 1.0, ["y", "x"]), ("v", "c", None, ["z"]), ("w", "d", 2.5, ["q"])]
    df = spark.createDataFrame(rows, "video string, text string, start double, excerpt_ids array<string>")
    again = spark.createDataFrame([rows[1], ("v", " a  b", 1.0, ["x", "y", "x"]), rows[2]], df.schema)
    hashes = lambda d: {r["video"]: r["hash"] for r in matrix.candidate_hash(d).collect()}
    assert hashes(df) == hashes(again) and len(set(hashes(df).values())) == 2
    told = spark.createDataFrame([("v", "b", 1.0, "x"), ("v", "a", 1.0, None)], "video string, id string, start double, content string")
    import hashlib

    assert matrix.transcript_hash(told).first()["hash"] == hashlib.sha256(b"a1b1x").hexdigest()[:16]
    stages = matrix.Stages(spark, str(tmp_path / "stages"))
    twice = lambda d: d.unionByName(d)
    assert stages.run("s", df, twice).count() == 6 and stages.run("s", df.orderBy("text"), twice).count() == 6 and stages.ran == ["s"]
    stages.run("s", df, twice, "other setting")
    assert stages.ran == ["s", "s"]
    longer = lambda d: d.withColumn("text", F.when((F.col("video") == "v") & (F.length("text") < 4), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    out = matrix.improved(df, longer, stages, rounds=9)
    assert sorted((r["video"], r["text"]) for r in out.collect()) == [("v", "a b!"), ("v", "c!!!"), ("w", "d")]
    assert sum(n.startswith("round") for n in stages.ran) == 4
    assert sorted(r["text"] for r in matrix.improved(df, longer, stages, rounds=1).collect()) == ["a b!", "c!", "d"]


def test_fulltext_queries(spark):
    nodes = spark.createDataFrame([("a", "Claim", "red fish"), ("b", "Claim", "blue fishes swim"), ("c", "Excerpt", "red bird"), ("d", "Resource", "swimming")], "id string, type string, label string").withColumn("content", F.lit(None).cast("string"))
    postings = fulltext.index(nodes)
    ids = lambda q, **k: sorted(r["id"] for r in fulltext.search(postings, q, **k).collect())
    assert ids("fish") == ["a", "b"] and ids("red OR swim") == ["a", "b", "c", "d"] and ids("fish NOT red") == ["b"] and ids("fi*") == ["a", "b"]
    assert ids('"red" AND fish') == ["a"] and ids("red fish OR bird") == ["a", "c"] and ids("fish swim*") == ["b"] and ids(" ") == []
    for bad in ("OR fish", "fish AND", "NOT red", "fish NOT", "fish NEAR bird", "a AND OR b"):
        with pytest.raises(fulltext.QueryError):
            fulltext.parsed(bad)
    full = nodes.withColumn("metadata", F.when(F.col("type") == "Claim", '{"resourceId":"d","videoId":"v"}').otherwise("{}")).withColumn("label", F.when(F.col("id") == "b", "fish NOT").otherwise(F.col("label")))
    edges = spark.createDataFrame([("a", "claimDerivedFrom", "c")], "subject string, predicate string, object string")
    found = lambda q, p=postings: [(r["claim_id"], r["score"]) for r in graph.search_claims(full, edges, q, postings=p).collect()]
    assert found("red") == [("a", 3)] and found("swimming") == [("b", 3), ("a", 1)] and found("nowhere") == [] and found("") == []
    assert found("fish NOT") == [("b", 2)] and found("SWIM", None) == [("a", 1), ("b", 1)]


def test_command_line(spark, tmp_path, capsys):
    nodes = spark.createDataFrame([("r", "Resource", "Talk", None, '{"url":"http://v"}'), ("c", "Claim", "red fish", None, '{"resourceId":"r"}'), ("t", "Task", "do", None, "{}")], "id string, type string, label string, content string, metadata string")
    edges = spark.createDataFrame([("t", "taskMotivatedBy", "c")], "subject string, predicate string, object string")
    nodes.write.parquet(f"{tmp_path}/nodes")
    edges.write.parquet(f"{tmp_path}/edges")
    run = lambda *a: (cli.main([a[0], str(tmp_path), *a[1:]], spark), capsys.readouterr().out)
    assert "Nodes:\n  Claim: 1" in run("stats")[1] and run("search", "FISH")[1].startswith("c\tred fish\tr\tTalk")
    assert run("search", "fishes", "--fulltext")[1].startswith("c\t") and run("review")[1] == "" and "red fish" in run("review", "--states", "accepted")[1]
    assert "Task: do (t)" in run("task", "t")[1] and "# Dossier: Talk" in run("dossier")[1] and run("gephi", "--predicates", "taskMotivatedBy")[1].count("\n") == 3
    assert run("json-ld", "--out", f"{tmp_path}/ld")[0] == 0 and spark.read.parquet(f"{tmp_path}/ld").count() == 3
    assert run("related", "c")[1] == ""
