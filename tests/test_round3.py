"""Findings of round 3: what lies on disk at once, and pairs that are scored where they are needed."""

import random

from pyspark.sql import functions as F

from lodestone.operators import coverage


def test_prefixes_are_written_where_they_are_made(spark, monkeypatch):
    from lodestone.llm import ngram_join

    texts = [" ".join(f"w{i // 3}-{j}" for j in range(60)) + f" x{i % 3}" for i in range(60)]
    made = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    plans, numbers = [], []

    def noted(df, real=ngram_join.written):
        if df.columns == ["key", "prefix"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    def parts(dfs, real=ngram_join.written_parts):
        dfs = list(dfs)
        numbers.append(len(dfs))
        return real(dfs)

    monkeypatch.setattr(ngram_join, "written", noted)
    monkeypatch.setattr(ngram_join, "written_parts", parts)
    for times in (1, 3):  # rows that are repeated whole are brought together by key
        docs = spark.createDataFrame(made * times, "doc_id long, text string").repartition(3)
        _, firsts = ngram_join.classes(docs)
        assert ngram_join.links(docs, firsts, slices=1, turn=1).count() == 40
        assert len(plans) == times // 2 + 1 and "Exchange hashpartitioning" not in plans[0] and numbers[0] == 4
        plans.clear()
        numbers.clear()


def test_sweeping_waits_for_the_cleaner(spark):
    from lodestone.llm import tables

    known = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    tables.swept(spark)
    before = known.size()
    for i in range(40):
        spark.range(1000).withColumn("k", F.col("id") % (7 + i)).repartition(3, "k").write.format("noop").mode("overwrite").save()
    assert known.size() > before
    tables.swept(spark)
    assert known.size() <= before + 1


def _claims(spark):
    rng = random.Random(8)
    words = ["red", "blue", "bolt", "gear", "ring", "plate", "old", "new", "NASA", "the"]
    made = [(None if i % 41 == 0 else f"v{i % 3}", i, None if i % 29 == 0 else " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 2, 3, 5))))) for i in range(240)]
    rows = spark.createDataFrame(made, "video string, k long, text string")
    gold = rows.where("k % 4 = 0").select("video", F.concat(F.lit("g"), "k").alias("gold_id"), F.col("k").alias("seq"), (F.col("k") % 2).alias("depth"), "text")
    return gold, rows.where("k % 4 <> 0").select("video", F.col("k").alias("index"), "text")


def test_matches_are_scored_in_the_fold(spark):
    gold, others = _claims(spark)
    texts = [sorted({r["text"] for r in df.select("text").collect() if r["text"]}) for df in (gold, others)]
    rng = random.Random(9)
    near = spark.createDataFrame([(g, c, rng.choice((None, 0.2, 0.9, 0.95, 1.0))) for g in texts[0] for c in texts[1] if rng.random() < 0.3], "gold_text string, candidate_text string, similarity double")
    told = lambda df: sorted(map(str, df.select("video", "gold_id", "index", "kind", "score", "lexical", "semantic", "embedding", "exact").collect()))
    for embeddings in (None, near):
        scored = coverage.pairs(gold, others, embeddings).cache()
        for mode in coverage.MODES:
            want, out = told(coverage.matches(scored, mode)), coverage.matches_of(gold, others, mode, embeddings)
            assert want and told(out) == want
            if embeddings is None:  # no join, and texts alone are shuffled
                assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_matches_of_few_known_candidates(spark):
    import pandas as pd

    gold, others = _claims(spark)
    out = coverage.matches_of(gold, others).toPandas()
    assert len(out) > 20 and not out.duplicated(["video", "gold_id"]).any() and not out.duplicated(["video", "index"]).any()
    # one word, many candidates: each gold text looks again when others have taken those it knew
    n = 300
    side = lambda i, part, key: {"video": "v", "side": part, "k": f"{key}{i}", "words": ["bolt", f"{key}{i}"], "phrases": ["bolt"], "low": f"{key}{i}", "few": False}
    rows = [side(i, 0, "g") | {"seq": [i], "gold_id": [f"g{i}"]} for i in range(n)] + [side(i, 1, "c") | {"index": [i]} for i in range(2 * n)]
    got = coverage._matched("strict", held=1)(pd.DataFrame(rows).sample(frac=1, random_state=1))
    assert dict(zip(got["gold_id"], got["index"], strict=True)) == {f"g{i}": i for i in range(n)}


def test_summary_shuffles_no_pairs(spark):
    gold, others = _claims(spark)
    out = coverage.summary(gold, coverage.matches_of(gold, others, "strict"))
    want = coverage.summary(gold, coverage.matches(coverage.pairs(gold, others), "strict"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Join") == 1


def test_lexical_pairs_equal_pairs_and_are_not_shuffled(spark):
    gold, others = _claims(spark)
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = told(coverage.pairs(gold, others).select("video", "gold_id", "index", "exact", F.round("lexical", 6).alias("lexical")))
    for most in (4096, 7):
        out = coverage.lexical_pairs(gold, others, most=most)
        assert len(want) > 300 and told(out) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Generate" not in plan[: plan.index("MapInArrow")]
    assert coverage.lexical_pairs(gold, others.where("false")).count() == 0
