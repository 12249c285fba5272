"""Findings of round 2: ties, rounding, and class by class what was done pair by pair."""

import itertools
import random

from pyspark.sql import functions as F

from lodestone.operators import coverage, evaluate, taxonomy
from lodestone.plans import queries as base


def test_variance_of_just_the_limit_is_not_high_in_any_order(spark):
    rows = [(i, float(x)) for i, p in enumerate(itertools.permutations((22, 24, 24, 26))) for x in p]
    df = spark.createDataFrame(rows, "cell int, overall double").repartition(7)
    got = evaluate.consensus(df, ["cell"], ("overall",)).collect()
    assert len(got) == 24 and {(r["judges"], r["mean"], r["variance"], r["high_variance"]) for r in got} == {(4, 24.0, 2.0, False)}


def test_of_lines_with_one_number_the_first_in_the_table_counts(spark, tmp_path):
    line = [(1, 7, 2, 0.01 * (1 + i * 7 % 10)) for i in range(40)] + [(2, 7, 2, 0.05), (2, 57, 8, 0.03)]
    df = spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_linenumber int, l_discount double").coalesce(1)
    df.write.option("parquet.block.size", 1).parquet(str(tmp_path / "lineitem.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "200")
        rows = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
        got = {r["node_id"]: round(r["confidence"], 6) for r in base.QUERIES["taxonomy_assignments"](spark, str(tmp_path)).collect()}
        assert rows.count() == 42 and got == {"task-1": 0.1, "task-2": 0.3}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_equal_seq_goes_by_place(spark):
    none = spark.createDataFrame([], "node_id string, tag_id string, confidence double, source string")
    new = [("n", "t", i / 100, None, 1, (i * 37) % 50) for i in range(50)] + [("n", "t", 0.9, None, 0, -1)]
    df = spark.createDataFrame(new, "node_id string, tag_id string, confidence double, source string, seq int, place int")
    for parts in (1, 7):
        got = taxonomy.assigned(none, df.repartition(parts)).collect()
        assert [tuple(r) for r in got] == [("n", "t", 0.0, "manual")]


def test_pairs_are_listed_slice_by_slice(spark, monkeypatch):
    from lodestone.llm import ngram_join

    rng, shingles, made = random.Random(3), lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}, []
    for i in range(60):
        text = [f"w{i // 20}-{j}" for j in range(60)]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"x{rng.randrange(9)}"
        made.append((i, text))
    docs, numbers = spark.createDataFrame([(i, " ".join(t)) for i, t in made], "doc_id long, text string"), []

    def parts(dfs, real=ngram_join.written_parts):
        dfs = list(dfs)
        numbers.append(len(dfs))
        return real(dfs)

    monkeypatch.setattr(ngram_join, "written_parts", parts)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.grouped(docs).collect()}
    want = {i: i for i, _ in made}
    for _ in made:
        for (i, s), (j, t) in itertools.combinations(made, 2):
            a, b = shingles(s), shingles(t)
            if 100 * len(a & b) >= 80 * len(a | b):
                want[i] = want[j] = min(want[i], want[j])
    assert got == want and numbers[0] == 4 and numbers[1] > 1


def test_contents_are_not_sent_to_the_driver(spark):
    nodes = spark.createDataFrame([("a", "Big Steel Bolt"), ("b", "big steel bolt"), ("c", "ox"), ("d", None)], "id string, content string")
    tags = spark.createDataFrame([("t", "STEEL", ["ox"]), ("u", "o", None)], "id string, name string, aliases array<string>")
    out = taxonomy.tagged_content(nodes, tags)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("a", "t"), ("a", "u"), ("b", "t"), ("b", "u"), ("c", "t"), ("c", "u")]


def test_matches_of_copies_equal_greedy_over_all_pairs(spark):
    rng = random.Random(5)
    words = ["red", "blue", "bolt", "gear", "ring", "plate", "old", "new"]
    made = [(f"v{i % 3}", i, " ".join(rng.choice(words) for _ in range(rng.choice((2, 2, 3, 5))))) for i in range(150)]
    rows = spark.createDataFrame([(v, i, None if i % 29 == 0 else t) for v, i, t in made], "video string, k long, text string")
    gold = rows.where("k % 4 = 0").select("video", F.concat(F.lit("g"), "k").alias("gold_id"), F.col("k").alias("seq"), (F.col("k") % 2).alias("depth"), "text")
    others = rows.where("k % 4 <> 0").select("video", F.col("k").alias("index"), "text")
    told = lambda df: sorted(map(tuple, df.select("video", "gold_id", "index", "kind", "score", "lexical").collect()))
    for mode in coverage.MODES:
        want = told(coverage.matches(coverage.pairs(gold, others), mode))
        assert want and told(coverage.matches_of(gold, others, mode)) == want


def test_stage_that_joins_neither_copies_nor_shuffles_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from lodestone.llm import ngram_join, tables

    texts = [f"some text of number {i % 40} and more words {i % 40}" for i in range(200)]
    made = [(i % 90, t, None, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/docs")
    wide = []

    def noted(df, real=tables.written):
        wide.append([f.name for f in df.schema if f.dataType.simpleString() == "string"])
        return real(df)

    for where in (tables, ngram_join):
        monkeypatch.setattr(where, "written", noted)
    monkeypatch.setattr(corpus_pipeline, "written", noted)
    out = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert out.columns == ["doc_id", "text", "lang", "source"] and not any(wide)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in out.collect()) == sorted(set(texts))


def test_numbers_and_bits_tell_rows_apart(spark, tmp_path):
    from lodestone.llm import tables

    spark.range(70_000).selectExpr("id AS `a.b`", "id % 7 AS _path", "id AS _metadata").repartition(3).write.option("maxRecordsPerFile", 9_000).parquet(f"{tmp_path}/odd %20 name")
    read = spark.read.parquet(f"{tmp_path}/odd %20 name")
    for df in (read, read.unionByName(read), read.where("`a.b` < 50"), read.where("false")):
        rows = tables.numbered(df, "n")
        assert rows.columns == ["a.b", "_path", "_metadata", "n"] and rows.select("n").distinct().count() == rows.count() == df.count()
    rows = tables.numbered(read, "n")
    kept = tables.within(rows, F.col("n"), tables.bits(rows.where("`a.b` % 3 = 0"), "n"))
    assert sorted(r[0] for r in kept.collect()) == list(range(0, 70_000, 3))
    edges = [0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 1 << 36, (1 << 62) + 5]
    df = spark.createDataFrame([(x,) for x in edges], "n long")
    for some in (edges[::2], edges[1::2], []):
        found = tables.bits(df.where(F.col("n").isin(some)), "n")
        assert sorted(r["n"] for r in tables.within(df, F.col("n"), found).collect()) == sorted(some)


def test_pairs_of_copies_arise_behind_the_last_shuffle(spark):
    made = [(f"v{i % 2}", i, None if i % 23 == 0 else ("red bolt", "a bolt", "blue ring", "the", "Red bolt!")[i % 5]) for i in range(120)]
    rows = spark.createDataFrame(made, "video string, k long, text string")
    gold = rows.where("k % 3 = 0").select("video", F.concat(F.lit("g"), "k").alias("gold_id"), F.col("k").alias("seq"), (F.col("k") % 2).alias("depth"), "text")
    others = rows.where("k % 3 <> 0").select("video", F.col("k").alias("index"), "text")
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    out, want = coverage.pairs(gold, others), told(coverage.scores(gold, others))
    assert out.columns == coverage.scores(gold, others).columns and len(want) > 300 and told(out) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange") and "HashAggregate" not in plan[: plan.index("Exchange")]
    (golds, first), (others_, second) = coverage.copies(gold, "gold_id"), coverage.copies(others, "index")
    assert told(coverage.spread(coverage.scores(first, second).drop("seq", "depth"), golds, others_, most=2).select(out.columns)) == want
