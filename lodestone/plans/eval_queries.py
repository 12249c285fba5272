"""Queries over scored cells, coverage and shortlists, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars, text, verify
from lodestone.operators import coverage, evaluate
from lodestone.plans.queries import query
from lodestone.sources.adapters import table

#: Lines as scores: 40 videos, 4 models, 3 variants, with and without a prompt, by three judges and some by none.
_SCORES = """sc AS (SELECT 'video-' || (l_partkey % 40) AS video, 'model-' || (l_suppkey % 4) AS model, CASE l_linenumber % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'v1' ELSE 'v2' END AS variant,
  CASE WHEN l_orderkey % 2 = 0 THEN 'p1' ELSE '' END AS prompt, '' AS chunk_mode, CASE WHEN l_orderkey % 7 <> 0 THEN 'judge-' || (l_orderkey % 3) ELSE '-' END AS judge,
  l_quantity / 5 AS completeness, CASE WHEN l_linenumber <> 4 THEN l_discount * 100 END AS accuracy, l_tax * 100 AS topic_coverage, (l_partkey % 11)::DOUBLE AS atomicity,
  (l_suppkey * 7 + l_orderkey) % 11 + 0.0 AS overall, l_linenumber AS n_missing, l_partkey % 3 AS n_hallucinations, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
cm AS (SELECT video, model, variant, prompt, chunk_mode, avg(completeness) AS completeness, avg(coalesce(accuracy, 0)) AS accuracy, avg(topic_coverage) AS topic_coverage, avg(atomicity) AS atomicity,
  avg(overall) AS overall, max(l) AS judges FROM (SELECT *, 1 AS l FROM sc) GROUP BY ALL),
un AS (UNPIVOT (SELECT video, model, variant, completeness, accuracy, topic_coverage, atomicity, overall FROM cm) ON completeness, accuracy, topic_coverage, atomicity, overall INTO NAME dimension VALUE value)"""


def _scores(spark, d):
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("video-"), F.col("l_partkey") % 40).alias("video"), F.concat(F.lit("model-"), F.col("l_suppkey") % 4).alias("model"),
        F.when(n % 3 == 0, "raw").when(n % 3 == 1, "v1").otherwise("v2").alias("variant"), F.when(order % 2 == 0, "p1").alias("prompt"), F.lit(None).cast("string").alias("chunk_mode"),
        F.when(order % 7 != 0, F.concat(F.lit("judge-"), order % 3)).alias("judge"), (F.col("l_quantity") / 5).alias("completeness"), F.when(n != 4, F.col("l_discount") * 100).alias("accuracy"),
        (F.col("l_tax") * 100).alias("topic_coverage"), (F.col("l_partkey") % 11).cast("double").alias("atomicity"), ((F.col("l_suppkey") * 7 + order) % 11).cast("double").alias("overall"),
        n.alias("n_missing"), (F.col("l_partkey") % 3).alias("n_hallucinations"), (order * 10 + n).alias("seq"),
    )


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("""SELECT l_orderkey, 'overall' AS dimension, count(*) AS judges, round(avg(l_quantity), 2) AS mean, abs(var_pop(l_quantity)) > 2.0 AS high_variance FROM lineitem GROUP BY 1""")
def judge_consensus(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_quantity", "overall")
    return evaluate.consensus(rows, ["l_orderkey"], ("overall",)).drop("variance")


@query(f"WITH {_SCORES} SELECT model, dimension, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS stddev FROM un GROUP BY 1, 2")
def eval_statistics(spark, d):
    out = evaluate.statistics(evaluate.cell_means(_scores(spark, d)), "model")
    return _rounded(out, "mean", "median", "min", "max", "stddev")


@query(f"""WITH {_SCORES}, m AS (SELECT model, dimension, avg(value) AS mean FROM un GROUP BY 1, 2)
SELECT model, dimension, round(mean, 6) AS mean, row_number() OVER (PARTITION BY dimension ORDER BY mean DESC, model)::INTEGER AS rank FROM m""")
def model_leaderboard(spark, d):
    return _rounded(evaluate.leaderboards(evaluate.cell_means(_scores(spark, d))), "mean")


@query(f"""WITH {_SCORES}, m AS (SELECT model, avg(overall) AS m FROM cm GROUP BY 1), v AS (SELECT video, avg(overall) AS m FROM cm GROUP BY 1), x AS (SELECT variant, avg(overall) AS m FROM cm GROUP BY 1)
SELECT (SELECT model FROM m ORDER BY m DESC, model LIMIT 1) AS best_model, (SELECT model FROM m ORDER BY m, model DESC LIMIT 1) AS worst_model, (SELECT video FROM v ORDER BY m, video LIMIT 1) AS hardest_video,
  (SELECT variant FROM x ORDER BY m DESC, variant LIMIT 1) AS best_variant, (SELECT model FROM m WHERE model IN ('model-1', 'model-2') ORDER BY m DESC, model LIMIT 1) AS best_budget_model""")
def eval_summary(spark, d):
    return evaluate.summary(evaluate.cell_means(_scores(spark, d)), ["model-1", "model-2"])


@query(f"""WITH {_SCORES}, j AS (SELECT video, model, variant, prompt, judge, avg(completeness) AS a, avg(accuracy) AS b, avg(topic_coverage) AS c, avg(atomicity) AS d, avg(overall) AS e, avg(n_missing) AS f, avg(n_hallucinations) AS g FROM sc GROUP BY ALL)
SELECT n.variant, count(*) AS pairs, round(avg(n.a - o.a), 6) AS completeness, round(avg(n.b - o.b), 6) AS accuracy, round(avg(n.c - o.c), 6) AS topic_coverage, round(avg(n.d - o.d), 6) AS atomicity, round(avg(n.e - o.e), 6) AS overall,
  round(avg(n.f - o.f), 6) AS missing, round(avg(n.g - o.g), 6) AS hallucinations FROM j n JOIN j o USING (video, model, prompt, judge) WHERE o.variant = 'raw' AND n.variant <> 'raw' GROUP BY 1""")
def variant_delta(spark, d):
    out = evaluate.variant_deltas(_scores(spark, d))
    return _rounded(out, *evaluate.DIMENSIONS, "missing", "hallucinations")


@query("""WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE o_orderpriority END AS variant, o_totalprice / 1000 AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 5000 END AS j FROM orders),
g AS (SELECT coalesce(variant, 'unknown') AS variant, sum(e) AS e, sum(coalesce(j, 0)) AS j FROM c GROUP BY 1)
SELECT variant, round(e, 3) AS extraction_usd, round(j, 3) AS judge_usd, round(e + j, 3) AS total_usd FROM g UNION ALL SELECT NULL, round(sum(e), 3), round(sum(j), 3), round(sum(e) + sum(j), 3) FROM g""")
def eval_costs(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("variant"), (F.col("o_totalprice") / 1000).alias("extraction_usd"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 5000).alias("judge_usd"))
    return evaluate.costs(rows).withColumns({c: F.round(c, 3) for c in ("extraction_usd", "judge_usd", "total_usd")})


@query("""SELECT count_if(o_orderkey % 4 <> 0)::BIGINT AS cells_actual, count_if(o_orderkey % 4 = 0 AND o_orderkey % 8 = 0)::BIGINT AS cells_estimated, sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END)::BIGINT AS actual_input,
  sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 100 END)::BIGINT AS actual_output, round(sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END), 2) AS actual_usd FROM orders""")
def eval_usage(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 4 != 0, F.col("o_custkey")).alias("actual_input"), (F.col("o_custkey") % 100).alias("actual_output"), F.col("o_totalprice").alias("actual_usd"), (k % 8 == 0).alias("estimated"))
    return evaluate.usage(rows).withColumn("actual_usd", F.round("actual_usd", 2))


@query("""SELECT 0 AS n, 'Some cells failed during extraction or scoring, which may skew the results.' AS caveat UNION ALL SELECT 1, 'Multiple judges were used; scores are averaged consensus.'
UNION ALL SELECT 2, 'Cell order-' || o_orderkey || ' / ' || o_orderstatus || ' has high score variance.' FROM orders WHERE o_orderkey % 50 = 0""")
def eval_caveats(spark, d):
    k = F.col("o_orderkey")
    return evaluate.caveats(table(spark, d, "orders").select(F.concat(F.lit("order-"), k).alias("video"), F.col("o_orderstatus").alias("model"), F.when(k % 9 == 0, "timeout").alias("error"), (k % 3).alias("judges"), (k % 50 == 0).alias("high_variance")))


_GATE = """g AS (SELECT 'video-' || (o_custkey % 60) AS video, o_orderstatus AS model, CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'better' ELSE 'other' END AS variant, CASE WHEN o_custkey % 2 = 0 THEN 'p' ELSE '' END AS prompt, o_orderkey AS seq,
  CASE WHEN o_custkey % 5 IN (0, 1) THEN [o_totalprice % 11, o_orderkey % 11, 5.0, o_custkey % 7, 1.0] END AS derived, CASE WHEN o_orderkey % 4 IN (0, 1) THEN [o_orderkey % 10, 3.0, o_totalprice % 9, 2.0, o_custkey % 11] END AS mean FROM orders),
b AS (SELECT video, model, prompt, max(seq) AS seq FROM g WHERE variant = 'base' GROUP BY ALL), o AS (SELECT g.* FROM g JOIN b USING (video, model, prompt, seq) WHERE variant = 'base'),
p AS (SELECT n.video || '/' || n.model AS entity, o.video IS NULL AS bare, n.derived IS NOT NULL AND o.derived IS NOT NULL AS dd, n.mean IS NOT NULL AND o.mean IS NOT NULL AS mm, n.derived IS NOT NULL OR n.mean IS NOT NULL AS has_new,
  o.derived IS NOT NULL OR o.mean IS NOT NULL AS has_old, n.derived AS nd, n.mean AS nm, o.derived AS od, o.mean AS om FROM g n LEFT JOIN o USING (video, model, prompt) WHERE n.variant = 'better')"""


def _gate_cells(spark, d):
    k, c, x = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    doubles = lambda *v: F.array(*[e.cast("double") for e in v])
    return table(spark, d, "orders").select(
        F.concat(F.lit("video-"), c % 60).alias("video"), F.col("o_orderstatus").alias("model"), F.when(k % 3 == 0, "base").when(k % 3 == 1, "better").otherwise("other").alias("variant"),
        F.when(c % 2 == 0, "p").alias("prompt"), F.lit(None).cast("string").alias("chunk_mode"), k.alias("seq"),
        F.when((c % 5).isin(0, 1), doubles(x % 11, k % 11, F.lit(5.0), c % 7, F.lit(1.0))).alias("derived"), F.when((k % 4).isin(0, 1), doubles(k % 10, F.lit(3.0), x % 9, F.lit(2.0), c % 11)).alias("mean"),
    )


@query(f"""WITH {_GATE}, q AS (SELECT entity, CASE WHEN bare THEN 'missing-baseline' WHEN has_old AND NOT has_new THEN 'missing-self-improvement-score' WHEN NOT has_old AND has_new THEN 'incomparable-baseline-score'
  WHEN has_old AND has_new AND NOT dd AND NOT mm THEN 'incompatible-score-mode' END AS reason FROM p) SELECT * FROM q WHERE reason IS NOT NULL""")
def eval_gate_warnings(spark, d):
    return evaluate.gate(_gate_cells(spark, d), "base", "better")[1]


@query(f"""WITH {_GATE}, e AS (SELECT entity, unnest(range(0, 5)) AS dimension, CASE WHEN dd THEN od ELSE om END AS b, CASE WHEN dd THEN nd ELSE nm END AS l FROM p WHERE dd OR mm)
SELECT entity, dimension::INTEGER AS dimension, round(b[dimension + 1]::DOUBLE, 6) AS baseline, round(l[dimension + 1]::DOUBLE, 6) AS latest FROM e WHERE b[dimension + 1] - l[dimension + 1] > 1.0""")
def eval_gate_regressions(spark, d):
    return _rounded(evaluate.gate(_gate_cells(spark, d), "base", "better")[0], "baseline", "latest")


@query("""WITH p AS (SELECT 'order-' || l_orderkey AS video, 'd' || l_linenumber AS dimension, 10.0 AS human, l_quantity / 5 AS judge, greatest(0, 1 - abs(10 - l_quantity / 5) / 10) AS agreement FROM lineitem),
v AS (SELECT video, bool_and(agreement >= 0.5) AS ok FROM p GROUP BY 1)
SELECT dimension, round(avg(agreement), 6) AS agreement, avg(agreement) >= 0.5 AND bool_and(ok) AS passed FROM p JOIN v USING (video) GROUP BY 1""")
def eval_calibration(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("order-"), "l_orderkey").alias("video"), F.concat(F.lit("d"), "l_linenumber").alias("dimension"), F.lit(10.0).alias("human"), (F.col("l_quantity") / 5).alias("judge"))
    return _rounded(evaluate.calibration(rows, 0.5)[1], "agreement")


@query(f"""WITH {_SCORES}, u AS (UNPIVOT (SELECT video, model, completeness, accuracy, topic_coverage, atomicity, overall FROM sc) ON completeness, accuracy, topic_coverage, atomicity, overall INTO NAME dimension VALUE value)
SELECT video, model, dimension, round(max(value) - min(value), 2) AS spread FROM u GROUP BY ALL HAVING round(max(value) - min(value), 2) >= 1""")
def eval_judge_spread(spark, d):
    return evaluate.judge_spread(_scores(spark, d), ["video", "model"])


_CANDIDATES = """ca AS (SELECT 'video-' || (p_partkey % 30) AS video, 'c' || p_partkey AS candidate, (p_partkey * 37 % 64) / 64 AS ratio, (p_partkey * 53 % 8) / 8 AS root_ratio, (p_size % 8) / 8 AS child_ratio, p_size % 7 AS unmatched,
  CASE WHEN p_partkey % 4 = 0 THEN (p_size % 5) / 4 END AS teacher_ratio, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 3) / 2 END AS structural, CASE p_partkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS fallback,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 * 625 END AS max_tokens, p_partkey % 6 <> 0 AS harness, p_size % 2 = 0 AS gate, CASE WHEN p_size % 5 = 0 THEN 'small-request' END AS chunk_mode, CASE WHEN p_partkey % 7 = 0 THEN 'x-v2' ELSE 'x' END AS pack FROM part),
s AS (SELECT *, ratio * 100 + coalesce(teacher_ratio, 0) * 15 + (2 * root_ratio + child_ratio) * 10 + coalesce(structural, 0) * 15 - unmatched - CASE fallback WHEN 'full' THEN 5 WHEN 'partial' THEN 2 ELSE 0 END - coalesce(max_tokens, 0) / 10000 AS score FROM ca WHERE harness),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, ratio DESC, coalesce(teacher_ratio, 0) DESC, coalesce(structural, 0) DESC, 2 * root_ratio + child_ratio DESC, unmatched, coalesce(max_tokens, 9007199254740991), candidate)::INTEGER AS rank_in_video FROM s)"""


def _ranked(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("video-"), k % 30).alias("video"), F.concat(F.lit("c"), k).alias("candidate"), (k * 37 % 64 / 64).alias("ratio"), (k * 53 % 8 / 8).alias("root_ratio"), (z % 8 / 8).alias("child_ratio"), (z % 7).alias("unmatched"),
        F.when(k % 4 == 0, z % 5 / 4).alias("teacher_ratio"), F.when(k % 3 == 0, z % 3 / 2).alias("structural"), F.when(k % 5 == 0, "full").when(k % 5 == 1, "partial").otherwise("none").alias("fallback"),
        F.when(k % 2 == 0, k % 9 * 625).alias("max_tokens"), (k % 6 != 0).alias("harness"), (z % 2 == 0).alias("gate"), F.when(z % 5 == 0, "small-request").alias("chunk_mode"), F.when(k % 7 == 0, "x-v2").otherwise("x").alias("pack"),
    )
    return evaluate.optimisation_ranks(rows)


@query(f"WITH {_CANDIDATES} SELECT video, candidate, round(score, 6) AS score, rank_in_video, rank_in_video = 1 AS best_of_video FROM r")
def eval_ranks(spark, d):
    return _ranked(spark, d).select("video", "candidate", F.round("score", 6).alias("score"), "rank_in_video", "best_of_video")


@query(f"""WITH {_CANDIDATES}, b AS (SELECT *, gate AND ratio >= greatest(max(ratio) OVER v - 0.1, max(ratio) OVER v * 0.75) AS gated FROM r WINDOW v AS (PARTITION BY video)),
f AS (SELECT * FROM b QUALIFY gated OR NOT bool_or(gated) OVER (PARTITION BY video)), x AS (SELECT *, coalesce(chunk_mode = 'small-request' AND pack LIKE '%-v2', false) AS e FROM f),
y AS (SELECT * FROM x QUALIFY e OR NOT bool_or(e) OVER (PARTITION BY video))
SELECT video, candidate, row_number() OVER (PARTITION BY video ORDER BY rank_in_video)::INTEGER AS place FROM y QUALIFY place <= 3""")
def eval_shortlist(spark, d):
    return evaluate.shortlist(_ranked(spark, d), 3, adaptive=True).select("video", "candidate", "place")


_PARTS = """pt AS (SELECT p_brand AS video, p_partkey AS k, p_partkey % 5 = 0 AS is_gold, p_partkey % 3 AS depth, 'The ' || p_name || ' of ' || p_type || ' with ' || p_size || ' items' AS t FROM part),
go AS (SELECT * FROM pt WHERE is_gold), can AS (SELECT * FROM pt WHERE NOT is_gold),
tk AS (SELECT k, list_distinct(list_filter(string_split(lower(t), ' '), lambda w: w NOT IN ('the', 'of', 'with'))) AS w, list_filter(string_split(lower(t), ' '), lambda w: w NOT IN ('the', 'of', 'with')) AS l FROM pt)"""


def _claims(spark, d):
    told = F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_type", F.lit(" with "), "p_size", F.lit(" items"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("video"), F.col("p_partkey").alias("k"), (F.col("p_partkey") % 3).alias("depth"), told.alias("text"))
    gold = rows.where("k % 5 = 0").select("video", F.concat(F.lit("g"), "k").alias("gold_id"), F.col("k").alias("seq"), "depth", "text")
    return gold, rows.where("k % 5 <> 0").select("video", F.col("k").alias("index"), "text")


@query(f"""WITH {_PARTS} SELECT go.video, 'g' || go.k AS gold_id, can.k AS index, lower(go.t) = lower(can.t) AS exact,
  round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS lexical FROM go JOIN can USING (video) JOIN tk a ON a.k = go.k JOIN tk b ON b.k = can.k""")
def coverage_pairs(spark, d):
    return coverage.lexical_pairs(*_claims(spark, d))


@query()
def coverage_matches(spark, d):
    out = coverage.matches_of(*_claims(spark, d), "semantic")
    return out.select("video", "gold_id", "index", "kind", F.round("score", 6).alias("score"))


@query()
def coverage_summary(spark, d):
    gold, candidates = _claims(spark, d)
    return coverage.summary(gold, coverage.matches_of(gold, candidates, "strict"))


@query(f"""WITH {_PARTS}, n AS (SELECT k, l, list_transform(range(1, len(l)), lambda i: l[i] || '_' || l[i + 1]) AS two, list_transform(range(1, len(l) - 1), lambda i: l[i] || '_' || l[i + 1] || '_' || l[i + 2]) AS three, w FROM tk),
j AS (SELECT a.k, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS lexical, len(list_intersect(list_distinct(a.two), list_distinct(b.two))) / len(list_distinct(list_concat(a.two, b.two))) AS bigrams,
  len(list_intersect(list_distinct(a.three), list_distinct(b.three))) / len(list_distinct(list_concat(a.three, b.three))) AS trigrams FROM n a JOIN n b ON b.k = a.k + 1)
SELECT k, round(lexical, 6) AS lexical, round(bigrams, 6) AS bigrams, round(trigrams, 6) AS trigrams FROM j""")
def claim_overlaps(spark, d):
    gold, candidates = _claims(spark, d)
    rows = gold.select(F.col("seq").alias("k"), "text").unionByName(candidates.select(F.col("index").alias("k"), "text"))
    both = rows.join(rows.select((F.col("k") - 1).alias("k"), F.col("text").alias("source")), "k")
    a, b = verify.words(F.col("text")), verify.words(F.col("source"))
    return both.select("k", F.round(verify.lexical(F.col("text"), F.col("source")), 6).alias("lexical"), F.round(verify.ngram_overlap(a, b, 2), 6).alias("bigrams"), F.round(verify.ngram_overlap(a, b, 3), 6).alias("trigrams"))


@query(r"""WITH t AS (SELECT p_partkey AS k, 'The ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' of New York and NASA data for ' || p_name || ', ' || p_type AS t FROM part),
w AS (SELECT k, regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b') AS names, regexp_extract_all(t, '[\p{L}0-9]+(?:-[\p{L}0-9]+)*') AS raw FROM t),
c AS (SELECT k, names, list_transform(raw, lambda x: {'w': lower(x), 'ok': (regexp_matches(x, '^[A-Z]{2,}[A-Z0-9-]*$') OR length(x) >= 4) AND lower(x) NOT IN ('data', 'standard', 'the', 'of', 'and', 'for')}) AS r FROM w)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(list_transform(names, lambda x: lower(x)), list_concat(list_transform(list_filter(r, lambda x: x.ok), lambda x: x.w),
  list_transform(list_filter(range(1, len(r)), lambda i: r[i].ok AND r[i + 1].ok), lambda i: r[i].w || ' ' || r[i + 1].w))))), '|') AS phrases FROM c""")
def claim_key_phrases(spark, d):
    told = F.concat(F.lit("The "), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000), F.lit(" of New York and NASA data for "), "p_name", F.lit(", "), "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(verify.key_phrases(told)), "|").alias("phrases"))


@query(r"""WITH r AS (SELECT p_partkey AS k, 'use ' || p_size || ' ' || p_name || ' parts' AS a, CASE p_partkey % 4 WHEN 0 THEN 'Use ' || p_size || '  ' || p_name || ' pieces' WHEN 1 THEN 'use ' || p_name || ' parts' WHEN 2 THEN 'wholly different words ' || p_size ELSE ' ' END AS b FROM part),
t AS (SELECT k, a, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM r),
w AS (SELECT *, list_filter(string_split(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS wa, list_filter(string_split(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS wb FROM t),
f AS (SELECT k, a, b, len(list_filter(list_distinct(regexp_extract_all(a, '[0-9]+(?:\.[0-9]+)?')), lambda x: NOT list_contains(regexp_extract_all(b, '[0-9]+(?:\.[0-9]+)?'), x))) > 0 AS loses,
  CASE WHEN len(wb) = 0 THEN 0 ELSE len(list_intersect(list_distinct(wb), wa)) / len(list_distinct(wb)) END AS shared,
  1 - len(list_filter(range(1, least(len(wa), len(wb)) + 1), lambda i: wa[i] = wb[i])) / greatest(1, len(wa), len(wb)) AS edits FROM w)
SELECT k, loses, round(shared, 6) AS shared, round(edits, 6) AS edits, CASE WHEN b <> '' AND NOT loses AND shared >= 0.3 AND edits <= 0.5 THEN b ELSE a END AS text FROM f""")
def rewrite_guards(spark, d):
    k = F.col("p_partkey")
    a = F.concat(F.lit("use "), "p_size", F.lit(" "), "p_name", F.lit(" parts"))
    b = F.when(k % 4 == 0, F.concat(F.lit("Use "), "p_size", F.lit("  "), "p_name", F.lit(" pieces"))).when(k % 4 == 1, F.concat(F.lit("use "), "p_name", F.lit(" parts"))).when(k % 4 == 2, F.concat(F.lit("wholly different words "), "p_size")).otherwise(" ")
    rows = table(spark, d, "part").select(k.alias("k"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), text.normalise(F.col("b"))
    return rows.select("k", scalars.loses_number(a, b).alias("loses"), F.round(scalars.keyword_overlap(b, F.array(a)), 6).alias("shared"), F.round(scalars.edit_ratio(a, b), 6).alias("edits"), scalars.accepted_rewrite(a, F.col("b"), F.array().cast("array<string>")).alias("text"))


@query("""WITH t AS (SELECT event_id, event_id * 37 % 90000 AS n, event_id % 12 AS c FROM events), b AS (SELECT *, least(n, 50000) AS total FROM t),
w AS (SELECT *, greatest(1, c, ceil(total / 10000)) AS chunks FROM b), m AS (SELECT *, least(ceil(total / chunks), 10000) AS most FROM w)
SELECT event_id, n > 50000 AS over_budget, chunks::BIGINT AS max_chunks, least(3000, most)::BIGINT AS target, most::BIGINT AS most, total::BIGINT AS total, round(n / 1000 * 0.01, 6) AS cost FROM m""")
def token_budgets(spark, d):
    n = F.col("event_id") * 37 % 90000
    rows = table(spark, d, "events").select("event_id", scalars.chunk_budget(n, F.col("event_id") % 12).alias("b"), F.round(scalars.cost(n, 0.01), 6).alias("cost"))
    return rows.select("event_id", "b.*", "cost")


@query("""WITH m AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Error 429: slow down' WHEN 1 THEN 'HTTP 503 high demand' WHEN 2 THEN 'request was aborted' WHEN 3 THEN 'Client timeout after 30s' WHEN 4 THEN 'unknown model' WHEN 5 THEN 'bad JSON schema' WHEN 6 THEN 'api key missing' WHEN 7 THEN 'port 1500 closed' END AS m, event_id % 9 AS k FROM events)
SELECT event_id, coalesce(k IN (0, 1), false) AS transient, coalesce(k = 3, false) AS timed_out, coalesce(k = 2, false) AS aborted, coalesce(k = 4, false) AS no_model, coalesce(k IN (0, 1), false) AS limited,
  CASE k WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'provider-unavailable' WHEN 2 THEN 'timeout' WHEN 3 THEN 'timeout' WHEN 4 THEN 'error' WHEN 5 THEN 'parse-or-schema' WHEN 6 THEN 'auth' WHEN 7 THEN 'error' ELSE 'error' END AS class FROM m""")
def error_classes(spark, d):
    k = F.col("event_id") % 9
    says = ["Error 429: slow down", "HTTP 503 high demand", "request was aborted", "Client timeout after 30s", "unknown model", "bad JSON schema", "api key missing", "port 1500 closed"]
    m = F.get(F.array(*map(F.lit, says)), k.cast("int"))
    rows = table(spark, d, "events").select("event_id", m.alias("m"))
    m = F.col("m")
    return rows.select("event_id", scalars.transient_error(m).alias("transient"), scalars.client_timeout(m).alias("timed_out"), scalars.upstream_abort(m).alias("aborted"), scalars.model_unavailable(m).alias("no_model"), scalars.rate_limited(m).alias("limited"), scalars.judge_error(m).alias("class"))
