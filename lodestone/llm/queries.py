"""The ten operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import contamination, language, ngram_join, pieces, pseudonyms, secrets, shards, substrings, topk, toxicity
from lodestone.llm.tables import crc_mod

#: The setting that holds the key of the pseudonyms. Where it is unset, the session gets a random key.
PII_KEY = "spark.lodestone.pii.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The key that is set; otherwise one drawn at random for this session: values are linked within it and restored by nobody later."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        key = token_hex(32)
        spark.conf.set(PII_KEY, key)
    return key


def _held(column: str, n: int, remainder: int):
    return F.coalesce(crc_mod(column, n) == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~_held("doc_id", 4, 2)))
    out = language.label(docs, model)
    return out.select("doc_id", _held("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), pieces.PieceModel.load())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.sharded(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pii_key(spark))
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_values"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents"), 5, 80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held("doc_id", 5, 0)))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", _held("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_exact_topk, op3_sentencepiece, op4_sharding, op5_substring_dedup, op6_pii_pseudonyms, op7_decontamination, op8_ngram_jaccard, op9_toxicity, op10_secret_scans, pipeline)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM p),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
hit AS (SELECT doc_id, unnest(range(i, i + 35)) AS i FROM win JOIN rep USING (t)),
gone AS (SELECT DISTINCT doc_id, i FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS k
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON r.a = g.doc_id GROUP BY g.doc_id, s""",
}
