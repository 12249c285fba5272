"""Runs with an injected client: extraction over chunks with a cache, cells of videos, models and variants, judging, resumable stages, rounds.

A client is made by a factory inside each partition and called there, so nothing but its results travels. `Extracting` and `judge`
take any callable; what it raises becomes the row's error, and the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars, text
from lodestone.operators import evaluate
from lodestone.sources import landed, resilience

CLAIM = "struct<text:string,start:double,confidence:double,excerpt_ids:array<string>>"
#: Tokens of a judge's prompt beside transcript and claims, and of its answer.
JUDGE_OVERHEAD, JUDGE_OUTPUT = 1000, 500


def transcript_hash(excerpts: DataFrame) -> DataFrame:
    """(video, id, start, content) -> (video, hash) over its excerpts by start and id."""
    start = F.coalesce(F.col("start").cast("double"), F.lit(0.0))
    parts = F.array_sort(F.collect_list(F.struct(start.alias("start"), "id", F.coalesce("content", F.lit("")).alias("content"))))
    told = F.transform("p", lambda x: F.concat(x["id"], text.plain_number(x["start"]), x["content"]))
    return excerpts.groupBy("video").agg(parts.alias("p")).select("video", F.substring(F.sha2(F.array_join(told, ""), 256), 1, 16).alias("hash"))


def candidate_hash(claims: DataFrame) -> DataFrame:
    """(video, text, start, excerpt_ids) -> (video, hash): equal for equal sets of claims, whatever their order."""
    key = F.array_join(F.array_sort(F.array_distinct("excerpt_ids")), "|")
    row = F.struct(F.coalesce("start", F.lit(float(1 << 53))).alias("s"), "text", key.alias("key"), F.coalesce(text.plain_number(F.col("start")), F.lit("-1")).alias("told"))
    joined = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(text.normalise(x["text"]), x["told"], x["key"]))
    return claims.groupBy("video").agg(F.substring(F.sha2(F.array_join(joined, ""), 256), 1, 16).alias("hash"))


def chunk_prompts(chunks: DataFrame, excerpts: DataFrame, title: DataFrame | None = None) -> DataFrame:
    """(video, chunk, place, id) and excerpts (video, id, start, content) -> (video, chunk, prompt, tokens): the excerpts of a chunk as
    lines of time, id and text; what a client is asked."""
    line = F.concat(F.lit("["), text.timestamp(F.coalesce("start", F.lit(0.0))), F.lit("] ("), "id", F.lit(") "), scalars.triple_quotes_escaped(text.normalise(F.coalesce("content", F.lit("")))))
    rows = chunks.join(excerpts, ["video", "id"]).groupBy("video", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    prompt = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    if title is not None:
        rows = rows.join(title.select("video", "title"), "video", "left")
        prompt = F.concat(scalars.prompt_safe(F.coalesce("title", F.lit("")), 200), F.lit("\n"), prompt)
    return rows.select("video", "chunk", prompt.alias("prompt")).withColumn("tokens", text.estimated_tokens(F.col("prompt")))


def asked(rows: DataFrame, factory: Callable[[], Callable[[str], str]], attempts: int = 3, base: float = 0.0) -> DataFrame:
    """rows with a `prompt`, and answer and error: each prompt goes to the client of its partition, repeated while it fails."""
    kept = [c for c in rows.columns if c != "prompt"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in parts:
            answers, errors = [], []
            for prompt in pdf["prompt"]:
                answer = error = None
                for attempt in range(1, attempts + 1):
                    try:
                        answer, error = client(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - the client's failure is the row's result
                        error = str(e) or type(e).__name__
                        if attempt < attempts:
                            resilience.time.sleep(resilience.retry_delay(base, attempt))
                answers.append(answer)
                errors.append(error)
            yield pdf[kept].assign(answer=answers, error=errors)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInPandas(run, f"{schema}, answer string, error string")


def cached_answers(prompts: DataFrame, cache: DataFrame, factory: Callable[[], Callable[[str], str]], *parts: Column) -> tuple[DataFrame, DataFrame]:
    """(all answers, those to add to the cache): prompts whose key (a hash of the prompt and `parts`, such as the model) the cache (key,
    answer) holds are not asked again. Failures are not cached. Write the second before the first is read again."""
    keyed = prompts.withColumn("key", landed.cache_key(F.col("prompt"), *parts))
    hits, misses = landed.cache_misses(keyed, cache.select("key", "answer"), ["key"])
    fresh = asked(misses.select(*keyed.columns), factory)
    known = hits.select(*[c for c in fresh.columns if c not in ("answer", "error")], "answer", F.lit(None).cast("string").alias("error"))
    return known.unionByName(fresh), fresh.where("error IS NULL").select("key", "answer")


def claims_of(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, bad answers): the JSON object of each answer, by its list `claims`; claims without text or excerpts go."""
    parsed = answers.withColumn("_claims", F.from_json(scalars.json_block(F.col("answer")), f"struct<claims:array<{CLAIM}>>")["claims"])
    kept = [c for c in answers.columns if c not in ("answer", "error")]
    good = parsed.where("_claims IS NOT NULL").select(*kept, F.posexplode("_claims").alias("place", "c")).select(*kept, "place", "c.*")
    good = good.where((text.normalise(F.col("text")) != "") & (F.size("excerpt_ids") > 0))
    return good, parsed.where("error IS NULL AND _claims IS NULL").select(*kept, "answer")


def better_pass(passes: DataFrame) -> DataFrame:
    """(video, pass, score, ...) -> of each video the pass with the highest score, the earliest of equals."""
    rest = [c for c in passes.columns if c not in ("video", "pass", "score")]
    best = F.max_by(F.struct("pass", "score", *rest), F.struct("score", (-F.col("pass")).alias("n")))
    return passes.groupBy("video").agg(best.alias("b")).select("video", "b.*")


def cells(videos: DataFrame, models: list[str], variants: list[str]) -> DataFrame:
    """videos once for each model and variant, which are short lists."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("variant")) for m in models for v in variants])
    return videos.withColumn("_p", F.explode(pairs)).select(*videos.columns, "_p.*")


def judged(rows: DataFrame, judges: list[str], factory: Callable[[], Callable[[str], str]]) -> tuple[DataFrame, DataFrame]:
    """Cells with a `prompt` -> (scores by judge, failures by judge): each judge answers by itself. A score is an object with the five
    dimensions, each from 0 to 10, whose overall lies near the mean of the others; anything else is a failure."""
    each = rows.withColumn("judge", F.explode(F.array(*map(F.lit, judges))))
    answers = asked(each.withColumn("prompt", F.concat(F.lit("judge: "), "judge", F.lit("\n"), "prompt")), factory)
    shape = ", ".join(f"{d}:double" for d in evaluate.DIMENSIONS).replace(", ", ",")
    got = answers.withColumn("_s", F.from_json(scalars.json_block(F.col("answer")), f"struct<{shape}>"))
    whole = F.lit(True)
    for d in evaluate.DIMENSIONS:
        whole = whole & F.col(f"_s.{d}").between(0, 10)
    fine = F.coalesce(whole & scalars.consistent_score(F.col("_s.overall"), *[F.col(f"_s.{d}") for d in evaluate.DIMENSIONS[:-1]]), F.lit(False))
    kept = [c for c in each.columns if c != "prompt"]
    why = F.coalesce("error", F.lit("schema: no valid score"))
    return got.where(fine).select(*kept, "_s.*"), got.where(~fine).select(*kept, why.alias("error"), scalars.judge_error(why).alias("class"))


def projected_costs(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (model, input_tokens, output_tokens, actual_input, actual_output) with estimated_usd, actual_usd (null without actual tokens) and
    availability; models: (model, input_price, output_price) per 1,000 tokens."""
    priced = rows.join(models, "model", "left")
    usd = lambda a, b: scalars.cost(F.col(a), F.col("input_price")) + scalars.cost(F.col(b), F.col("output_price"))
    return priced.select(*rows.columns, usd("input_tokens", "output_tokens").alias("estimated_usd"), usd("actual_input", "actual_output").alias("actual_usd"), F.when(F.col("actual_input").isNotNull(), "complete-actual").otherwise("estimated-only").alias("availability"))


def judge_tokens(transcript: Column, claims: Column) -> Column:
    """Input tokens of a judge's request for a transcript and an array of claim texts."""
    said = F.aggregate(claims, F.lit(0).cast("long"), lambda s, c: s + F.length(c))
    return text.estimated_tokens(transcript) + F.ceil(said / 4) + JUDGE_OVERHEAD


class Stages:
    """Named stages whose tables are kept under a path by the signature of their input: the same input is not worked on twice.

    A stage's table counts once its mark is made, so a run that was cut off is resumed at the stage that it was in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.ran: list[str] = []

    def signature(self, df: DataFrame, *settings: object) -> str:
        """A hash over the rows, whatever their order, and the settings."""
        sums = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        import hashlib

        return hashlib.sha256(repr((tuple(map(str, sums)), df.columns, settings)).encode()).hexdigest()[:32]

    def run(self, name: str, given: DataFrame, work: Callable[[DataFrame], DataFrame], *settings: object) -> DataFrame:
        at = f"{self.path}/{name}/{self.signature(given, *settings)}"
        if not self._fs.exists(self._path(f"{at}/done")):
            work(given).write.mode("overwrite").parquet(f"{at}/rows")
            self._fs.mkdirs(self._path(f"{at}/done"))
            self.ran.append(name)
        return self.spark.read.parquet(f"{at}/rows")


def improved(claims: DataFrame, step: Callable[[DataFrame], DataFrame], stages: Stages, rounds: int = 3) -> DataFrame:
    """Claims after up to `rounds` of step: a video whose claims a round leaves as they are, or empties, is settled with what it had."""
    now, settled = claims, None
    for n in range(rounds):
        new = stages.run(f"round-{n}", now, step)
        old_hash, new_hash = (candidate_hash(df).withColumnRenamed("hash", h) for df, h in ((now, "old"), (new, "new")))
        changed = old_hash.join(new_hash, "video").where("old <> new").select("video")
        done = now.join(changed, "video", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        now = new.join(changed, "video", "left_semi").select(*claims.columns)
        if now.isEmpty():
            return settled
    return now if settled is None else settled.unionByName(now)
