"""Statistics over scored cells: consensus, distribution, leaderboards, costs, deltas, gates, rank correlation, agreement, shortlists.

A score row: video, model, variant, prompt and chunk_mode (may be null), judge (may be null), the five DIMENSIONS from 0 to 10,
n_missing and n_hallucinations. The rows of one (video, model, variant, prompt, chunk_mode) are a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import scalars, text

DIMENSIONS = scalars.DIMENSIONS
CELL = ("video", "model", "variant", "prompt", "chunk_mode")
HIGH_VARIANCE, TOLERANCE, RELIABLE = 2.0, 1.0, 15
ALL_NULL = "\u0000"


def keyed(rows: DataFrame) -> DataFrame:
    """Null prompts and chunk modes as empty text, as they are compared."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("prompt", "chunk_mode")})


def unpivoted(rows: DataFrame, keys: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(keys..., dimension, value)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in dimensions])
    return rows.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*")


def consensus(scores: DataFrame, keys: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(keys..., dimension, judges, mean, variance, high_variance): mean and population variance to two decimals; one judge has variance 0.

    The variance is taken to nine decimals first: its last bits follow the order in which rows arrive, and a variance of
    just the limit is not high.
    """
    v = F.round(F.var_pop("value"), 9)
    return unpivoted(scores, keys, dimensions).groupBy(*keys, "dimension").agg(F.count("*").alias("judges"), F.round(F.avg("value"), 2).alias("mean"), F.round(v, 2).alias("variance"), (v > HIGH_VARIANCE).alias("high_variance"))


def merged_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., seq, text, ...) -> one row for each text: its last row, ordered by its first place (`place`)."""
    rest = [c for c in findings.columns if c not in (*keys, "seq", "text")]
    return findings.groupBy(*keys, "text").agg(F.min("seq").alias("place"), *[F.max_by(c, "seq").alias(c) for c in rest])


def cell_means(scores: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Means over the judges of a cell, a missing score counting as 0."""
    return keyed(scores).groupBy(*cell).agg(*[F.avg(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(d) for d in DIMENSIONS])


def distribution(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stddev"))


def statistics(means: DataFrame, key: str) -> DataFrame:
    """(key, dimension, mean, median, min, max, stddev) over the cells."""
    return distribution(unpivoted(means, [key]), [key, "dimension"], "value")


def leaderboards(means: DataFrame, key: str = "model") -> DataFrame:
    """(dimension, rank, key, mean): best first, ties by key. A window has one row a key, of one dimension."""
    each = unpivoted(means, [key]).groupBy("dimension", key).agg(F.avg("value").alias("mean"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("mean"), key)))


def summary(means: DataFrame, budget: list[str]) -> DataFrame:
    """One row: best_model, worst_model, hardest_video, best_variant and best_budget_model by the mean overall score; None without cells."""

    def ends(key: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.avg("overall").alias("m"))

    models = ends("model", means).agg(F.min(F.struct((-F.col("m")).alias("m"), "model")).alias("a"), F.max(F.struct((-F.col("m")).alias("m"), "model")).alias("z"))
    cheap = ends("model", means.where(F.col("model").isin(budget))).agg(F.min(F.struct((-F.col("m")).alias("m"), "model")).alias("b"))
    videos = ends("video", means).agg(F.min(F.struct("m", "video")).alias("v"))
    variants = ends("variant", means).agg(F.min(F.struct((-F.col("m")).alias("m"), "variant")).alias("x"))
    none = lambda c: F.coalesce(c, F.lit("None"))
    # each side is one row
    out = models.join(F.broadcast(cheap)).join(F.broadcast(videos)).join(F.broadcast(variants))
    return out.select(none("a.model").alias("best_model"), none("z.model").alias("worst_model"), none("v.video").alias("hardest_video"), none("x.variant").alias("best_variant"), none("b.model").alias("best_budget_model"))


def costs(cells: DataFrame) -> DataFrame:
    """(variant, extraction_usd, judge_usd, total_usd), and a row for all with variant null."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("extraction_usd", "judge_usd")]
    out = cells.withColumn("variant", F.coalesce("variant", F.lit("unknown"))).rollup("variant").agg(*sums)
    return out.withColumn("total_usd", F.col("extraction_usd") + F.col("judge_usd"))


def usage(cells: DataFrame) -> DataFrame:
    """One row of token and cost sums over cells with actual usage (actual_input and so on are null where only estimates are known)."""
    actual = F.col("actual_input").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(actual, F.col(c))), F.lit(0)).alias(c)
    return cells.agg(F.count_if(actual).alias("cells_actual"), F.count_if(~actual & F.col("estimated")).alias("cells_estimated"), *map(total, ("actual_input", "actual_output", "actual_usd")))


def caveats(cells: DataFrame) -> DataFrame:
    """(n, caveat) from cells (video, model, error, judges, high_variance): failures, several judges, cells of high variance."""
    any_ = cells.agg(F.bool_or(F.col("error").isNotNull()).alias("e"), F.max("judges").alias("j"))
    told = any_.select(F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.when(F.col("e"), "Some cells failed during extraction or scoring, which may skew the results.").alias("caveat")),
        F.struct(F.lit(1).alias("n"), F.when(F.col("j") > 1, "Multiple judges were used; scores are averaged consensus.").alias("caveat")),
    )).alias("c")).select("c.*").where("caveat IS NOT NULL")
    each = cells.where("high_variance").select(F.lit(2).alias("n"), F.concat(F.lit("Cell "), "video", F.lit(" / "), "model", F.lit(" has high score variance.")).alias("caveat"))
    return told.unionByName(each)


def variant_deltas(scores: DataFrame, base: str = "raw") -> DataFrame:
    """(variant, pairs, dimensions..., missing, hallucinations): other variant - base, judge by judge in equal cells, averaged over
    the matched (cell, judge) pairs. A variant without a match has no row."""
    rows = keyed(scores).withColumn("judge", F.coalesce("judge", F.lit(ALL_NULL)))
    cell = [c for c in CELL if c != "variant"]
    values = [*DIMENSIONS, "n_missing", "n_hallucinations"]
    of = rows.groupBy(*cell, "judge", "variant").agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values])
    old = of.where(F.col("variant") == base).select(*cell, "judge", *[F.col(v).alias("_" + v) for v in values])
    new = of.where(F.col("variant") != base)
    names = {"n_missing": "missing", "n_hallucinations": "hallucinations"}
    return new.join(old, [*cell, "judge"]).groupBy("variant").agg(F.count("*").alias("pairs"), *[F.avg(F.col(v) - F.col("_" + v)).alias(names.get(v, v)) for v in values])


def gate(cells: DataFrame, base: str, improved: str, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(regressions, warnings) of the improved variant's cells against the base's.

    cells: CELL, seq, derived and mean (each array<double> of five scores, or null). Of several equal base cells the last by seq
    counts. Derived scores are compared if both cells have them, else means; a non-finite score is 0.
    """
    rows = keyed(cells)
    key = [c for c in CELL if c != "variant"]
    old = rows.where(F.col("variant") == base).groupBy(*key).agg(F.max_by(F.struct("derived", "mean"), "seq").alias("old"))
    new = rows.where(F.col("variant") == improved).join(old, key, "left").withColumn("entity", F.concat_ws("/", "video", "model"))
    scored = lambda d, m: d.isNotNull() | m.isNotNull()
    has_new, has_old = scored(F.col("derived"), F.col("mean")), scored(F.col("old.derived"), F.col("old.mean"))
    derived = F.col("derived").isNotNull() & F.col("old.derived").isNotNull()
    means = F.col("mean").isNotNull() & F.col("old.mean").isNotNull()
    reason = (
        F.when(F.col("old").isNull(), "missing-baseline").when(has_old & ~has_new, "missing-self-improvement-score").when(~has_old & has_new, "incomparable-baseline-score")
        .when(has_old & has_new & ~derived & ~means, "incompatible-score-mode")
    )
    judged = new.withColumn("reason", reason)
    warnings = judged.where("reason IS NOT NULL").select("entity", "reason")
    finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    both = judged.where(F.col("reason").isNull() & (derived | means))
    pairs = F.arrays_zip(F.when(derived, F.col("old.derived")).otherwise(F.col("old.mean")).alias("b"), F.when(derived, F.col("derived")).otherwise(F.col("mean")).alias("l"))
    each = both.select("entity", F.posexplode(pairs).alias("dimension", "p")).select("entity", "dimension", finite(F.col("p.b")).alias("baseline"), finite(F.col("p.l")).alias("latest"))
    return each.where(F.col("baseline") - F.col("latest") > tolerance), warnings


def _buckets(counts: DataFrame, buckets: int) -> Column:
    """The bucket of a value v among quantiles of the values: at most so many, so their offsets are few rows."""
    cuts = counts.select(F.percentile_approx("v", F.lit([i / buckets for i in range(1, buckets)]), F.lit(10_000))).first()[0] or []
    bounds = F.lit(sorted(set(cuts)) or [0.0])
    return F.size(F.filter(bounds, lambda b: b < F.col("v"))) if cuts else F.lit(0)


def spearman(pairs: DataFrame, a: str, b: str, buckets: int = 64) -> DataFrame:
    """(n, rho, reliable): rank correlation with average ranks; rho is null below two rows, for a constant side and where a value
    isn't finite. Ranks come from counts by value, summed in buckets of the value range, so they need no sort in one place."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(c: str) -> DataFrame:
        counts = both.groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"))
        placed = counts.withColumn("bucket", _buckets(counts, buckets))
        before = F.coalesce(F.sum("s").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = placed.groupBy("bucket").agg(F.sum("n").alias("s")).select("bucket", before.alias("off"))  # `buckets` rows
        below = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return placed.join(F.broadcast(offsets), "bucket").select(F.col("v").alias(c), (F.col("off") + below + (F.col("n") + 1) / 2).alias("r_" + c))

    values = both.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    joined = values.join(ranked(a), a).join(ranked(b), b)
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    spread = F.stddev_pop("r_" + a) * F.stddev_pop("r_" + b)
    out = joined.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("r_" + a, "r_" + b), spread).alias("rho"), F.bool_or(odd(F.col(a)) | odd(F.col(b))).alias("odd"))
    fine = (F.col("n") >= 2) & ~F.coalesce("odd", F.lit(False))
    return out.select("n", F.when(fine, F.col("rho")).alias("rho"), (F.col("n") >= RELIABLE).alias("reliable"))


def calibration(pairs: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(video, dimension, human, judge) -> per video: delta and agreement by dimension with whether all of its dimensions pass;
    and over all: mean agreement by dimension, and whether every video and every mean passes."""
    close = F.greatest(F.lit(0.0), 1 - F.abs(F.col("human") - F.col("judge")) / 10)
    rows = pairs.withColumns({"delta": F.col("judge") - F.col("human"), "agreement": close})
    videos = rows.join(rows.groupBy("video").agg(F.bool_and(F.col("agreement") >= threshold).alias("passed")), "video")
    overall = videos.groupBy("dimension").agg(F.avg("agreement").alias("agreement"), F.bool_and("passed").alias("videos_passed"))
    return videos, overall.withColumn("passed", (F.col("agreement") >= threshold) & F.col("videos_passed")).drop("videos_passed")


def judge_spread(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., dimension, spread): largest less smallest score, two decimals, where it is at least 1."""
    out = unpivoted(scores, keys).groupBy(*keys, "dimension").agg(F.round(F.max("value") - F.min("value"), 2).alias("spread"))
    return out.where("spread >= 1")


def pass_comparison(rows: DataFrame) -> DataFrame:
    """Rows with gold_1, overall_1, gold_2 and overall_2: deltas, and whether the second pass is better without losing much coverage."""
    gold, overall = F.col("gold_2") - F.col("gold_1"), F.col("overall_2") - F.col("overall_1")
    return rows.withColumns({"delta_gold": gold, "delta_overall": overall, "improved": (overall > 0) & (gold >= -0.5)})


def finding_scores(findings: DataFrame, gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cell, gold_coverage, faithfulness, structure, atomicity, overall) from a judge's findings on each cell of gold claims.

    findings: cell, kind (matched, unsupported, redundant, missed, structural), gold_id, gold_text, candidate_text, is_root, severity, issue.
    gold: cell, gold_id, seq, depth, text; candidates: cell, text. Texts are compared normalised, in any case. Findings on texts that are
    no candidates don't count. A match without a known gold id takes the first gold claims of its text, one for each such finding.
    """
    key = lambda c: F.lower(text.normalise(F.col(c)))
    known = candidates.select("cell", key("text").alias("c")).distinct()
    nodes = gold.select("cell", "gold_id", "depth", key("text").alias("g"), "seq")
    rows = findings.withColumns({"c": key("candidate_text"), "g": key("gold_text")}).join(nodes.select("cell", "gold_id", F.col("depth").alias("own")), ["cell", "gold_id"], "left")
    valid = rows.join(known, ["cell", "c"], "left_semi")
    by_id = valid.where("kind = 'matched' AND own IS NOT NULL").select("cell", "gold_id")
    spare = valid.where("kind = 'matched' AND own IS NULL").groupBy("cell", "g").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("cell", "g").orderBy("seq"))
    by_text = nodes.withColumn("nth", nth).join(spare, ["cell", "g"]).where(F.col("nth") <= F.col("n")).select("cell", "gold_id")
    matched = by_id.unionByName(by_text).distinct().groupBy("cell").agg(F.count("*").alias("matched"))
    roots = nodes.where("depth = 0").select("cell", "g", F.lit(True).alias("rooted")).distinct()
    missed = rows.where("kind = 'missed'").join(roots, ["cell", "g"], "left")
    is_root = F.coalesce("is_root", F.lit(False)) | F.when(F.col("own").isNotNull(), F.col("own") == 0).otherwise(F.coalesce("rooted", F.lit(False)))
    missed = missed.groupBy("cell").agg(F.count_if(is_root).alias("missed"))
    doubtful = valid.groupBy("cell").agg(F.count_if(F.col("kind") == "unsupported").alias("unsupported"), F.count_if(F.col("kind") == "redundant").alias("redundant"))
    structural = F.col("kind") == "structural"
    shape = rows.groupBy("cell").agg(F.collect_list(F.when(structural, F.coalesce("severity", F.lit("low")))).alias("severities"), F.count_if(structural & F.lower("issue").rlike("compound|atomic")).alias("compound"))
    out = gold.groupBy("cell").agg(F.count("*").alias("gold")).join(candidates.groupBy("cell").agg(F.count("*").alias("claims")), "cell", "left")
    for df in (matched, missed, doubtful, shape):
        out = out.join(df, "cell", "left")
    out = out.na.fill(0).withColumn("severities", F.coalesce("severities", F.array().cast("array<string>")))
    scores = scalars.judge_scores(*map(F.col, ("gold", "matched", "claims", "unsupported", "redundant", "severities", "compound", "missed")))
    return out.select("cell", scores.alias("s")).select("cell", "s.*")


def priority() -> list[Column]:
    """The order of candidates: score, then coverage, teacher coverage, structure and hierarchy, then fewer unmatched and smaller chunks."""
    hierarchy = F.col("root_ratio") * 2 + F.col("child_ratio")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return [
        F.col("score").desc_nulls_last(), F.desc("ratio"), zero("teacher_ratio").desc(), zero("structural").desc(), hierarchy.desc(), F.asc("unmatched"),
        F.coalesce("max_tokens", F.lit((1 << 53) - 1)).asc(), F.asc("candidate"),
    ]


def optimisation_ranks(candidates: DataFrame) -> DataFrame:
    """Candidates (video, candidate, harness, ratio, root_ratio, child_ratio, unmatched, teacher_ratio, structural, fallback,
    max_tokens) of the harness with score, rank_in_video and best_of_video."""
    score = scalars.optimisation_score(*map(F.col, ("ratio", "root_ratio", "child_ratio", "unmatched", "teacher_ratio", "structural", "fallback", "max_tokens")))
    rows = candidates.where("harness").withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("video").orderBy(*priority()))
    return rows.withColumn("rank_in_video", rank).withColumn("best_of_video", F.col("rank_in_video") == 1)


def best_overall(ranked: DataFrame, n: int) -> DataFrame:
    """The n best of all videos, in order: a top k."""
    return ranked.orderBy(*priority()).limit(n)


def shortlist(ranked: DataFrame, most: int, adaptive: bool = False) -> DataFrame:
    """The best `most` of each video among those that pass the gate and reach max(best - 0.1, 0.75 best) of the video's best ratio; among
    all, where none does. adaptive: only escalated ones (of small requests with a second-version pack), where a video has some."""
    video = W.partitionBy("video")
    best = F.max("ratio").over(video)
    rows = ranked.withColumn("gated", F.coalesce(F.col("gate"), F.lit(False)) & (F.col("ratio") >= F.greatest(best - 0.1, best * 0.75)))
    rows = rows.withColumn("any", F.max("gated").over(video)).where("gated OR NOT any")
    if adaptive:
        rows = rows.withColumn("escalated", F.coalesce((F.col("chunk_mode") == "small-request") & F.col("pack").endswith("-v2"), F.lit(False)))
        rows = rows.withColumn("any", F.max("escalated").over(video)).where("escalated OR NOT any").drop("escalated")
    return rows.withColumn("place", F.row_number().over(video.orderBy(*priority()))).where(F.col("place") <= most).drop("gated", "any")
