"""Claim candidates: scores, the two greedy dedupe folds, chunking and the editor pass.

Candidates: video, id, text, start, confidence, excerpt_ids, and if known domain, classification, evidence_type.
Scores are Column expressions. The folds depend on order and aren't transitive, so they run over the ranked candidates
of one video at a time, whose number the length of the video bounds; what a candidate is compared with is looked up by
shared token or excerpt.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import cmp_to_key

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text, verify
from lodestone.operators import segments

# Word lists, patterns, weights and thresholds that decide results.
BOILERPLATE = (
    r"\bsubscribe\b", r"like and subscribe", r"smash that (like|subscribe)", r"\bsponsor\b", r"patreon", r"thanks for watching",
    r"welcome back", r"\bintro\b", r"\boutro\b", r"\bspecial offer\b", r"\bdiscount code\b", r"\bpromo code\b",
    r"\buse code [A-Z0-9_-]{3,}\b", r"\blinked (?:below|down below)\b", r"\blink (?:below|down below|in the description)\b",
    r"\baffiliate link\b", r"\bsupport the (channel|show|podcast)\b", r"\bclick (the link|link below|down below)\b",
    r"\bcheck out (the description|below|my link)\b", r"\bfollow me on\b", r"\bjoin the (discord|community|patreon)\b",
    r"\byou can earn \d+(?:\.\d+)?%\s+apy\b", r"\bpartner banks?\b", r"\bwealthfront\b",
)
CONJUNCTIONS = ("and", "but", "so", "or", "then")
PRONOUNS = (
    "this", "that", "these", "those", "it", "its", "they", "them", "their", "he", "him", "his", "she", "her", "hers",
    "we", "us", "our", "you", "your", "which", "who", "whose",
)
ACTIONS = ("do", "avoid", "use", "try", "stop", "start", "increase", "decrease", "step", "rule", "create", "set", "measure", "track")
STEPS = (r"\bstep\s+\d+\b", r"\bfirst\b", r"\bthen\b", r"\bnext\b", r"\bfinally\b")
NUMBER_OR_UNIT = r"(?i)\b\d+(?:\.\d+)?(?:%|mg|g|kg|ml|l|hour|hours|min|minute|minutes|sec|seconds)?\b"
NEGATIONS = (
    "not", "no", "never", "neither", "none", "without", "lack", "except", "cannot", "won", "don", "didn", "doesn", "isn", "aren",
    "wasn", "weren", "haven", "hasn", "hadn", "shouldn", "wouldn", "couldn",
)
COMPARATIVES = ("more", "less", "better", "worse", "best", "worst", "highest", "lowest", "most", "least")
NEGATED_VERBS = ("do", "does", "did", "is", "are", "was", "were", "have", "has", "had", "should", "would", "could")
DEDUPE_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "should", "now",
)
EXCERPT_OVERLAP, EXCERPT_JACCARD, SEMANTIC = 0.8, 0.4, 0.75

_SPLIT = regex.compile(r"[^\p{L}\p{N}]+")
_NUMBER = regex.compile(r"[0-9]+(?:\.[0-9]+)?")
_NOT = regex.compile(rf"\b({'|'.join(NEGATED_VERBS)})n(?:'t)?\b", regex.ASCII)


def boilerplate(x: Column) -> Column:
    return x.rlike("(?i)(?:" + "|".join(BOILERPLATE) + ")")


def too_short(x: Column, words: int = 8, chars: int = 50) -> Column:
    """Few words or characters, a conjunction at the end, an ellipsis, or three fillers."""
    t = text.normalise(x)
    few = (F.length(t) < chars) | (F.size(F.filter(F.split(t, " "), lambda w: w != "")) < words)
    return few | F.lower(F.substring_index(t, " ", -1)).isin(*CONJUNCTIONS) | t.contains("...") | (F.regexp_count(t, F.lit(r"(?i)\b(?:uh|um)\b")) >= 3)


def too_short_v1(x: Column) -> Column:
    t = F.trim(x)
    return (F.length(t) < 40) | (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) < 6)


def fragment(x: Column, words: int = 8, chars: int = 50) -> Column:
    """As too_short, without the rule of fillers: what the metric counts."""
    t = text.normalise(x)
    few = (F.length(t) < chars) | (F.size(F.filter(F.split(t, " "), lambda w: w != "")) < words)
    return few | F.lower(F.substring_index(t, " ", -1)).isin(*CONJUNCTIONS) | t.contains("...")


def metrics(claims: DataFrame) -> DataFrame:
    """(video, claims, fragments, boilerplate)."""
    of = lambda c: F.count_if(c)
    return claims.groupBy("video").agg(F.count("*").alias("claims"), of(fragment(F.col("text"))).alias("fragments"), of(boilerplate(F.col("text"))).alias("boilerplate"))


def echoes(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """claims with echo: the largest token overlap with an excerpt (video, id, content) of its own that has a text; null for
    claims of fewer than 20 characters and without such an excerpt."""
    known = excerpts.where("content <> ''").select("video", F.col("id").alias("excerpt_id"), "content")
    each = claims.select("video", "id", F.lower(text.normalise(F.col("text"))).alias("t"), F.explode("excerpt_ids").alias("excerpt_id"))
    near = each.where(F.length("t") >= 20).join(known, ["video", "excerpt_id"]).groupBy("video", "id").agg(F.max(verify.lexical(F.col("t"), F.col("content"))).alias("echo"))
    return claims.join(near, ["video", "id"], "left")


def actionability(x: Column) -> Column:
    t = F.lower(text.normalise(x))
    steps = sum((t.rlike(p).cast("int") for p in STEPS), F.lit(0))
    return text.clamp((F.size(F.array_intersect(F.split(t, " "), F.array(*map(F.lit, ACTIONS)))) + steps) * 0.25, 0.0, 1.0)


def specificity(x: Column) -> Column:
    """0.6 for a number; 0.4 for capitalised words after the first, unless nearly all are in capitals, which costs 0.2."""
    t = text.normalise(x)
    words = F.split(t, " ")
    share = lambda a, rule: F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: w.rlike(rule))) / F.size(a)).otherwise(0.0)
    tail = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    shape = F.when(share(words, "^[A-Z]{2,}$") > 0.8, -0.2).when(share(tail, "^[A-Z][a-z]") >= 0.15, 0.4).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(text.clamp(F.when(t.rlike(NUMBER_OR_UNIT), 0.6).otherwise(0.0) + shape, 0.0, 1.0))


def evidence(excerpts: Column, mean_length: Column | None = None) -> Column:
    of_count = text.clamp(excerpts / 3, 0.0, 1.0) * 0.5
    return of_count if mean_length is None else text.clamp(of_count + text.clamp(F.coalesce(mean_length, F.lit(0.0)) / 160, 0.0, 1.0) * 0.5, 0.0, 1.0)


def score_v1(x: Column, confidence: Column) -> Column:
    return text.clamp(F.coalesce(confidence, F.lit(0.6)), 0.0, 1.0) * 0.7 + text.clamp(F.length(x) / 180, 0.0, 1.0) * 0.3


def score_v2(claims: DataFrame, mean_length: Column | None = None) -> Column:
    """0 to 1: confidence, length, action, detail, evidence and metadata, less for boilerplate, fragments and pronouns."""
    t = text.normalise(F.col("text"))
    given = lambda name, w: F.when(F.coalesce(F.col(name), F.lit("")) != "", w).otherwise(0.0) if name in claims.columns else F.lit(0.0)
    cost = lambda c, w: F.when(c, w).otherwise(0.0)
    score = (
        text.clamp(F.coalesce("confidence", F.lit(0.6)), 0.0, 1.0) * 0.2 + text.clamp(F.length(t) / 220, 0.0, 1.0) * 0.1 + actionability(t) * 0.25 + specificity(t) * 0.15
        + evidence(F.coalesce(F.size(F.array_distinct("excerpt_ids")), F.lit(0)), mean_length) * 0.15
        + given("domain", 0.15) + given("classification", 0.1) + given("evidence_type", 0.1)
        - cost(boilerplate(t), 0.55) - cost(too_short(t), 0.5) - cost(F.lower(F.substring_index(t, " ", 1)).isin(*PRONOUNS), 0.15)
    )
    return text.clamp(score, 0.0, 1.0)


def key_of(x: str) -> str:
    return " ".join(regex.sub(r"""[.",;:!?()\[\]{}'‘’“”]""", "", " ".join(x.split()).lower()).split())


def words_of(x: str, stop: Iterable[str]) -> set[str]:
    return {w for w in _SPLIT.split(x.lower()) if w} - set(stop)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _qualifiers(x: str) -> Counter:
    """Counts of negating and comparing words, contracted negations written out."""
    x = regex.sub(r"(?a)\bcan't\b", "cannot", regex.sub(r"(?a)\bwon't\b", "will not", x.lower()))
    words = regex.sub(r"[^\p{L}\p{N}\s']", " ", _NOT.sub(r"\1 not", x)).replace("'", "").split()
    return Counter(w for w in words if w in NEGATIONS or w in COMPARATIVES)


def same_meaning(a: str, b: str, threshold: float = SEMANTIC) -> bool:
    """Much the same words, the same numbers, and as many negating and comparing words."""
    if _jaccard(words_of(a, text.STOPWORDS), words_of(b, text.STOPWORDS)) < threshold:
        return False
    if _qualifiers(a) != _qualifiers(b) or set(_NUMBER.findall(a)) != set(_NUMBER.findall(b)):
        return False
    x, y = words_of(a, DEDUPE_STOPWORDS), words_of(b, DEDUPE_STOPWORDS)
    return not x or not y or _jaccard(x, y) >= threshold


def _before(a, b) -> int:
    """Higher scores first (equal within 1e-6), then earlier, then by text and excerpts."""
    if abs(a.score - b.score) > 1e-6:
        return -1 if a.score > b.score else 1
    x, y = ((float("inf") if pd.isna(r.start) else r.start, r.text, "|".join(sorted(r.excerpts))) for r in (a, b))
    return (x > y) - (x < y)


def keep_first(group: pd.DataFrame, semantic: bool = True) -> pd.DataFrame:
    """The ranked candidates of a video without those that repeat a better one (semantic: in other words, too)."""
    group = group.reset_index(drop=True)
    columns = ["video", "id", "text", "start", "score"]
    held = group[columns].assign(excerpts=[set() if e is None else set(e) for e in group["excerpt_ids"]])
    ranked = sorted(held.itertuples(), key=cmp_to_key(_before))
    words = {r.Index: words_of(r.text, text.STOPWORDS) for r in ranked}
    keys, by_excerpt, first = set(), defaultdict(list), []
    for r in ranked:
        shared = Counter(i for e in r.excerpts for i, _ in by_excerpt[e])
        sizes = {i: n for e in r.excerpts for i, n in by_excerpt[e]}
        near = any(n / min(len(r.excerpts), sizes[i]) >= EXCERPT_OVERLAP and _jaccard(words[i], words[r.Index]) >= EXCERPT_JACCARD for i, n in shared.items())
        if near or (k := key_of(r.text)) in keys:
            continue
        keys.add(k)
        first.append(r)
        for e in r.excerpts:
            by_excerpt[e].append((r.Index, len(r.excerpts)))
    by_word, kept = defaultdict(list), []
    if not semantic:
        return group.loc[[r.Index for r in first]]
    for r in first:
        shared = Counter(i for w in words[r.Index] for i in by_word[w])
        sure = (i for i, n in shared.items() if n / (len(words[i]) + len(words[r.Index]) - n) >= SEMANTIC)
        if any(same_meaning(r.text, group["text"][i]) for i in sure):
            continue
        kept.append(r.Index)
        for w in words[r.Index]:
            by_word[w].append(r.Index)
    return group.loc[kept]


def deduped(scored: DataFrame, semantic: bool = True) -> DataFrame:
    return scored.groupBy("video").applyInPandas(lambda group: keep_first(group, semantic), scored.schema)


DROPPED = ("empty", "boilerplate", "fragment", "duplicate", "coverage")


def _fates(claims: DataFrame, dropped: Column, semantic: bool, select) -> DataFrame:
    """claims (with score) and fate: why a candidate goes, or selected. dropped: null for those that meet the dedupe."""
    marked = claims.withColumn("_dropped", dropped)
    unique = deduped(marked.where("_dropped IS NULL").select("video", "id", "text", "start", "score", "excerpt_ids", *(["chunk"] if "chunk" in claims.columns else [])), semantic)
    chosen = select(unique).select("video", "id", F.lit("selected").alias("_chosen"))
    passed = unique.select("video", "id", F.lit("coverage").alias("_passed")).join(chosen, ["video", "id"], "left")
    fate = F.coalesce("_dropped", "_chosen", "_passed", F.lit("duplicate"))
    return marked.join(passed, ["video", "id"], "left").withColumn("fate", fate).drop("_dropped", "_chosen", "_passed")


def editor_fates(claims: DataFrame, most: int = 20, least_windows: int | Column = 4, cap: int = 2, threshold: float = 0.2) -> DataFrame:
    """Second pass: scores; drops empty candidates, and boilerplate or fragments of a score up to the threshold; dedupes;
    selects over the windows of a video. least_windows may be a column of `claims`."""
    t = text.normalise(F.col("text"))
    scored = claims.withColumn("score", score_v2(claims))
    weak = F.col("score") <= threshold
    dropped = F.when(t == "", "empty").when(boilerplate(t) & weak, "boilerplate").when(too_short(t) & weak, "fragment")
    chunk = F.col("chunk") if "chunk" in claims.columns else None
    wanted = least_windows if isinstance(least_windows, int) else None

    def select(unique: DataFrame) -> DataFrame:
        if wanted is not None:
            return segments.diverse(unique, most, wanted, cap, chunk=chunk)
        per_video = claims.groupBy("video").agg(F.first(least_windows).alias("_least"))
        return segments.diverse(unique.join(per_video, "video"), most, F.col("_least"), cap, chunk=chunk)

    return _fates(scored, dropped, True, select)


def editor_fates_v1(claims: DataFrame, most: int = 20, chunks: int = 1) -> DataFrame:
    """First pass: empty candidates, boilerplate and short ones go whatever their score; equal texts and shared excerpts are deduped;
    the best of each chunk comes first."""
    t = text.normalise(F.col("text"))
    scored = claims.withColumn("score", score_v1(F.col("text"), F.col("confidence")))
    dropped = F.when(t == "", "empty").when(boilerplate(t), "boilerplate").when(too_short_v1(t), "fragment")
    return _fates(scored, dropped, False, lambda unique: segments.diverse_by_chunk(unique, most, chunks))


def diagnostics(fates: DataFrame) -> DataFrame:
    """(video, total, selected, and a count by reason): selected and dropped add up to the total."""
    of = lambda fate: F.count_if(F.col("fate") == fate).alias(fate)
    return fates.groupBy("video").agg(F.count("*").alias("total"), of("selected"), *map(of, DROPPED))


def output_order() -> list[Column]:
    return [F.col("start").asc_nulls_last(), F.col("text"), F.array_join(F.array_sort(F.array_distinct("excerpt_ids")), "|")]


def editor_pass(claims: DataFrame, most: int = 20) -> DataFrame:
    """The second pass's selection: (video, id, start, score, window)."""
    chosen = editor_fates(claims, most).where("fate = 'selected'")
    return chosen.select("video", "id", "start", "score", segments.window_of(chunk=F.col("chunk") if "chunk" in claims.columns else None).alias("window"))


def time_chunks(excerpts: DataFrame, minutes: float = 5, most: int = 0) -> DataFrame:
    """(video, id, start) with chunk: a chunk opens at the first excerpt that starts so long after the chunk's own first one;
    with `most` the last chunk takes the rest."""
    length = max(60, int(minutes * 60))

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(start=group["start"].fillna(0.0)).sort_values(["start", "id"])
        chunk, opened, out = 0, None, []
        for at in group["start"]:
            opened = at if opened is None else opened
            if at - opened >= length and (not most or chunk < most - 1):
                chunk, opened = chunk + 1, at
            out.append(chunk)
        return group.assign(chunk=out)[["video", "id", "start", "chunk"]]

    schema = f"video {excerpts.schema['video'].dataType.simpleString()}, id {excerpts.schema['id'].dataType.simpleString()}, start double, chunk int"
    return excerpts.select("video", "id", F.col("start").cast("double")).groupBy("video").applyInPandas(dealt, schema)


#: Tokens of a request from which a chunk ends in any case, and by how much a target may be passed before it ends anywhere.
FORCED_TOKENS, SOFT = 6000, 1.25


def _semantic_fold(rows: pd.DataFrame, target: int, hard: int, overlap: int, most: int) -> list[tuple[int, int]]:
    """(chunk, row) in order, for rows with tokens, ends (whether a chunk may well end behind a row)."""
    chunks: list[list[int]] = []
    now: list[int] = []
    tokens = rows["tokens"].tolist()
    ends = rows["ends"].tolist()
    total, n = 0, len(rows)
    room = lambda: not most or len(chunks) < most - 1

    def close() -> None:
        nonlocal now, total
        chunks.append(now)
        now = now[-overlap:] if overlap else []
        total = sum(tokens[i] for i in now)

    for i in range(n):
        if now and total + tokens[i] > hard and room():
            close()
        if not now:
            now, total = [i], tokens[i]
            continue
        now = [*now, i]
        total += tokens[i]
        if i == n - 1 or not room():
            continue
        soft = total >= -(-target * SOFT // 1) and len(now) >= 2
        if total > hard or total >= FORCED_TOKENS or total >= target and (ends[i] or soft):
            close()
    if now:
        chunks.append(now)
    return [(c, i) for c, rows_ in enumerate(chunks) for i in rows_]


def semantic_chunks(excerpts: DataFrame, target: int = 1500, hard: int = 3000, overlap: int = 2, most: int = 0) -> DataFrame:
    """(video, id, start, content) -> (video, chunk, place, id): chunks up to a token budget that end, if they can, behind a whole
    sentence; each but the first begins with the last `overlap` excerpts of the one before.

    The fold gets each excerpt's token count and flags, not its text; a video's excerpts are one task.
    """
    target = max(200, target)
    hard = max(target, hard)
    t = text.normalise(F.coalesce("content", F.lit("")))
    order = W.partitionBy("video").orderBy("start", "id")
    rows = excerpts.select("video", "id", F.coalesce(F.col("start").cast("double"), F.lit(0.0)).alias("start"), t.alias("t"))
    following = F.coalesce(F.lead("t").over(order), F.lit(""))
    ends = ~text.dangling(F.col("t")) & (F.coalesce(text.complete(F.col("t")), F.lit(False)) | ~text.starts_with_connector(following))
    rows = rows.withColumn("tokens", text.estimated_tokens(F.col("t"))).withColumn("ends", ends).drop("t")

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "id"]).reset_index(drop=True)
        found = _semantic_fold(group, target, hard, overlap, most)
        out = group.loc[[i for _, i in found], ["video", "id"]].assign(chunk=[c for c, _ in found])
        return out.assign(place=out.groupby("chunk").cumcount())[["video", "chunk", "place", "id"]]

    kinds = {c: excerpts.schema[c].dataType.simpleString() for c in ("video", "id")}
    return rows.groupBy("video").applyInPandas(dealt, f"video {kinds['video']}, chunk int, place int, id {kinds['id']}")


def whole_chunk(excerpts: DataFrame) -> DataFrame:
    """(video, chunk, place, id): all excerpts of a video as chunk 0, by start and id."""
    start = F.coalesce(F.col("start").cast("double"), F.lit(0.0))
    place = F.row_number().over(W.partitionBy("video").orderBy(start, "id")) - 1
    return excerpts.select("video", F.lit(0).alias("chunk"), place.cast("int").alias("place"), "id")


def halved(tokens: list[int], most: int) -> list[int]:
    """The sizes of the runs that halving a run of these token counts gives, until each fits or is a single one."""
    if sum(tokens) <= most or len(tokens) < 2:
        return [len(tokens)]
    middle = len(tokens) // 2
    return halved(tokens[:middle], most) + halved(tokens[middle:], most)


def budget_split(chunks: DataFrame, most: int, overhead: int = 0) -> DataFrame:
    """(video, chunk, place, id, tokens) -> the same with chunks halved until their tokens and a request's overhead fit `most`."""

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        for _, part in group.sort_values(["chunk", "place"]).groupby("chunk"):
            sizes, begin = halved(part["tokens"].tolist(), most - overhead), 0
            for n in sizes:
                run = part.iloc[begin : begin + n]
                out.append(run.assign(chunk=at, place=range(n)))
                at, begin = at + 1, begin + n
        return pd.concat(out)[["video", "chunk", "place", "id", "tokens"]]

    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("video", "id")}
    return chunks.select("video", "chunk", "place", "id", "tokens").groupBy("video").applyInPandas(dealt, f"video {kinds['video']}, chunk int, place int, id {kinds['id']}, tokens long")


def _packing(now: Column, units: Column, most: int) -> Column:
    """now: struct<done array<string>, open string>; units (n, tokens, first) are added in order, a new chunk opening where one won't fit.

    Budgets count the characters of a unit, a quarter of them a token, and a token for each space between units.
    """

    def add(state: Column, unit: Column) -> Column:
        full = (state["open"] != "") & (unit["alone"] | (state["total"] + 1 + unit["size"] > most))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["open"] == ""), unit["s"]).otherwise(F.concat(state["open"], F.lit(" "), unit["s"])).alias("open"),
            F.when(full | (state["open"] == ""), unit["size"]).otherwise(state["total"] + unit["size"] + 1).alias("total"),
        )

    return F.aggregate(units, now, add)


def text_chunks(x: Column, most: int = 2000) -> Column:
    """Sentences joined up to the token budget; one over the budget starts a chunk of its own and is split at words."""
    size = lambda s: F.ceil(F.length(s) / 4).cast("long")
    unit = lambda s, alone: F.struct(s.alias("s"), size(s).alias("size"), alone.alias("alone"))
    words = lambda s: F.filter(F.split(s, " "), lambda w: w != "")
    units = F.flatten(F.transform(text.sentences(x), lambda s: F.when(size(s) > most, F.transform(words(s), lambda w, i: unit(w, i == 0))).otherwise(F.array(unit(s, F.lit(False))))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("long").alias("total"))
    packed_ = F.transform(F.array(_packing(empty, units, most)), lambda p: F.when(p["open"] == "", p["done"]).otherwise(F.concat(p["done"], F.array(p["open"]))))
    return F.when(x.isNotNull(), F.element_at(packed_, 1))
