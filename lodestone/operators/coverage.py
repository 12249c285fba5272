"""How far candidate claims cover gold claims: scored pairs, greedy one-to-one matches, summary and nearest misses.

Gold: video, gold_id, seq, depth, text. Candidates: video, index, text. Only pairs of one video meet, and only those that share a word
(no stopword) or a normalised text: others cannot reach any threshold.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text, verify

LEXICAL, SEMANTIC, EMBEDDING = 0.3, 0.6, 0.9
MODES = ("strict", "semantic", "embedding")


def pairs(gold: DataFrame, candidates: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """(video, gold_id, seq, depth, index, exact, lexical, semantic, embedding) of the pairs that share a word or a text.

    embeddings: (gold_text, candidate_text, similarity), or null similarities without it. Equal texts of a video are scored once.
    """
    (golds, first), (others, second) = copies(gold, "gold_id"), copies(candidates, "index")
    return spread(scores(first, second, embeddings).drop("seq", "depth"), golds, others).select("video", "gold_id", "seq", "depth", "index", "exact", "lexical", "semantic", "embedding")


def spread(scored: DataFrame, golds: DataFrame, others: DataFrame, most: int = 256) -> DataFrame:
    """Pairs of representatives as the pairs of all their copies: every row of golds and others (keys and `of`) with the scores.

    Only lists of about `most` copies meet the scored pairs; their pairs arise row by row behind the last shuffle.
    """

    def lists(rows: DataFrame, of: str, key: str) -> DataFrame:
        row = F.struct(*[c for c in rows.columns if c not in ("video", "of")])
        parts = rows.groupBy("video", "of").agg(F.ceil(F.count("*") / most).alias("parts"))
        dealt = rows.join(parts.hint("merge"), ["video", "of"]).withColumn("part", F.pmod(F.xxhash64(key), "parts"))
        return dealt.groupBy("video", F.col("of").alias(of), "part").agg(F.collect_list(row).alias(f"{of}_rows")).drop("part")

    told = [c for c in scored.columns if c not in ("video", "gold_id", "index")]
    met = scored.withColumnsRenamed({"gold_id": "gold_of", "index": "index_of"})
    met = met.join(lists(golds, "gold_of", "gold_id").hint("merge"), ["video", "gold_of"]).join(lists(others, "index_of", "index").hint("merge"), ["video", "index_of"])
    each = met.select("video", *told, "index_of_rows", F.explode("gold_of_rows").alias("g"))
    return each.select("video", *told, "g", F.explode("index_of_rows").alias("c")).select("video", "g.*", "c.*", *told)


def scores(gold: DataFrame, candidates: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """`pairs`, row against row."""
    told = lambda df, *keys: df.select("video", *keys, "text", text.key(F.col("text")).alias("k"), verify.features(F.col("text")).alias("f"))
    left, right = told(gold, "gold_id", "seq", "depth"), told(candidates, "index")
    terms = lambda df, key: df.select("video", key, F.explode(F.array_union("f.words", F.array(F.concat(F.lit("="), "k")))).alias("term"))
    # pairs are found by their keys alone; each side's features, worked out once a text, join them afterwards
    ids = terms(left, "gold_id").join(terms(right, "index"), ["video", "term"]).select("video", "gold_id", "index").distinct()
    side = lambda df, n: df.withColumnsRenamed({"text": f"text{n}", "k": f"k{n}", "f": f"f{n}"})
    met = ids.join(side(left, 1), ["video", "gold_id"]).join(side(right, 2), ["video", "index"])
    exact = F.col("k1") == F.col("k2")
    met = met.withColumns({"exact": exact, "lexical": F.when(exact, 1.0).otherwise(text.jaccard(F.col("f1.words"), F.col("f2.words"))), "semantic": F.when(exact, 1.0).otherwise(verify.semantic_of(F.col("f1"), F.col("f2")))})
    if embeddings is None:
        met = met.withColumn("embedding", F.lit(None).cast("double"))
    else:
        near = embeddings.select(F.col("gold_text").alias("text1"), F.col("candidate_text").alias("text2"), F.col("similarity").alias("embedding"))
        met = met.join(near, ["text1", "text2"], "left")
    return met.select("video", "gold_id", "seq", "depth", "index", "exact", "lexical", "semantic", "embedding")


def lexical_pairs(gold: DataFrame, candidates: DataFrame, digits: int = 6, most: int = 4096) -> DataFrame:
    """(video, gold_id, index, exact, lexical) of `pairs`, lexical to so many digits, without a shuffle of pairs.

    Golds and candidates of a video are dealt into parts of about `most`; two parts with their words are one row, whose pairs
    are worked out gold by gold behind the last shuffle. Equal texts of a part are scored once.
    """
    size, spark = "spark.sql.execution.arrow.maxBytesPerBatch", gold.sparkSession
    if not 0 < int(now if (now := spark.conf.get(size).rstrip("b")).isdigit() else 0) <= 16 << 20:
        spark.conf.set(size, str(16 << 20))  # a block is some 500 KB, and a task may have many
    def parts(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.where("video IS NOT NULL AND text IS NOT NULL").select("video", F.struct(F.col(key).alias("key"), text.key(F.col("text")).alias("k"), F.array_distinct(verify.words(F.col("text"))).alias("w")).alias(name))
        return rows, rows.groupBy("video").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}_parts"))

    (golds, g_parts), (others, c_parts) = parts(gold, "gold_id", "g"), parts(candidates, "index", "c")
    numbers = g_parts.join(c_parts, "video")
    of = lambda rows, name: F.pmod(F.xxhash64("video", f"{name}.key"), F.col(f"{name}_parts")).cast("int")
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_parts") - 1))
    left = golds.join(numbers, "video").select("video", of(golds, "g").alias("i"), all_of("c").alias("j"), "g")
    right = others.join(numbers, "video").select("video", all_of("g").alias("i"), of(others, "c").alias("j"), "c")
    tasks = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a block is small and takes long: blocks must not be put together by size
    blocks = left.unionByName(right, allowMissingColumns=True).repartition(tasks, "video", "i", "j").groupBy("video", "i", "j").agg(F.collect_list("g").alias("g"), F.collect_list("c").alias("c"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((gold, "video"), (gold, "gold_id"), (candidates, "index"))]
    return blocks.select("video", *[F.col(f"{n}.{x}").alias(n + x) for n in "gc" for x in ("key", "k", "w")]).mapInArrow(_blocks(digits), f"video {kinds[0]}, gold_id {kinds[1]}, index {kinds[2]}, exact boolean, lexical double")


def _blocks(digits: int, batch: int = 1 << 17):
    def of(row: pa.RecordBatch, r: int):
        video, gids, gk, gw, cids, ck, cw = (row.column(i)[r] for i in range(7))
        gids, cids = gids.values, cids.values
        golds: dict = {}
        for i, x in enumerate(zip(gk.as_py(), map(tuple, gw.as_py()), strict=True)):
            golds.setdefault(x, []).append(i)
        others: dict = {}
        which = np.array([others.setdefault(x, len(others)) for x in zip(ck.as_py(), map(tuple, cw.as_py()), strict=True)], dtype=np.int64)
        words, keys = _Postings([w for _, w in others]), np.array([k for k, _ in others], dtype=object)
        held, rows = [], 0
        for (k, w), copies_ in golds.items():
            if not len(which):
                break
            both, exact = words.shared(w), keys == k
            lexical = np.where(exact, 1.0, words.jaccard(w, both)) * 10.0**digits
            whole = np.trunc(lexical)
            lexical = (whole + (lexical - whole >= 0.5)) / 10.0**digits
            there = ((both > 0) | exact)[which]
            at = np.flatnonzero(there)
            for i in copies_:
                held.append((i, at, exact, lexical))
                rows += len(at)
                if rows >= batch:
                    yield pairs_of(video, gids, cids, which, held)
                    held, rows = [], 0
        if rows:
            yield pairs_of(video, gids, cids, which, held)

    def pairs_of(video, gids, cids, which, held) -> pa.RecordBatch:
        at = np.concatenate([a for _, a, _, _ in held])
        gold = np.repeat([i for i, *_ in held], [len(a) for _, a, _, _ in held])
        told = [pa.array(np.concatenate([x[n][which[x[1]]] for x in held])) for n in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array([video.as_py()], video.type).take(pa.array(np.zeros(len(at), dtype=np.int64))), gids.take(pa.array(gold)), cids.take(pa.array(at)), *told], ["video", "gold_id", "index", "exact", "lexical"])

    def run(batches):
        for batch_ in batches:
            for r in range(batch_.num_rows):
                yield from of(batch_, r)

    return run


def _embedding() -> Column:
    return F.coalesce("embedding", F.lit(0.0))


def eligible(mode: str) -> Column:
    near = _embedding() >= EMBEDDING
    lexical = F.col("lexical") >= LEXICAL
    return F.col("exact") | {"strict": lexical, "embedding": near, "semantic": lexical | (F.col("semantic") >= SEMANTIC) | near}[mode]


def rank_score(mode: str) -> Column:
    of = {"strict": F.col("lexical"), "embedding": _embedding(), "semantic": F.greatest("lexical", "semantic", _embedding())}
    return F.when(F.col("exact"), 10.0).otherwise(of[mode])


def kind(mode: str) -> Column:
    lexical = F.lit(True) if mode == "strict" else F.col("lexical") >= LEXICAL
    return F.when(F.col("exact"), "exact").when(lexical, "lexical").when(_embedding() >= EMBEDDING, "embedding").otherwise("proxy-semantic")


def greedy(group: pd.DataFrame) -> pd.DataFrame:
    """Best pairs first, each gold claim and each candidate once."""
    ranked = group.sort_values(["score", "embedding_or_0", "lexical", "seq", "index"], ascending=[False, False, False, True, True])
    gold, taken, kept = set(), set(), []
    for i, g, c in zip(ranked.index, ranked["gold_id"], ranked["index"], strict=True):
        if g not in gold and c not in taken:
            gold.add(g)
            taken.add(c)
            kept.append(i)
    return ranked.loc[kept]


def matches(scored: DataFrame, mode: str = "semantic") -> DataFrame:
    """The matched pairs with score and kind. The fold has the eligible pairs of one video, without their texts."""
    rows = scored.where(eligible(mode)).withColumns({"score": rank_score(mode), "kind": kind(mode), "embedding_or_0": _embedding()})
    return rows.groupBy("video").applyInPandas(greedy, rows.schema).drop("embedding_or_0")


def matches_of(gold: DataFrame, candidates: DataFrame, mode: str = "semantic", embeddings: DataFrame | None = None) -> DataFrame:
    """`matches` of all pairs, which are never listed: the fold has the features and keys of one video's different texts, and scores them."""

    def texts(rows: DataFrame, side: int, *keys: str) -> DataFrame:
        held = rows.where("video IS NOT NULL AND text IS NOT NULL").groupBy("video", "text").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("held"))
        f = held.select("video", "text", "held", text.key(F.col("text")).alias("k"), verify.features(F.col("text")).alias("f"))
        return f.select("video", F.lit(side).alias("side"), *[F.col(f"held.{x}").alias(x) for x in keys], "k", "f.words", "f.phrases", "f.low", "f.few", *(["text"] if embeddings is not None else []))

    firsts, seconds = texts(gold, 0, "seq", "gold_id"), texts(candidates, 1, "index")
    rows = firsts.unionByName(seconds, allowMissingColumns=True)
    if embeddings is not None:
        near = embeddings.groupBy("gold_text", "candidate_text").agg(F.max_by("similarity", F.coalesce("similarity", F.lit(0.0))).alias("similarity"))
        of = near.join(firsts.select("video", F.col("text").alias("gold_text")), "gold_text").join(seconds.select("video", F.col("text").alias("candidate_text")), ["video", "candidate_text"])
        rows = rows.unionByName(of.select("video", F.lit(2).alias("side"), F.col("gold_text").alias("text"), F.col("candidate_text").alias("k"), "similarity"), allowMissingColumns=True)
    of = {f.name: f.dataType.simpleString() for df in (gold, candidates) for f in df.schema}
    schema = f"video {of['video']}, gold_id {of['gold_id']}, index {of['index']}, exact boolean, lexical double, semantic double, embedding double, score double, kind string"
    # a video's texts are few bytes and take long: their tasks must not be put together by size
    tasks = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "video").groupBy("video").applyInPandas(_matched(mode), schema)


class _Postings:
    """Candidates by what they hold: how many of a claim's distinct items each of them shares."""

    def __init__(self, sets: list):
        self.codes: dict = {}
        flat = np.array([self.codes.setdefault(x, len(self.codes)) for s in sets for x in s], dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(flat, kind="stable")]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(self.codes))))) if len(flat) else np.zeros(1, dtype=np.int64)

    def shared(self, items: set) -> np.ndarray:
        found = [self.rows[self.ends[i] : self.ends[i + 1]] for x in items if (i := self.codes.get(x)) is not None]
        return np.bincount(np.concatenate(found), minlength=len(self.sizes)) if found else np.zeros(len(self.sizes), dtype=np.int64)

    def jaccard(self, items: set, shared: np.ndarray) -> np.ndarray:
        """text.jaccard."""
        return shared / np.maximum(len(items) + self.sizes - shared, 1)


def _ngrams(words: list[str], n: int) -> set:
    return set(zip(*[words[i:] for i in range(n)], strict=False))


class _Scores:
    """The scores of one video's gold texts against all of its candidates' texts, as `scores` has them."""

    def __init__(self, others: pd.DataFrame, near: dict):
        words = [list(w) for w in others["words"]]
        self.words, self.phrases = _Postings([{*w} for w in words]), _Postings([{*p} for p in others["phrases"]])
        self.grams = {n: _Postings([_ngrams(w, n) for w in words]) for n in (2, 3)}
        self.length, self.k, self.low = np.array([len(w) for w in words]), others["k"].to_numpy(dtype=object), others["low"].to_numpy(dtype=object)
        self.near = near

    def of(self, g) -> tuple[np.ndarray, ...]:
        """(there, exact, lexical, semantic, embedding): there where a pair shares a word or a normalised text."""
        words, phrases = list(g.words), {*g.phrases}
        exact, both = self.k == g.k, self.words.shared({*words})
        plain = self.words.jaccard({*words}, both)

        def overlap(n: int) -> np.ndarray:
            if len(words) < n:
                return plain
            grams = _ngrams(words, n)
            return np.where(self.length < n, plain, self.grams[n].jaccard(grams, self.grams[n].shared(grams)))

        semantic = overlap(2) * verify.BIGRAMS + overlap(3) * verify.TRIGRAMS + self.phrases.jaccard(phrases, self.phrases.shared(phrases)) * verify.PHRASES
        if g.few:
            semantic = np.where(self.low == g.low, 1.0, semantic)
        embedding = np.full(len(plain), np.nan)
        for c, x in self.near.get(g.Index, ()):
            embedding[c] = x
        return (both > 0) | exact, exact, np.where(exact, 1.0, plain), np.where(exact, 1.0, semantic), embedding


def _matched(mode: str, held: int = 1_000_000):
    """The fold of `matches_of`: the greedy matches of one video, best pair first.

    Each gold text knows its best open candidates, and the texts stand in a heap by their best pair. What the top one has lost
    to others in the meantime is replaced, so a pair that is met at the top is the best that is left. A text whose known
    candidates are used up is scored anew; in all about `held` pairs are known at once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        gold, others = (rows[rows["side"] == i].reset_index(drop=True) for i in (0, 1))
        near: dict = {}
        if "similarity" in rows:
            at, to = ({t: i for i, t in enumerate(df["text"])} for df in (gold, others))
            for x in rows[rows["side"] == 2].itertuples():
                if not pd.isna(x.similarity):
                    near.setdefault(at[x.text], []).append((to[x.k], x.similarity))
        scored, golds = _Scores(others, near), [*gold.itertuples()]
        queue, open_ = [list(x) for x in others["index"]], [[*zip(g.seq, g.gold_id, strict=True)] for g in golds]
        head, done, front, free = [0] * len(queue), [0] * len(golds), np.array([q[0] for q in queue], dtype=np.int64), np.ones(len(queue), dtype=bool)
        known, last, most = [[] for _ in golds], [()] * len(golds), max(64, min(4096, held // max(len(golds), 1)))

        def look(g: int) -> None:
            """The best open candidates of a gold text, and the key of the last of them if there are more."""
            there, exact, lexical, semantic, embedding = scored.of(golds[g])
            emb = np.where(np.isnan(embedding), 0.0, embedding)
            close = emb >= EMBEDDING
            fits = exact | {"strict": lexical >= LEXICAL, "embedding": close, "semantic": (lexical >= LEXICAL) | (semantic >= SEMANTIC) | close}[mode]
            score = np.where(exact, 10.0, {"strict": lexical, "embedding": emb, "semantic": np.maximum(np.maximum(lexical, semantic), emb)}[mode])
            at = np.flatnonzero(there & fits & free)
            more = len(at) > most
            if more:
                at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
            at = at[np.lexsort((front[at], -lexical[at], -emb[at], -score[at]))][:most]
            known[g] = [*zip((-score[at]).tolist(), (-emb[at]).tolist(), (-lexical[at]).tolist(), front[at].tolist(), at.tolist(), exact[at].tolist(), semantic[at].tolist(), embedding[at].tolist(), strict=True)]
            last[g] = known[g][-1][:4] if more else None

        def put(g: int) -> None:
            while True:
                h = known[g]
                while h:
                    index, c = h[0][3:5]
                    if head[c] >= len(queue[c]):
                        heapq.heappop(h)
                    elif queue[c][head[c]] != index:
                        heapq.heapreplace(h, (*h[0][:3], queue[c][head[c]], *h[0][4:]))
                    else:
                        break
                # a candidate that isn't known comes after the last known one
                if h and (last[g] is None or h[0][:4] <= last[g]):
                    heapq.heappush(heap, (*h[0][:3], *open_[g][done[g]], h[0][3], g))
                    return
                if last[g] is None:
                    return
                look(g)

        heap, out = [], []
        for g in range(len(golds) if queue else 0):
            put(g)
        while heap:
            *_, index, g = heapq.heappop(heap)
            s, _, l, now, c, exact, semantic, embedding = known[g][0]
            if now == index and head[c] < len(queue[c]) and queue[c][head[c]] == index:
                kind = "exact" if exact else "lexical" if mode == "strict" or -l >= LEXICAL else "embedding" if embedding >= EMBEDDING else "proxy-semantic"
                out.append((rows["video"][0], open_[g][done[g]][1], index, exact, -l, semantic, None if embedding != embedding else embedding, -s, kind))
                head[c], done[g] = head[c] + 1, done[g] + 1
                free[c] = head[c] < len(queue[c])
                if free[c]:
                    front[c] = queue[c][head[c]]
            if done[g] < len(open_[g]):
                put(g)
        return pd.DataFrame(out, columns=["video", "gold_id", "index", "exact", "lexical", "semantic", "embedding", "score", "kind"])

    return run


def copies(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(video, key, of) with the least key of the equal texts of a video, and the rows whose key that is."""
    least = rows.where("text IS NOT NULL").groupBy("video", "text").agg(F.min(key).alias("of"))
    # merged: tables that look small in files must not go to the driver
    return rows.join(least.hint("merge"), ["video", "text"]).select("video", key, *[c for c in ("seq", "depth") if c in rows.columns], "of"), rows.join(least.select("video", F.col("of").alias(key)).hint("merge"), ["video", key], "left_semi")


def summary(gold: DataFrame, matched: DataFrame) -> DataFrame:
    """(video, matched, total, ratio, roots_matched, roots_total, root_ratio, children_matched, children_total, child_ratio)."""
    rows = gold.select("video", "gold_id", "depth").join(matched.select("video", "gold_id", F.lit(True).alias("hit")), ["video", "gold_id"], "left")
    hit, root = F.col("hit").isNotNull(), F.col("depth") == 0
    out = rows.groupBy("video").agg(
        F.count_if(hit).alias("matched"), F.count("*").alias("total"), F.count_if(hit & root).alias("roots_matched"), F.count_if(root).alias("roots_total"),
        F.count_if(hit & ~root).alias("children_matched"), F.count_if(~root).alias("children_total"),
    )
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return out.withColumns({"ratio": share("matched", "total"), "root_ratio": share("roots_matched", "roots_total"), "child_ratio": share("children_matched", "children_total")})


def unmatched(gold: DataFrame, candidates: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold claims and candidates that no pair holds."""
    return gold.join(matched.select("video", "gold_id"), ["video", "gold_id"], "left_anti"), candidates.join(matched.select("video", "index"), ["video", "index"], "left_anti")


def nearest_misses(gold: DataFrame, candidates: DataFrame, scored: DataFrame, matched: DataFrame) -> DataFrame:
    """(video, gold_id, index, lexical, semantic, embedding): each unmatched gold claim with its best candidate, matched or not; where
    none shares a word, the first one with scores 0; index is null for a video without candidates."""
    best = F.greatest("lexical", "semantic", _embedding())
    top = scored.groupBy("video", "gold_id").agg(F.max(F.struct(best.alias("best"), _embedding().alias("e"), (-F.col("index")).alias("order"), "index", "lexical", "semantic", "embedding")).alias("near"))
    first = candidates.groupBy("video").agg(F.min("index").alias("first"))
    open_, _ = unmatched(gold, candidates, matched)
    rows = open_.select("video", "gold_id").join(top, ["video", "gold_id"], "left").join(first, "video", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("video", "gold_id", F.coalesce("near.index", "first").alias("index"), zero("near.lexical").alias("lexical"), zero("near.semantic").alias("semantic"), "near.embedding")


def best_teacher(summaries: DataFrame) -> DataFrame:
    """(video, teacher, ...) -> of each video the teacher with the best ratio, then root ratio, then by name."""
    order = W.partitionBy("video").orderBy(F.desc("ratio"), F.desc("root_ratio"), "teacher")
    return summaries.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def flattened_gold(annotations: DataFrame) -> DataFrame:
    """(video_id, claims: JSON text of a list of nodes with text, type and children) -> (video, gold_id, parent_id, seq, depth, path, text, type).

    Depth first; ids are video:1.2.1 with one-based places. The tree is read level by level as VARIANT, one step for each level
    that is there, so its depth has no bound.
    """
    level = annotations.select(F.col("video_id").alias("video"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("path"), F.try_parse_json("claims").alias("nodes"))
    out = None
    while True:
        each = level.select("video", "parent_id", "path", F.posexplode(F.try_variant_get("nodes", "$", "array<variant>")).alias("i", "node"))
        path = F.concat("path", F.array(F.col("i") + 1))
        each = each.withColumn("path", path).withColumn("gold_id", F.concat("video", F.lit(":"), F.array_join("path", ".")))
        rows = each.select("video", "gold_id", "parent_id", (F.size("path") - 1).alias("depth"), "path", F.try_variant_get("node", "$.text", "string").alias("text"), F.try_variant_get("node", "$.type", "string").alias("type"))
        out = rows if out is None else out.unionByName(rows)
        level = each.select("video", F.col("gold_id").alias("parent_id"), "path", F.try_variant_get("node", "$.children", "variant").alias("nodes"))
        level = level.where(F.size(F.try_variant_get("nodes", "$", "array<variant>")) > 0)
        if level.isEmpty():
            order = W.partitionBy("video").orderBy("path")
            return out.withColumn("seq", F.row_number().over(order))
