"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts character n-grams of words by language over a bounded sample of labelled rows.
A word's score for a language is the smoothed log probability of its n-grams, relative to the
word's best language and floored. Scripts come first: a language is a candidate for a word only
if the language's training text uses the word's script. Viterbi with one penalty for every
switch then labels each word, and runs of equal labels are the spans.

Defined results: an empty table gives an empty table; null text, empty text and text without a letter give `und`, score 0 and no
spans. Words without letters belong to the span around them. Ties go to the language first in
alphabetical order. A model that has learned no language gives `und` to every text. Extra columns of the input are ignored except those asked for in `keep`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, lean, sampled, with_text

#: First code point of each block of letters, in order (fixed values from the Unicode charts).
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z\u00aa-\u036f]+")
UNDETERMINED = "und"


def script(letter: str) -> str:
    from bisect import bisect_right

    at = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPT_RANGES[at][1] if at >= 0 else "other"


def word_script(letters: str) -> str:
    """The script most of a word's letters have; ties to the alphabetically first."""
    if _LATIN.fullmatch(letters):
        return "latin"
    found = Counter(map(script, letters))
    return min(found, key=lambda s: (-found[s], s))


def grams(letters: str, longest: int) -> list[str]:
    """N-grams of 2 to `longest` characters of a word with a space on both sides."""
    padded = f" {letters} "
    out = [x + y for x, y in zip(padded, padded[1:], strict=False)]
    for n in range(3, longest + 1):
        out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


@dataclass
class LanguageModel:
    """table: scores of n-grams by language; rows 0 to `longest` are for unseen n-grams of that length."""

    langs: list[str]
    scripts: list[frozenset[str]]
    index: dict[str, int]
    table: np.ndarray
    longest: int
    switch_penalty: float
    floor: float

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language of white-space separated tokens, and their letters; 0 and 0 for a token without one."""
        scores = np.zeros((len(tokens), len(self.langs)), dtype=np.float32)
        letters = np.zeros(len(tokens), dtype=np.int32)
        rows, starts, at, foreign = [], [], [], []
        get = self.index.get
        for i, token in enumerate(tokens):
            low = token.lower()
            parts = [low] if low.isalpha() else _LETTERS.findall(low)
            if not parts:
                continue
            starts.append(len(rows))
            at.append(i)
            letters[i] = sum(map(len, parts))
            for part in parts:
                found = grams(part, self.longest)
                ids = list(map(get, found))
                if None in ids:
                    ids = [len(g) if r is None else r for g, r in zip(found, ids, strict=True)]
                rows += ids
            if not low.isascii():
                foreign.append((i, word_script("".join(parts))))
        if at and self.langs:
            scores[at] = np.add.reduceat(self.table[rows], starts, axis=0)
            plain = np.array([("latin" in s) for s in self.scripts])
            kinds = {i: s for i, s in foreign}
            odd = {s for s in kinds.values() if s != "latin"}
            if not plain.all() and plain.any():
                scores[np.ix_([i for i in at if kinds.get(i, "latin") == "latin"], ~plain)] = -np.inf
            elif not plain.any():
                scores[[i for i in at if kinds.get(i, "latin") == "latin"]] = 0
            for s in odd:
                mine = [i for i, x in kinds.items() if x == s]
                able = np.array([s in x for x in self.scripts])
                if able.any():
                    scores[np.ix_(mine, ~able)] = -np.inf
                else:
                    scores[mine] = 0
            scores[at] = np.maximum(scores[at] - scores[at].max(axis=1, keepdims=True), -self.floor)
        return scores, letters


def _count_batches(longest: int):
    @lean
    def run(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang is not None and text:
                    by.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            langs, keys, counts, kinds = [], [], [], []
            for lang, words in by.items():
                found, scripts = Counter(), Counter()
                for w, n in words.items():
                    scripts[word_script(w)] += n * len(w)
                    for g in grams(w, longest):
                        found[g] += n
                for kind, source in (("gram", found), ("script", scripts)):
                    langs += [lang] * len(source)
                    kinds += [kind] * len(source)
                    keys += source.keys()
                    counts += source.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())],
                ["lang", "kind", "key", "n"],
            )

    return run


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    rows_a_language: int = 1000,
    longest: int = 3,
    max_grams: int = 60_000,
    script_share: float = 0.01,
    switch_penalty: float = 14.0,
    floor: float = 10.0,
) -> LanguageModel:
    """Fit on `text` and `lang` of about rows_a_language rows of each language, however rare it is in the table.

    Of each language's n-grams the max_grams most frequent are kept, whatever the other languages have.
    """
    arrow_rows(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    rows = sampled(known, "_id", rows_a_language, "_lang")
    counts = (
        rows.select("_lang", "_text")
        .mapInArrow(_count_batches(longest), "lang string, kind string, key string, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    # the n-grams of a bounded sample: a window by language holds no more than these
    nth = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    kept = counts.withColumn("nth", nth).where(F.col("nth") <= max_grams).drop("nth").orderBy("kind", "lang", F.desc("n"), "key").toArrow().to_pylist()
    langs = sorted({r["lang"] for r in kept})
    at = {x: i for i, x in enumerate(langs)}
    letters = {x: Counter() for x in langs}
    raw: dict[str, np.ndarray] = {}
    for r in kept:
        if r["kind"] == "script":
            letters[r["lang"]][r["key"]] += r["n"]
        else:
            raw.setdefault(r["key"], np.zeros(len(langs)))[at[r["lang"]]] += r["n"]
    totals = np.zeros((longest + 1, len(langs)))
    kinds = np.zeros(longest + 1)
    for g, row in raw.items():
        totals[len(g)] += row
        kinds[len(g)] += 1
    smooth = 0.5
    index, table = {}, np.zeros((longest + 1 + len(raw), len(langs)), dtype=np.float32)
    for n in range(2, longest + 1):
        unseen = np.log(smooth / (totals[n] + smooth * max(kinds[n], 1)))
        table[n] = unseen - unseen.max(initial=-np.inf) if len(langs) else 0
    for i, (g, row) in enumerate(raw.items(), longest + 1):
        score = np.log((row + smooth) / (totals[len(g)] + smooth * kinds[len(g)]))
        index[g], table[i] = i, score - score.max()
    scripts = [frozenset(s for s, n in letters[x].items() if n >= script_share * max(1, sum(letters[x].values()))) for x in langs]
    return LanguageModel(langs, scripts, index, table, longest, switch_penalty, floor)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label for each word of each text under a constant switching penalty.

    A text whose best single language can't be bettered by any excursion (no run of words gains
    the others more than one penalty) is settled at once; the rest run side by side, longest first.
    """
    out: list[np.ndarray] = [np.zeros(len(s), dtype=np.int16) for s in scores]
    hard = []
    for i, s in enumerate(scores):
        if not len(s) or s.shape[1] < 2:
            continue
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum((s.max(axis=1) - s[:, best]) if s.shape[1] == 1 else np.delete(s, best, axis=1).max(axis=1) - s[:, best])
        low = np.minimum(np.minimum.accumulate(np.concatenate(([0.0], gain[:-1]))), 0)
        if (gain - low).max() <= penalty:
            out[i][:] = best
        else:
            hard.append(i)
    hard.sort(key=lambda i: -len(scores[i]))
    if not hard:
        return out
    lengths = np.array([len(scores[i]) for i in hard])
    k = scores[hard[0]].shape[1]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.concatenate([scores[i] for i in hard])
    stay = np.ones((len(flat), k), dtype=bool)
    source = np.zeros(len(flat), dtype=np.int16)
    value = flat[offsets[:-1]].copy()
    for t in range(1, int(lengths[0])):
        m = int(np.searchsorted(-lengths, -t, side="left"))
        rows = offsets[:m] + t
        v = value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top][:, None] - penalty
        keep = v >= jump
        stay[rows] = keep
        source[rows] = top
        value[:m] = np.where(keep, v, jump) + flat[rows]
    state = value.argmax(axis=1)
    path = np.zeros(len(flat), dtype=np.int16)
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = int(np.searchsorted(-lengths, -t, side="left"))
        rows = offsets[:m] + t
        path[rows] = state[:m]
        state[:m] = np.where(stay[rows, state[:m]], state[:m], source[rows])
    for j, i in enumerate(hard):
        out[i] = path[offsets[j] : offsets[j + 1]]
    return out


class _Scorer:
    """Scores of tokens, kept for tokens seen before, up to `limit` of them."""

    def __init__(self, model: LanguageModel, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, len(self.model.langs)), dtype=np.float32)
        self.letters = np.zeros(1 << 16, dtype=np.int32)
        self.used = 1

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        index = self.index
        found = [list(map(index.get, tokens)) for tokens in texts]
        fresh = list(dict.fromkeys(t for tokens, ids in zip(texts, found, strict=True) if None in ids for t, i in zip(tokens, ids, strict=True) if i is None))
        if fresh:
            # case and outer punctuation change no score: such forms of a word share a row
            bare = [t.strip(_OUTER).lower() for t in fresh]
            new = [t for t in dict.fromkeys(bare) if t not in self.bare]
            rows, letters = self.model.words(new)
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            at = np.arange(self.used, self.used + len(new))
            self.rows[at], self.letters[at] = rows, letters
            self.bare.update(zip(new, at.tolist(), strict=True))
            index.update(zip(fresh, map(self.bare.__getitem__, bare), strict=True))
            self.used += len(new)
            found = [list(map(index.get, tokens)) if None in ids else ids for tokens, ids in zip(texts, found, strict=True)]
        return [np.array(ids, dtype=np.int64) for ids in found]


def _label_batches(model: LanguageModel, of):
    @lean
    def run(batches):
        scorer = _Scorer(model)
        for batch in batches:
            if len(scorer.index) > scorer.limit:
                scorer.reset()
            texts = of(batch).to_pylist()
            words = scorer.ids([x.split() if x else [] for x in texts])
            paths = viterbi([scorer.rows[w] for w in words], model.switch_penalty)
            pred, score, spans = [], [], []
            for w, path in zip(words, paths, strict=True):
                letters = scorer.letters[w]
                total = int(letters.sum())
                if not total or not model.langs:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    spans.append([])
                    continue
                share = np.bincount(path, weights=letters, minlength=len(model.langs))
                best = int(share.argmax())
                pred.append(model.langs[best])
                score.append(float(share[best] / total))
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
                spans.append([{"first_word": int(a), "end_word": int(b), "lang": model.langs[path[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPANS)],
                ["key", "lang_pred", "score", "spans"],
            )

    return run


_OUTER = ".,;:!?()\"'&%$*|#[]{}<>-"
SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))


def label(
    docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, names: Sequence[str] = ("lang_pred", "score", "spans")
) -> DataFrame:
    """Each row's kept columns (doc_id by default) with lang_pred, score (share of letters in spans of that language) and spans.

    names: what these three are called, where a kept column has such a name.

    spans: words (split at white space) [first_word, end_word) with one language each.
    """
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, keep or ["doc_id"], text_col)
    out = df.mapInArrow(_label_batches(model, texts), f"{key}, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>")
    return out.select("key.*", *[F.col(c).alias(name) for c, name in zip(("lang_pred", "score", "spans"), names, strict=True)])
