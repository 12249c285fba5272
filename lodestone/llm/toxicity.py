"""Toxicity by a weighted finite-state pattern grammar over clauses.

Each word gets a symbol: insult, harm verb, address, object pronoun, possessive, kin, article, modal, negation, report or
other. Insults are learned: words and word stems that are many times as frequent in documents labelled toxic as in
the others, weighted by their log odds; the other symbols are fixed lists. Five transducers are composed, each reading
what the one before writes, and arc weights multiply along the composition:

- negation: an insult or harm verb within SCOPE words after a negation is marked and weakened;
- reported speech: behind a verb of saying, to the end of the clause, it is marked and weakened;
- target: an insult in a clause that addresses somebody, before or behind it, is marked and strengthened
  (the transducer is run in both directions);
- insult: gives a word's own weight out, times the weights of its arcs;
- threat: gives weight out where a harm verb has a person as its object: an address or object pronoun next or next but one
  behind it, a possessive and kin right behind it, or an object pronoun before it with a modal; more with a modal up to four
  words before. An article between verb and address gives the verb another object, so "kill the process" is no threat.

The state of the composition is the tuple of their states, and each composed step is kept once worked out. Only
clauses with an insult or a harm verb are read. The weights given out in a document make a few features, and a
logistic model fitted on the labelled sample, with a ridge towards PRIOR, turns them into a score. Documents without
a match share one low score.

Defined results: null and empty texts match nothing and get that low score. Where no labels of both kinds
can be learned from, there are no insults and threats are scored by PRIOR. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, lean, sampled, with_text

OTHER, INSULT, HARM, ADDRESS, OBJECT, POSSESSIVE, KIN, ARTICLE, MODAL, NEGATION, REPORT = range(11)
NEGATED, REPORTED, TARGETED = 1, 2, 4
#: Fixed word lists: English, German, French, Spanish.
WORDS = {
    HARM: "kill murder strangle hurt stab shoot destroy töten töte umbringen erwürgen erschießen tuer tue assassiner étrangler matar mataré asesinar estrangular",
    ADDRESS: "you yourself du ihr tu toi vous usted ustedes vosotros",
    OBJECT: "dich dir euch te vous os",
    POSSESSIVE: "your yours dein deine deinen deiner euer eure ton ta tes votre vos tu vuestra",
    KIN: "family children kids mother father wife husband familie kinder mutter vater famille enfants mère père familia hijos madre padre",
    ARTICLE: "the a an this that these those it him her them der die das den ein eine einen le la les un une el los las",
    MODAL: "will shall should must gonna going want i'll we'll they'll werde werden will muss sollte vais vas va allons veux voy vas va vamos quiero",
    NEGATION: "not never no isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais ni nunca",
    REPORT: "said says called calls wrote claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
STEMS = (6, 5, 4)
SCOPE = 3
#: Weights of arcs and threats.
WEAKER = {NEGATED: 0.2, REPORTED: 0.4}
STRONGER = 1.5
THREAT, MODAL_THREAT = 4.0, 6.0
MODAL_REACH, OBJECT_REACH = 4, 2
#: Features: sums of weights of plain, targeted, negated and reported insults and of threats; the best clause; how many match.
FEATURES = 7
PRIOR = np.array([0.5, 0.8, 0.0, 0.1, 2.5, 0.5, 0.0])
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Arc:
    """What a transducer writes for a symbol: the symbol, marks, the weight of its arcs so far and weight given out."""

    kind: int
    marks: int = 0
    weight: float = 1.0
    threat: float = 0.0
    threat_marks: int = 0

    def marked(self, mark: int, weight: float) -> Arc:
        return Arc(self.kind, self.marks | mark, self.weight * weight, self.threat, self.threat_marks)


@dataclass
class Transducer:
    """step(state, arc) -> (next state, arc)."""

    start: object
    step: object


def _negation(state: int, arc: Arc) -> tuple[int, Arc]:
    if arc.kind == NEGATION:
        return SCOPE, arc
    return max(0, state - 1), arc.marked(NEGATED, WEAKER[NEGATED]) if state and arc.kind in (INSULT, HARM) else arc


def _report(state: int, arc: Arc) -> tuple[int, Arc]:
    if arc.kind == REPORT:
        return 1, arc
    return state, arc.marked(REPORTED, WEAKER[REPORTED]) if state and arc.kind in (INSULT, HARM) else arc


def _target(state: int, arc: Arc) -> tuple[int, Arc]:
    if arc.kind in (ADDRESS, OBJECT, POSSESSIVE):
        return 1, arc
    return state, arc.marked(TARGETED, STRONGER) if state and arc.kind == INSULT else arc


def _insult(state: int, arc: Arc) -> tuple[int, Arc]:
    """Gives the weight of an insult's arcs out; other symbols pass, with a weight for the threat transducer only if they are harm verbs."""
    return state, arc if arc.kind in (INSULT, HARM) else Arc(arc.kind, arc.marks, 0.0)


def _threat(state: tuple, arc: Arc) -> tuple[tuple, Arc]:
    """state: words a modal and an object pronoun still reach, then of the last harm verb: words it still reaches,
    whether a modal came before it, its weight and marks, and whether a possessive follows it."""
    modal, pronoun, reach, with_modal, weight, marks, owned = state
    kind, given = arc.kind, None
    base = MODAL_THREAT if with_modal else THREAT
    if kind == HARM:
        if pronoun and modal:
            given, reach = (MODAL_THREAT * arc.weight, arc.marks), 0
        else:
            reach, with_modal, weight, marks, owned = 3, modal > 0, arc.weight, arc.marks, False
    elif reach and owned:
        if kind == KIN:
            given = (base * weight, marks)
        reach = 0
    elif reach and kind in (ADDRESS, OBJECT):
        given, reach = (base * weight, marks), 0
    elif reach and kind == POSSESSIVE:
        owned = True
    elif kind == ARTICLE:
        reach = 0
    modal = MODAL_REACH + 1 if kind == MODAL else modal
    pronoun = OBJECT_REACH + 1 if kind == OBJECT else pronoun
    reach = max(0, reach - 1)
    after = (max(0, modal - 1), max(0, pronoun - 1), reach, *((with_modal, weight, marks, owned) if reach else (False, 1.0, 0, False)))
    return after, Arc(kind, arc.marks, arc.weight, given[0], given[1]) if given else arc


class Composition:
    """Transducers in a row, each reading what the one before writes."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start, self.known = parts, tuple(p.start for p in parts), {}

    def run(self, kinds: list[int]) -> list[Arc]:
        state, out, known = self.start, [], self.known
        for kind in kinds:
            at = known.get((state, kind))
            if at is None:
                arc, after = Arc(kind), []
                for part, s in zip(self.parts, state, strict=True):
                    s, arc = part.step(s, arc)
                    after.append(s)
                at = known[state, kind] = (tuple(after), arc)
            state, arc = at
            out.append(arc)
        return out


def grammar() -> tuple[Composition, Composition]:
    """Forward: negation, reported speech, target, insult and threat; backward: target alone."""
    forward = Composition(Transducer(0, _negation), Transducer(0, _report), Transducer(0, _target), Transducer(0, _insult), Transducer((0, 0, 0, False, 1.0, 0, False), _threat))
    return forward, Composition(Transducer(0, _target))


def read_clause(forward: Composition, backward: Composition, kinds: list[int], weights: list[float]) -> list[tuple[int, float]]:
    """(feature, weight) of each insult and threat in a clause, given its symbols and the words' own weights."""
    out = []
    for own, ahead, back in zip(weights, forward.run(kinds), backward.run(kinds[::-1])[::-1], strict=True):
        if ahead.kind == INSULT:
            late = back.marks & TARGETED and not ahead.marks & TARGETED
            marks = ahead.marks | back.marks
            feature = 2 if marks & NEGATED else 3 if marks & REPORTED else 1 if marks & TARGETED else 0
            out.append((feature, own * ahead.weight * (STRONGER if late else 1.0)))
        if ahead.threat:
            out.append((2 if ahead.threat_marks & NEGATED else 3 if ahead.threat_marks & REPORTED else 4, ahead.threat))
    return out


@dataclass
class ToxicModel:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    bias: float = -3.0

    def classify(self, token: str) -> tuple[int, float]:
        """Symbol and weight of a lower-case token: that of the first of its words that has one."""
        for word in _WORD.findall(token):
            fixed = _FIXED.get(word)
            if fixed is not None:
                return fixed, 0.0
            weight = self.words.get(word)
            if weight is None:
                for n in STEMS:
                    if len(word) >= n and (weight := self.stems.get(word[:n])) is not None:
                        break
            if weight is not None:
                return INSULT, weight
        return OTHER, 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


#: A word in two lists has the symbol of the first of them.
_FIXED = {w: k for k in reversed(WORDS) for w in WORDS[k].split()}
_ENDS = frozenset(".!?;:,")


class Reader:
    """Features of texts; the symbols of tokens met before are kept, up to a limit."""

    def __init__(self, model: ToxicModel, limit: int = 400_000):
        self.model, self.limit, self.known = model, limit, {}
        self.forward, self.backward = grammar()

    def features(self, text: str | None) -> list[float]:
        """Logs of 1 + each feature."""
        if not text:
            return [0.0] * FEATURES
        tokens = text.lower().replace("\u2019", "'").split()
        known = self.known
        found = list(map(known.get, tokens))
        if None in found:
            if len(known) > self.limit:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    token = tokens[i]
                    kind, weight = self.model.classify(token)
                    # 0 for the many words of no class that end no clause
                    found[i] = known[token] = (kind, weight) if kind in (INSULT, HARM) else kind
        hits = [i for i, x in enumerate(found) if x.__class__ is tuple]
        if not hits:
            return [0.0] * FEATURES
        sums, best, n, done = [0.0] * 5, 0.0, 0, -1
        for hit in hits:
            if hit < done:
                continue
            lo, hi = hit, hit
            while lo > 0 and tokens[lo - 1][-1] not in _ENDS:
                lo -= 1
            while hi < len(tokens) - 1 and tokens[hi][-1] not in _ENDS:
                hi += 1
            done = hi + 1
            clause = found[lo:done]
            kinds = [x[0] if x.__class__ is tuple else x for x in clause]
            weights = [x[1] if x.__class__ is tuple else 0.0 for x in clause]
            total = 0.0
            for feature, weight in read_clause(self.forward, self.backward, kinds, weights):
                n += 1
                sums[feature] += weight
                total += weight
            best = max(best, total)
        return [*map(math.log1p, sums), math.log1p(best), math.log1p(n)]


@lean
def _count_partition(batches):
    seen = [Counter(), Counter()]
    docs = [0, 0]
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            seen[label].update("w" + w for w in words if len(w) >= 3)
            seen[label].update({"s" + w[:n] for w in words for n in STEMS if len(w) > n})
            docs[label] += 1
    seen[0][""], seen[1][""] = docs
    keys = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][k] for k in part], pa.int64()), pa.array([seen[1][k] for k in part], pa.int64())], ["key", "clean", "toxic"])


def _feature_batches(model: ToxicModel, of):
    @lean
    def run(batches):
        reader = Reader(model)
        for batch in batches:
            rows = np.array([reader.features(x) for x in of(batch).to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64())), pa.array(model.score(rows), pa.float64())], ["key", "features", "score"])

    return run


def _read(docs: DataFrame, model: ToxicModel, keep: list[str], text_col: str) -> DataFrame:
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, keep, text_col)
    return df.mapInArrow(_feature_batches(model, texts), f"{key}, features array<double>, score double").select("key.*", "features", "score")


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    label_col: str = "toxic",
    sample_rows: int = 8000,
    max_entries: int = 4096,
    least_docs: int = 5,
    least_weight: float = 3.0,
) -> ToxicModel:
    """Fit on about sample_rows labelled documents (a document with several labels counts as toxic if one says so).

    Of the words and stems that least_docs toxic documents of the sample hold, the max_entries with the strongest
    evidence (log odds times the root of the count) are considered, and those of least_weight log odds are insults.
    """
    arrow_rows(docs.sparkSession)
    labelled = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), label_col)
    # about sample_rows rows, so it may be broadcast
    sample = sampled(labelled, "_id", sample_rows).groupBy("_id").agg(F.max(label_col).cast("int").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(sample), "_id")
    counts = rows.select("_label", "text").mapInArrow(_count_partition, "key string, clean long, toxic long")
    counts = counts.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    evidence = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) * F.sqrt("toxic")
    both = counts.where(f"key = '' or toxic >= {least_docs}").orderBy(F.when(F.col("key") == "", 0).otherwise(1), F.desc(evidence), "key")
    kept = both.limit(max_entries + 1).collect()
    model = ToxicModel({}, {})
    totals = next((r for r in kept if r["key"] == ""), None)
    if totals is None or not totals["clean"] or not totals["toxic"]:
        return model
    for r in kept:
        weight = math.log((r["toxic"] + 0.5) / (totals["toxic"] + 1)) - math.log((r["clean"] + 0.5) / (totals["clean"] + 1))
        if r["key"] and weight >= least_weight:
            (model.words if r["key"][0] == "w" else model.stems)[r["key"][1:]] = weight
    data = _read(rows, model, ["_label"], "text").select("_label", "features").collect()
    x, y = np.array([r["features"] for r in data]), np.array([r["_label"] for r in data], dtype=float)
    model.weights, model.bias = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge towards PRIOR, so that a feature the sample lacks keeps its prior weight."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, 0.0)
    w = prior.copy()
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ (w - prior))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (doc_id by default), features of the matched clauses and score."""
    return _read(docs, model, keep or ["doc_id"], text_col)
