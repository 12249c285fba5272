"""Grounding of a claim in source texts: token, n-gram and key-phrase overlap in three tiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text

# Terms too general to tell meanings apart, and the tiers' thresholds and weights.
GENERIC = (
    "analysis", "approach", "assessment", "case", "category", "claim", "component", "concept", "condition", "context", "data",
    "decision", "description", "detail", "development", "difference", "discussion", "effect", "element", "evidence", "example",
    "factor", "feature", "finding", "focus", "framework", "function", "general", "goal", "group", "guideline", "idea", "impact",
    "information", "insight", "instance", "issue", "item", "knowledge", "level", "method", "model", "number", "outcome", "overview",
    "parameter", "pattern", "point", "position", "practice", "principle", "problem", "process", "program", "project", "question",
    "range", "rate", "reason", "report", "research", "result", "results", "review", "role", "scope", "section", "significant",
    "situation", "stage", "standard", "state", "step", "strategy", "structure", "study", "subject", "summary", "system", "target",
    "term", "theory", "topic", "trend", "type", "understanding", "value", "variable", "view", "way", "work", "shows",
)
LEXICAL, SEMANTIC, ENTAILED, SCALE = 0.3, 0.6, 0.48, 0.8
BIGRAMS, TRIGRAMS, PHRASES = 0.4, 0.4, 0.2
SHORT_CLAIM = 2


def words(x: Column) -> Column:
    """Lower-case words without stopwords, in order."""
    return text.tokens(x, text.STOPWORDS)


def ngram_overlap(a: Column, b: Column, n: int) -> Column:
    """Jaccard similarity of the n-grams of two word arrays; of the words where either is shorter than n; 0 if either is empty."""
    if n < 1:
        raise ValueError("n is at least 1")
    short = (F.size(a) < n) | (F.size(b) < n)
    return F.when(short, text.jaccard(a, b)).otherwise(text.jaccard(text.ngrams(a, n), text.ngrams(b, n)))


def key_phrases(x: Column) -> Column:
    """Distinct runs of capitalised words, then terms (of four letters or in capitals, neither stopword nor general), then pairs of
    neighbouring terms; lower case, in order of appearance."""
    names = F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?![A-Za-z0-9_])"), 1)
    raw = F.regexp_extract_all(x, F.lit(r"([\p{L}0-9]+(?:-[\p{L}0-9]+)*)"), 1)

    def term(w: Column) -> Column:
        low = F.lower(w)
        able = (w.rlike("^[A-Z]{2,}[A-Z0-9-]*$") | (F.length(low) >= 4)) & ~low.isin(*text.STOPWORDS, *GENERIC)
        return F.struct(low.alias("w"), able.alias("able"))

    def pairs(t: Column) -> Column:
        two = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.struct((a.able & b.able).alias("able"), F.concat(a.w, F.lit(" "), b.w).alias("w")))
        return F.when(F.size(t) > 1, F.transform(F.filter(two, lambda p: p.able), lambda p: p.w)).otherwise(F.array().cast("array<string>"))

    # the terms ride in a one-element array, so they are worked out once
    both = F.flatten(F.transform(F.array(F.transform(raw, term)), lambda t: F.concat(F.transform(F.filter(t, lambda p: p.able), lambda p: p.w), pairs(t))))
    return F.array_distinct(F.concat(F.transform(names, lambda p: F.lower(p)), both))


def lexical(claim: Column, source: Column) -> Column:
    return text.jaccard(words(claim), words(source))


def features(x: Column) -> Column:
    """struct<words, two, three, phrases, low, few> of a text: what is compared of it, worked out once."""

    def of(w: Column) -> Column:
        low = F.lower(F.trim(x))
        few = F.size(F.filter(F.split(low, r"\s+"), lambda t: t != "")) <= SHORT_CLAIM
        return F.struct(w.alias("words"), text.ngrams(w, 2).alias("two"), text.ngrams(w, 3).alias("three"), key_phrases(x).alias("phrases"), low.alias("low"), few.alias("few"))

    return F.element_at(F.transform(F.array(words(x)), of), 1)


def semantic_of(claim: Column, source: Column) -> Column:
    """`semantic` of two texts' features."""

    def overlap(n: int, name: str) -> Column:
        short = (F.size(claim["words"]) < n) | (F.size(source["words"]) < n)
        return F.when(short, text.jaccard(claim["words"], source["words"])).otherwise(text.jaccard(claim[name], source[name]))

    score = overlap(2, "two") * BIGRAMS + overlap(3, "three") * TRIGRAMS + text.jaccard(claim["phrases"], source["phrases"]) * PHRASES
    return F.when(claim["few"] & (claim["low"] == source["low"]), 1.0).otherwise(score)


def semantic(claim: Column, source: Column) -> Column:
    """Weighted overlap of bigrams, trigrams and key phrases; 1 for a claim of one or two words that the source repeats exactly."""
    return F.element_at(F.transform(F.array(F.struct(features(claim).alias("a"), features(source).alias("b"))), lambda p: semantic_of(p["a"], p["b"])), 1)


def verified(claim: Column, sources: Column) -> Column:
    """struct<verified, confidence, tier>: the best source decides each tier; the first tier that fails ends it.

    A blank claim or an empty array of sources is unverified at the lexical tier with confidence 0.
    """
    best = lambda score: F.coalesce(F.array_max(F.transform(sources, lambda s: score(claim, s))), F.lit(0.0))
    known = F.trim(claim) != ""

    def told(ok: Column, confidence: Column, tier: str) -> Column:
        return F.struct(ok.alias("verified"), confidence.cast("double").alias("confidence"), F.lit(tier).alias("tier"))

    lex, sem = F.when(known, best(lexical)).otherwise(0.0), F.when(known, best(semantic)).otherwise(0.0)
    entailed = F.least(F.lit(1.0), sem * SCALE)
    return F.when(lex < LEXICAL, told(F.lit(False), lex, "lexical")).when(sem < SEMANTIC, told(F.lit(False), sem, "semantic")).otherwise(told(entailed >= ENTAILED, entailed, "entailment"))
