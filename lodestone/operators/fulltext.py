"""Full-text search of node texts: an inverted index of stemmed words; a query's words must all occur."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text

TYPES = ("Claim", "Excerpt", "Resource")

# The suffix tables of the Porter stemmer's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(s: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in s:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _short_end(s: str) -> bool:
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _longest(w: str, suffixes) -> str:
    return max((x for x in suffixes if w.endswith(x)), key=len, default="")


def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of one or two letters, and any not in a-z, stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        base = w[: -len(e)] if (e := _longest(w, ("ed", "ing"))) else ""
        if "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = _longest(w, rules)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + rules[end]
    end = _longest(w, STEP_4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def index(nodes: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(term, id, type), one row a node and term of its label and content. Each distinct word is stemmed once."""
    both = F.concat_ws(" ", "label", "content")
    words = nodes.where(F.col("type").isin(*types)).select("id", "type", F.explode(F.array_distinct(text.tokens(both))).alias("word"))
    stems = words.select("word").distinct().withColumn("term", F.pandas_udf(lambda s: s.map(stem), "string")("word"))
    return words.join(stems, "word").select("term", "id", "type").distinct()


class QueryError(ValueError):
    """Raised for a query that full text cannot answer; a caller may fall back to substrings."""


def parsed(query: str) -> list[tuple[list[str], list[str]]]:
    """Alternatives of (terms that must occur, terms that must not); a term that ends in * is a prefix.

    Words are joined by AND, which may be written; NOT binds to the next word, OR least. Quotes are ignored. An operator without
    a word on a side where it needs one, and NEAR, are refused.
    """
    words = query.replace('"', " ").replace("'", " ").split()
    groups: list[tuple[list[str], list[str]]] = [([], [])]
    negate = joined = False
    for word in words:
        if word in ("OR", "AND", "NOT"):
            if negate or joined or not groups[-1][0]:
                raise QueryError(f"{word} has nothing on its left")
            if word == "OR":
                groups.append(([], []))
            negate, joined = word == "NOT", word != "NOT"
            continue
        if word.startswith("NEAR"):
            raise QueryError("NEAR is not supported")
        terms = [stem(w) for w in re.split(r"[\W_]+", word.lower()) if w]
        if terms and word.endswith("*"):
            terms[-1] += "*"
        groups[-1][1 if negate else 0].extend(terms)
        negate = joined = False
    if negate or joined:
        raise QueryError("an operator has nothing on its right")
    return [(sorted(set(a)), sorted(set(b))) for a, b in groups if a]


def search(postings: DataFrame, query: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(id, type) of the nodes that match the query; a blank query finds nothing."""
    groups = parsed(query)
    if not groups:
        return postings.select("id", "type").where(F.lit(False))
    terms = sorted({t for a, b in groups for t in (*a, *b)})
    holds = lambda t: F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t
    hits = postings.where(F.col("type").isin(*types)).where(reduce(lambda a, b: a | b, map(holds, terms)))
    found = hits.groupBy("id", "type").agg(*[F.bool_or(holds(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    at = {t: F.col(f"t{i}") for i, t in enumerate(terms)}
    one = lambda a, b: reduce(lambda x, y: x & y, [*[at[t] for t in a], *[~at[t] for t in b]])
    return found.where(reduce(lambda x, y: x | y, [one(a, b) for a, b in groups])).select("id", "type")
