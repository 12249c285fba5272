"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
CONNECTORS = (
    "and", "but", "so", "or", "yet", "nor", "for", "which", "that", "when", "where", "while", "since",
    "because", "although", "though", "unless", "is", "are", "was", "were",
)
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "rep", "sen", "gen", "col", "maj", "capt", "lt", "st", "ave",
    "blvd", "rd", "etc", "eg", "ie", "vs", "approx", "est",
)
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "must", "can", "this", "that", "these", "those", "from", "into", "onto", "over", "under", "it", "its", "their", "our",
)
UNITS = r"(?i)(?:\b(?:mg|g|kg|ml|l|hour|hours|min|minute|minutes|sec|seconds|degree|degrees)\b|%)"

_ANY_CONNECTOR = "|".join(CONNECTORS)
DANGLING = rf"(?U)(?i)(?:\.\.\.|…|[,:;]|(?:^|\s)(?:{_ANY_CONNECTOR})[.,;:!?)\]]?)\s*$"
CONNECTED = rf"""(?U)(?i)^\s*["'(\[]?(?:{_ANY_CONNECTOR})(?:\s|$)"""


def normalise(x: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def key(x: Column) -> Column:
    """Lower case without punctuation and quotes, for keep-first dedupe."""
    return normalise(F.regexp_replace(F.lower(normalise(x)), r"""[.",;:!?()\[\]{}'‘’“”]""", ""))


def tokens(x: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def shortened(x: Column, n: int = 220) -> Column:
    """Normalised, cut to n characters with an ellipsis as the last; null for null and empty text."""
    t = normalise(x)
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(None).cast("string")).when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def ngrams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), "_"))).otherwise(t)


def timestamp(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def timestamp_url(url: Column, seconds: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t="), F.floor(seconds).cast("string"))


def review_url(url: Column, seconds: Column) -> Column:
    """The address with its parameter t set (not repeated) to whole seconds; a fragment stays last."""
    stamp = F.concat(F.lit("t="), F.greatest(F.lit(0), F.floor(seconds)).cast("string"), F.lit("s"))
    bare, mark = F.substring_index(url, "#", 1), F.when(url.contains("#"), F.concat(F.lit("#"), F.regexp_extract(url, "(?s)#(.*)$", 1))).otherwise("")
    set_ = F.regexp_replace(bare, r"([?&])t=[^&]*", "$1\u0001")
    first = F.regexp_replace(F.regexp_replace(set_, "^([^\u0001]*)\u0001", "$1\u0002"), "&?\u0001", "")
    put = F.when(first.contains("\u0002"), F.replace(first, F.lit("\u0002"), stamp)).otherwise(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), stamp))
    return F.concat(put, mark)


def truncated(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_id(prefix: str, name: Column, given: Column | None = None) -> Column:
    """The given id, trimmed, if it isn't blank; else prefix-slug of the name, or a hash of the name where the slug is empty."""
    made = slug(F.trim(name))
    out = F.when(made != "", F.concat(F.lit(prefix + "-"), made)).otherwise(hash_id(prefix, name))
    return out if given is None else F.when(F.trim(F.coalesce(given, F.lit(""))) != "", F.trim(given)).otherwise(out)


def plain_number(x: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def hash_id(prefix: str, *parts: Column) -> Column:
    """prefix-32 hex digits of SHA-256 over prefix and parts, nulls as empty text."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


def _balanced(u: Column) -> Column:
    """Without closing brackets at the end that nothing opens."""
    count = lambda c: F.regexp_count(u, F.lit("\\" + c))
    tail = F.length(F.regexp_extract(u, r"(\)*)$", 1))
    return F.substring(u, F.lit(1), F.length(u) - F.least(F.greatest(count(")") - count("("), F.lit(0)), tail))


def urls(x: Column) -> Column:
    """Distinct web addresses in order, without punctuation at the end and unopened brackets."""
    found = F.regexp_extract_all(x, F.lit(r"(https?://[^\s>\]]+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: _balanced(F.regexp_replace(u, r"[.,!?]+$", ""))))


def host(url: Column) -> Column:
    """Lower-case host name; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def without_markup(x: Column) -> Column:
    """Tags go; the five XML entities are decoded, &amp; last."""
    out = F.regexp_replace(x, "<[/A-Za-z][^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def dangling(x: Column) -> Column:
    """Ends with an ellipsis, a comma, colon or semicolon, or a connector."""
    return x.rlike(DANGLING)


def starts_with_connector(x: Column) -> Column:
    return x.rlike(CONNECTED)


def complete(x: Column) -> Column:
    """Starts with no lower-case letter, ends like a sentence, with its quotes and brackets closed, and doesn't dangle."""
    t = normalise(x)
    first = F.substring(F.regexp_replace(t, r"""^["'(\[\s]+""", ""), 1, 1)
    last = F.substring(t, -1, 1)
    count = lambda c: F.regexp_count(t, F.lit("\\" + c))
    quoted = t.rlike("""^["']""") & (F.substring(t, 1, 1) != last)
    uneven = (count("(") != count(")")) | (count("[") != count("]"))
    ends = t.rlike(r"""[.!?]["'\])]?$""") & (~(quoted | uneven) | last.isin(".", "!", "?"))
    return (first != "") & (first == F.upper(first)) & ends & ~dangling(t)


def fragment_marks(x: Column) -> Column:
    """Ellipses, and one more for another dangling end."""
    return F.regexp_count(x, F.lit(r"\.{3}|…")) + (dangling(x) & ~F.trim(x).rlike(r"(?:\.\.\.|…)$")).cast("int")


def sentences(x: Column) -> Column:
    """Array of sentences: one ends with a word that ends in . ! or ? (and a closing mark) and is no abbreviation."""
    words = F.split(normalise(x), " ")
    ends = lambda w: w.rlike(r"""[.!?]["')\]}]?$""") & ~F.regexp_replace(F.lower(w), "[^a-z0-9]", "").isin(*ABBREVIATIONS)
    marked = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(ends(w), "\u0001").otherwise(" "))), "")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def estimated_tokens(x: Column) -> Column:
    """A quarter of the characters, white space normalised; 0 for null."""
    return F.coalesce(F.ceil(F.length(normalise(x)) / 4), F.lit(0)).cast("long")


def heuristic_confidence(x: Column) -> Column:
    """0.4, more for numbers, units, a complete sentence and length, less for fragments; 0.1 to 0.95."""
    bonus = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.lit(0.4) + bonus(x.rlike(r"[0-9]"), 0.15) + bonus(x.rlike(UNITS), 0.1) + bonus(complete(x), 0.1)
    return clamp(score + F.least(F.length(x) / 200, F.lit(0.15)) - fragment_marks(x) * 0.1, 0.1, 0.95)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty vector or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
