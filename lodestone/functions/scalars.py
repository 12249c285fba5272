"""Identifiers, escapes, rewrite guards, error classes, token budgets and scores, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text

# Names that file systems keep, kinds of claims, budgets and weights.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
CLAIM_TYPES = ("insight", "instruction", "fact", "mechanism", "opinion", "decision", "warning", "question", "summary", "example")
CLAIM_CLASSES = ("fact", "mechanism", "opinion", "warning", "instruction", "insight")
TOKENS_A_VIDEO, TOKENS_A_CHUNK, TARGET_TOKENS = 50_000, 10_000, 3_000
MIN_OVERLAP, MAX_EDIT = 0.3, 0.5
DIMENSIONS = ("completeness", "accuracy", "topic_coverage", "atomicity", "overall")


def safe_id(x: Column) -> Column:
    """1 to 100 letters, digits, underscores and hyphens."""
    return F.coalesce(x.rlike("^[a-zA-Z0-9_-]{1,100}\\z"), F.lit(False))


def checked_id(x: Column) -> Column:
    return F.when(safe_id(x), x)


def file_name(x: Column) -> Column:
    """Unsafe and control characters become underscores, runs of dots one; reserved and empty names a single underscore."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\.+", "."))
    return F.when((clean == "") | (clean == ".") | F.upper(F.substring_index(clean, ".", 1)).isin(*RESERVED), "_").otherwise(clean)


def video_id(x: Column) -> Column:
    """The parameter v of an address, the path of a short or embedding address, or the input itself."""
    given = F.try_parse_url(x, F.lit("QUERY"), F.lit("v"))
    host, path = text.host(x), F.try_parse_url(x, F.lit("PATH"))
    address = x.contains("/") | x.contains(".")
    return F.when(~address, x).when(given.isNotNull(), given).when(host == "youtu.be", F.substring(path, 2, 1 << 20)).when(path.startswith("/embed/"), F.substring(path, 8, 1 << 20)).otherwise(x)


def playlist_id(x: Column) -> Column:
    return F.coalesce(F.try_parse_url(x, F.lit("QUERY"), F.lit("list")), x)


def regex_escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def triple_quotes_escaped(x: Column) -> Column:
    return F.replace(x, F.lit('"""'), F.lit("'''"))


def prompt_safe(x: Column, most: int) -> Column:
    """Without phrases that override instructions and without code fences, cut to `most` characters."""
    x = F.regexp_replace(x, r"(?i)ignore\s+(all\s+)?(instructions?|commands?|above|preceding)", "[REDACTED]")
    x = F.regexp_replace(x, r"(?i)(override|bypass|disregard)\s+(instructions?|constraints?|rules?)", "[REDACTED]")
    return F.substring(F.replace(x, F.lit("```"), F.lit("'''")), 1, most)


def csv_field(x: Column) -> Column:
    """In quotes, quotes doubled, where it holds a comma, a quote or a line feed."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def table_cell(x: Column) -> Column:
    """For a Markdown table: bars and backslashes escaped."""
    return F.regexp_replace(x, r"([\\|])", r"\\$1")


def json_block(x: Column) -> Column:
    """From the first { to the last } of the first fenced block, or of the text; null where there are none."""
    fenced = F.regexp_extract(x, r"(?is)```(?:json)?\s*(.*?)```", 1)
    inside = F.when(x.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(x)
    found = F.regexp_extract(inside, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def without_fences(x: Column) -> Column:
    """What a ```json fence holds, else what a ``` fence holds, else the text from its first [ or {; trimmed."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def inside(mark: str) -> Column:
        rest = F.regexp_extract(x, rf"(?s){mark}(.*)$", 1)
        return F.when(rest.contains("```"), F.regexp_extract(rest, r"(?s)^(.*)```", 1)).otherwise(rest)

    start = F.regexp_extract(x, r"(?s)([\[{].*)$", 1)
    return trimmed(F.when(x.contains("```json"), inside("```json")).when(x.contains("```"), inside("```")).otherwise(F.when(start != "", start).otherwise(x)))


def ascii_words(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)


def keyword_overlap(rewritten: Column, sources: Column) -> Column:
    """The share of the rewritten text's distinct words that any source has."""
    mine, theirs = F.array_distinct(ascii_words(rewritten)), ascii_words(F.array_join(sources, " "))
    return F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, theirs)) / F.size(mine))


def edit_ratio(original: Column, rewritten: Column) -> Column:
    """The share of word places at which the two differ."""
    a, b = ascii_words(original), ascii_words(rewritten)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return 1 - same / F.greatest(F.lit(1), F.size(a), F.size(b))


def loses_number(original: Column, rewritten: Column) -> Column:
    return F.size(F.array_except(numbers(original), numbers(rewritten))) > 0


def accepted_rewrite(original: Column, rewritten: Column, sources: Column) -> Column:
    """The rewritten text if it keeps all numbers, takes its words from the sources and stays near; else the original."""
    new = text.normalise(rewritten)
    fine = (new != "") & ~loses_number(original, new) & (keyword_overlap(new, F.concat(F.array(original), sources)) >= MIN_OVERLAP) & (edit_ratio(original, new) <= MAX_EDIT)
    return F.when(F.coalesce(fine, F.lit(False)), new).otherwise(original)


def _holds(x: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(x).contains(p) for p in parts])


def transient_error(x: Column) -> Column:
    """Status 429 or 5xx as the first number of three digits, or words for exhausted quota."""
    status = F.regexp_extract(F.lower(x), r"(?<![a-z0-9_])([0-9]{3})(?![a-z0-9_])", 1).try_cast("int")
    words = x.rlike(r"(?i)quota\s*exceeded|rate\s*limit|resource\s*exhausted|high\s*demand|temporarily\s*unavailable")
    return F.coalesce((status == 429) | status.between(500, 599), F.lit(False)) | F.coalesce(words, F.lit(False))


def client_timeout(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)\b(?:client\s*timeout|aborted\s+due\s+to\s+timeout|timeout\s+after)\b"), F.lit(False))


def upstream_abort(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)\b(?:upstream\s*abort|aborterror|request\s*was\s*aborted|upstream\s*timeout\s*or\s*cancellation)\b"), F.lit(False))


def model_unavailable(x: Column) -> Column:
    return F.coalesce(_holds(x, "404", "not found", "unknown model", "unsupported model", "does not exist", "invalid model"), F.lit(False))


def rate_limited(x: Column) -> Column:
    return F.coalesce(_holds(x, "429", "quota exceeded", "rate limit", "billing details", "resource exhausted", "high demand", "503"), F.lit(False))


def judge_error(x: Column) -> Column:
    return (
        F.when(_holds(x, "429", "rate limit", "quota"), "rate-limit")
        .when(_holds(x, "503", "unavailable", "high demand"), "provider-unavailable")
        .when(_holds(x, "timeout", "aborted"), "timeout")
        .when(_holds(x, "parse", "json", "schema"), "parse-or-schema")
        .when(_holds(x, "401", "api key", "authorization"), "auth")
        .otherwise("error")
    )


def fallback_kind(methods: Column) -> Column:
    """none, partial or full: how many of a claim set's methods are heuristic-fallback."""
    n = F.size(F.filter(methods, lambda m: m == "heuristic-fallback"))
    return F.when(n == 0, "none").when(n == F.size(methods), "full").otherwise("partial")


def one_of(x: Column, allowed: tuple[str, ...]) -> Column:
    """Lower case, or null where it isn't one of the allowed values."""
    return F.when(F.lower(x).isin(*allowed), F.lower(x))


def number(x: Column, fallback: float) -> Column:
    """The number a text begins with, as far as it can be read; the fallback where there is none."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(fallback))


def chunk_budget(tokens: Column, chunks: Column) -> Column:
    """struct<over_budget, max_chunks, target, most, total> for a text of so many tokens and a wished number of chunks."""
    total = F.least(tokens, F.lit(TOKENS_A_VIDEO))
    wanted = F.greatest(F.lit(1), chunks, F.ceil(total / TOKENS_A_CHUNK))
    most = F.least(F.ceil(total / wanted), F.lit(TOKENS_A_CHUNK))
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct((tokens > TOKENS_A_VIDEO).alias("over_budget"), long(wanted, "max_chunks"), long(F.least(F.lit(TARGET_TOKENS), most), "target"), long(most, "most"), long(total, "total"))


def exceeds_budget(x: Column, threshold: int = TARGET_TOKENS) -> Column:
    return text.estimated_tokens(x) > threshold


def token_count(n: Column) -> Column:
    """1.5M, 2.0K or the number itself."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def cost(tokens: Column, price_per_1k: Column | float) -> Column:
    return tokens / 1000 * price_per_1k


def consistent_score(overall: Column, *dimensions: Column) -> Column:
    """Whether the overall score lies within a half of the mean of the others."""
    return F.abs(overall - sum(dimensions[1:], dimensions[0]) / len(dimensions)) <= 0.5


def optimisation_score(ratio: Column, root_ratio: Column, child_ratio: Column, unmatched: Column, teacher: Column, structural: Column, fallback: Column, tokens: Column) -> Column:
    given = lambda c: F.coalesce(c, F.lit(0))
    penalty = F.when(fallback == "full", 5).when(fallback == "partial", 2).otherwise(0)
    return ratio * 100 + given(teacher) * 15 + (root_ratio * 2 + child_ratio) * 10 + given(structural) * 15 - unmatched - penalty - given(tokens) / 10000


def escalates(ratio: Column, root_ratio: Column, child_ratio: Column, retry_reason: Column, pack: Column) -> Column:
    listing = F.coalesce(pack.isin("enumeration-framework", "business-framework", "generic-hierarchy"), F.lit(False))
    shallow = listing & (child_ratio >= F.greatest(F.lit(0.4), root_ratio + 0.35))
    return (root_ratio == 0) | (ratio < 0.25) | F.coalesce(retry_reason == "missing-root-claim", F.lit(False)) | shallow


def escalation_pack(escalated: Column, domain: Column, pack: Column) -> Column:
    clinical = F.coalesce(pack.isin("clinical-risk-management", "clinical-risk-management-v2"), F.lit(False)) | F.coalesce(F.lower(domain).rlike("clinical|medical|cardio|lipid|health|medicine|biology"), F.lit(False))
    return F.when(escalated, F.when(clinical, "clinical-risk-management-v2").otherwise("enumeration-framework-v2"))


def judge_scores(gold: Column, matched: Column, candidates: Column, unsupported: Column, redundant: Column, severities: Column, compound: Column, missed_roots: Column) -> Column:
    """struct of 0 to 10, two decimals: gold_coverage, faithfulness, structure, atomicity, overall; from counts, and the severities of structural issues."""
    clamp = lambda x: F.round(text.clamp(x, 0.0, 10.0), 2)
    n = F.greatest(candidates, F.lit(1))
    penalty = F.aggregate(severities, F.lit(0.0), lambda s, x: s + F.when(x == "high", 2.0).when(x == "medium", 1.0).otherwise(0.5))
    coverage = clamp(matched / F.greatest(gold, F.lit(1)) * 10)
    faith = F.when(candidates == 0, 0.0).otherwise(clamp(10 - unsupported / n * 10))
    structure = clamp(10 - penalty - missed_roots * 1.5)
    atomic = F.when(candidates == 0, 0.0).otherwise(clamp(10 - redundant / n * 10 - compound * 0.5))
    overall = clamp((coverage + faith + structure + atomic) / 4)
    return F.struct(coverage.alias("gold_coverage"), faith.alias("faithfulness"), structure.alias("structure"), atomic.alias("atomicity"), overall.alias("overall"))


def file_stamp(ts: Column) -> Column:
    """To the millisecond, without separators: a part of a file name."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmssSSS")


def report_stub(x: Column) -> Column:
    """A slug for a report's files; `report` where nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9-]+", "-"), "-+", "-"), "^-|-$", "")
    return F.when(made == "", "report").otherwise(made)


def content_hash(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 32)
