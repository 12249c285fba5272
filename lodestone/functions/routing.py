"""Which prompt pack suits a transcript, whether a result calls for another, and which structure it should show, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text

# Cue lists, patterns, thresholds and weights that decide results.
LIST_CUES = ("five", "four", "types", "steps", "layouts", "categories", "pillars", "guides")
DOMAIN_CUES = ("principles", "framework")
CLINICAL_CUES = (
    "mg/dl", "nmol/l", "ldl", "apob", "lipoprotein", "cholesterol", "risk factor", "therapy", "atherosclerotic", "cardiovascular", "aspirin",
    "niacin", "sirna", "screening", "genetic",
)
BUSINESS_CUES = (
    "slide", "slides", "deck", "presentation", "consulting", "mckinsey", "bain", "bcg", "framework slide", "chart slide", "subtitle slide",
    "appendix", "client",
)
ENUMERATION = r"\b(?:one|two|three|four|five|[0-9]+)\s+(?:principles?|types?|steps?|layouts?|categories|pillars?)\b"
ROOT = (
    "there are|there is|consists of|includes|account for|guide management|management follows|uses .* core|standardized set|core slide layouts|"
    "strong independent risk factor"
)
BUSINESS_DOMAIN = "consult|business|finance|strategy|presentation|deck|slide"
CLINICAL_DOMAIN = "clinical|medical|cardio|lipid|health|medicine|biology"
SIGNALS, METADATA_CONFIDENCE, LEAST_RECALL = 8, 0.85, 0.35
FINITE_SET = (
    r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\b(?:\s+[A-Za-z0-9_]+){0,3}\s+"
    r"\b(layouts?|principles?|steps?|types?|categories?|frameworks?|slides?|rules?|reasons?|options?|parts?|ways)\b"
)
AVOID = r"(?i)\b(avoid|don't use|do not use|never use|should not use|shouldn't use)\b"
CUES = {
    "definition-first": r"(?i)\b(is a|is an|refers to|defined as|consists of|composed of)\b",
    "framework": r"(?i)\b(framework|frameworks|model|models|matrix|taxonomy|taxonomies|category|categories|principle|principles|pillar|pillars|dimension|dimensions)\b",
    "process": r"(?i)\b(first|second|third|fourth|fifth|next|then|finally|step|steps|process|workflow|sequence)\b",
    "contrast": r"(?i)\b(versus|vs\.?|compared to|rather than|instead of|trade-off|tradeoff|on the other hand|whereas|while)\b",
    "recommendation": r"(?i)\b(should|must|need to|recommended|recommend|best used for|avoid|do not use|don't use)\b",
}


def _held(x: Column, cues: tuple[str, ...]) -> Column:
    """Those of the cues that stand in a lower-case text as whole words, in their order."""
    whole = lambda c: x.rlike(rf"(?<![a-z0-9_]){c}(?![a-z0-9_])")
    return F.array_compact(F.array(*[F.when(whole(c), F.lit(c)) for c in cues]))


def profile(x: Column) -> Column:
    """struct<lists, clinical, business, terms, signals> of a transcript: how many cues of each kind it holds, and which."""
    low = F.lower(x)
    lists, domain, clinical, business = (_held(low, c) for c in (LIST_CUES, DOMAIN_CUES, CLINICAL_CUES, BUSINESS_CUES))
    counted = low.rlike(ENUMERATION)
    named = lambda kind, cues: F.transform(cues, lambda c: F.concat(F.lit(kind + ":"), c))
    pattern = F.when(counted, F.array(F.lit("list:enumeration-pattern"))).otherwise(F.array().cast("array<string>"))
    signals = F.concat(named("list", lists), named("domain", domain), pattern, named("clinical", clinical), named("business", business))
    return F.struct(
        (F.size(lists) + counted.cast("int")).alias("lists"), F.size(clinical).alias("clinical"), F.size(business).alias("business"),
        F.array_distinct(F.concat(domain, clinical, business)).alias("terms"), signals.alias("signals"),
    )


def routed(domain: Column, found: Column) -> Column:
    """struct<pack, source, confidence, signals>: by the topic's domain, unless the transcript's cues speak as clearly for another pack."""
    few = F.slice(found["signals"], 1, SIGNALS)
    own = F.when(found["business"] >= 2, "business-framework").when(found["clinical"] >= 2, "clinical-risk-management").when(found["lists"] >= 2, "enumeration-framework").otherwise("generic-hierarchy")
    rate = F.when(found["business"] >= 2, found["business"] * 0.15).when(found["clinical"] >= 2, found["clinical"] * 0.12).otherwise(found["lists"] * 0.15)
    sure = F.when(own == "generic-hierarchy", 0.4).otherwise(F.least(F.lit(1.0), rate + 0.35))
    low = F.lower(F.coalesce(domain, F.lit("")))
    given = F.when(low.rlike(BUSINESS_DOMAIN), "business-framework").when(low.rlike(CLINICAL_DOMAIN), "clinical-risk-management")
    as_ = lambda pack, source, confidence: F.struct(pack.alias("pack"), source.alias("source"), confidence.cast("double").alias("confidence"), few.alias("signals"))
    heard = F.when(own == "generic-hierarchy", "fallback-default").otherwise("transcript-profile")
    return F.when(given.isNull() | ((own != given) & (sure >= METADATA_CONFIDENCE)), as_(own, F.when(given.isNull(), heard).otherwise("transcript-profile"), sure)).otherwise(as_(given, F.lit("metadata"), F.lit(METADATA_CONFIDENCE)))


def _root(c: Column) -> Column:
    return F.lower(c).rlike(ROOT) | F.lower(c).rlike(ENUMERATION)


def _recall(claims: Column, terms: Column) -> Column:
    """The share of the terms that the claims hold; 1 without terms, 0 without claims."""
    said = F.lower(F.array_join(claims, " "))
    return F.when(F.size(terms) == 0, 1.0).when(F.size(claims) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(said, t))) / F.size(terms))


def retried(claims: Column, pack: Column, found: Column) -> Column:
    """struct<retry, reason, pack>: whether the claims that a pack gave call for another, and which."""
    reasons = lambda why, to: F.struct(F.lit(True).alias("retry"), F.lit(why).alias("reason"), F.lit(to).alias("pack"))
    none = F.struct(F.lit(False).alias("retry"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("pack"))
    many = {k: found[k] >= 2 for k in ("lists", "clinical", "business")}
    empty = F.size(claims) == 0
    target = F.when(many["clinical"], "clinical-risk-management-v2").when(many["business"], "business-framework").when(many["lists"], "enumeration-framework-v2")
    low = _recall(claims, found["terms"]) < LEAST_RECALL
    out = (
        F.when(empty & (target == pack), none)
        .when(empty & target.isNotNull(), F.struct(F.lit(True).alias("retry"), F.lit("too-few-claims").alias("reason"), target.alias("pack")))
        .when(~F.exists(claims, _root) & many["lists"] & (pack != "enumeration-framework-v2"), reasons("missing-root-claim", "enumeration-framework-v2"))
        .when(~F.exists(claims, lambda c: F.lower(c).rlike(ENUMERATION)) & many["lists"] & (pack == "business-framework"), reasons("missing-enumeration-framework", "enumeration-framework"))
        .when(low & many["clinical"] & (pack != "clinical-risk-management-v2"), reasons("low-domain-term-recall", "clinical-risk-management-v2"))
        .when(low & many["business"] & (pack != "business-framework"), reasons("low-domain-term-recall", "business-framework"))
    )
    return F.coalesce(out, none)


def completeness(claims: Column, found: Column) -> Column:
    """0 to 1: a root claim, an enumeration, the recall of domain terms, and eight claims or more."""
    one = lambda rule: F.when(F.exists(claims, rule), 1.0).otherwise(0.0)
    return one(_root) * 0.35 + one(lambda c: F.lower(c).rlike(ENUMERATION)) * 0.2 + _recall(claims, found["terms"]) * 0.25 + F.least(F.lit(1.0), F.size(claims) / 8) * 0.2


def structure(x: Column) -> Column:
    """struct<tags, cues, numbers, nouns, avoids> of a transcript: which kinds of structure its words promise."""
    low = lambda a: F.transform(a, lambda c: F.lower(c))
    group = lambda n: F.array_distinct(low(F.regexp_extract_all(x, F.lit(FINITE_SET), F.lit(n))))
    kinds = {name: F.slice(low(F.regexp_extract_all(x, F.lit(rule), F.lit(0))), 1, 3) for name, rule in CUES.items()}
    tags = F.array_compact(F.array(F.when(F.size(group(1)) > 0, F.lit("finite-set")), *[F.when(F.size(found) > 0, F.lit(name)) for name, found in kinds.items()]))
    cues = F.slice(F.array_distinct(F.concat(group(0), *kinds.values())), 1, SIGNALS)
    return F.struct(tags.alias("tags"), cues.alias("cues"), group(1).alias("numbers"), group(2).alias("nouns"), x.rlike(AVOID).alias("avoids"))


def _lists(c: Column) -> Column:
    commas, joins = F.regexp_count(c, F.lit(",")), F.regexp_count(c, F.lit(r"(?i)\b(?:and|or)\b"))
    return (commas >= 2) | ((commas >= 1) & (joins >= 1)) | c.rlike(r":\s*[^.]+,\s*[^.]+")


def assessed(claims: Column, wanted: Column) -> Column:
    """struct<score, root, members, avoid, gate>: whether the claims name the number and kind of the members, list them, and say
    what to avoid where the transcript does. All false without claims and where the transcript has no such set."""
    holds = lambda c, terms: F.exists(terms, lambda t: F.contains(text.key(c), text.key(t)))
    root = F.exists(claims, lambda c: holds(c, wanted["numbers"]) & holds(c, wanted["nouns"]))
    members, avoid = F.exists(claims, _lists), F.exists(claims, lambda c: c.rlike(AVOID))
    strict = wanted["avoids"]
    weigh = lambda flag, with_, without: F.when(flag, F.when(strict, with_).otherwise(without)).otherwise(0.0)
    known = (F.size(wanted["numbers"]) > 0) & (F.size(claims) > 0)
    flag = lambda c: F.coalesce(known & c, F.lit(False))
    score = reduce(lambda a, b: a + b, [weigh(flag(root), 0.45, 0.55), weigh(flag(members), 0.35, 0.45), weigh(flag(avoid), 0.2, 0.0)])
    return F.struct(F.round(score, 4).alias("score"), flag(root).alias("root"), flag(members).alias("members"), flag(avoid).alias("avoid"), flag(root).alias("gate"))
