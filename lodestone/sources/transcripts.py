r"""Timed text files as segments, in four formats, without Python workers.

Each parser maps a text column to array<struct<start, duration, text, speaker>>; null and malformed payloads give an
empty array, and cues without text are left out. `segments` explodes a table of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text

SEGMENTS = "array<struct<start: double, duration: double, text: string, speaker: string>>"
_TAG = "<[/A-Za-z][^>]*>"
_JSON = "events array<struct<tStartMs: double, dDurationMs: double, segs: array<struct<utf8: string>>>>"


def decoded(x: Column) -> Column:
    """The five XML entities, &amp; last so that nothing is decoded twice."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def _plain(x: Column) -> Column:
    return F.regexp_replace(text.normalise(x), _TAG, "")


def _segment(start: Column, duration: Column, body: Column, speaker: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(start.cast("double").alias("start"), duration.cast("double").alias("duration"), body.alias("text"), (none if speaker is None else speaker).alias("speaker"))


def _whole(found: Column) -> Column:
    """Segments with a start and with text; never null."""
    return F.coalesce(F.filter(found, lambda s: s["start"].isNotNull() & s["text"].rlike(r"(?U)\S")), F.array().cast(SEGMENTS))


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used: it rides in a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _clock(x: Column, least_parts: int) -> Column:
    """[[h:]m:]s[.fraction] in seconds, or null; a short fraction is filled up to milliseconds."""

    def seconds(last: Column) -> Column:
        fraction = F.coalesce(F.try_element_at(last, F.lit(2)), F.lit("0"))
        millis = F.when(F.length(fraction) < 3, F.rpad(fraction, 3, "0")).otherwise(fraction).try_cast("double")
        return last[0].try_cast("double") + millis / 1000

    def whole(parts: Column) -> Column:
        n = F.size(parts)
        part = lambda back: F.when(n >= back, F.try_element_at(parts, F.lit(-back))).otherwise("0").try_cast("double")
        known = (n >= least_parts) & ((n > 1) | (F.try_element_at(parts, F.lit(1)) != ""))
        return F.when(known, part(3) * 3600 + part(2) * 60 + _once(F.split(F.try_element_at(parts, F.lit(-1)), r"\."), seconds))

    return _once(F.split(F.trim(x), ":"), whole)


def vtt_time(x: Column) -> Column:
    return _clock(x, 2)


def timecode(x: Column) -> Column:
    """A clock time, or seconds as 12.5s."""
    return F.when(F.rtrim(x).endswith("s"), F.regexp_replace(F.trim(x), "s$", "").try_cast("double")).otherwise(_clock(x, 1))


def from_xml(payload: Column) -> Column:
    """<text start dur>."""
    rule = r'<text start="([^"]+)" dur="([^"]+)"[^>]*>([\s\S]*?)</text>'
    part = lambda m, i: F.regexp_extract(m, rule, i)
    number = lambda v: F.regexp_extract(v, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    one = lambda m: _segment(number(part(m, 1)), number(part(m, 2)), _plain(F.regexp_replace(decoded(part(m, 3)), _TAG, "")))
    return _whole(F.transform(F.regexp_extract_all(payload, F.lit(rule), F.lit(0)), one))


def from_json(payload: Column) -> Column:
    """Events with their parts joined; times in milliseconds, a missing one is 0; a leading guard is taken off."""
    bare = F.regexp_replace(F.trim(payload), r"^\)\]\}'\s*", "")
    events = F.filter(F.from_json(bare, _JSON)["events"], lambda e: e["segs"].isNotNull())
    seconds = lambda v: F.coalesce(v, F.lit(0.0)) / 1000
    body = lambda e: F.array_join(F.transform(e["segs"], lambda p: F.coalesce(p["utf8"], F.lit(""))), "")
    return _whole(F.transform(events, lambda e: _segment(seconds(e["tStartMs"]), seconds(e["dDurationMs"]), _plain(body(e)))))


def from_vtt(payload: Column) -> Column:
    """Cues: a line with an arrow and the lines after it up to a blank one; a voice tag names the speaker."""
    lines = F.regexp_replace(payload, "\r\n", "\n")
    cues = F.regexp_extract_all(lines, F.lit(r"(?m)^(?!\s*(?:WEBVTT|Kind:|Language:))[^\n]*-->[^\n]*(?:\n(?=[^\n]*\S)[^\n]+)*+"), F.lit(0))

    voice = r"^<v\s+([^>]+)>([\s\S]*?)(?:</v>)?$"

    def lines_of(cue: Column) -> Column:
        return F.struct(F.split(F.substring_index(cue, "\n", 1), "-->").alias("head"), text.normalise(F.regexp_replace(cue, r"^[^\n]*\n?", "")).alias("body"))

    def parts(c: Column) -> Column:
        end = vtt_time(F.substring_index(F.trim(c["head"][1]), " ", 1))
        said = _plain(F.regexp_replace(F.regexp_extract(c["body"], voice, 2), _TAG, ""))
        return F.struct(vtt_time(c["head"][0]).alias("start"), end.alias("end"), c["body"].alias("body"), text.normalise(F.regexp_extract(c["body"], voice, 1)).alias("who"), said.alias("said"))

    def one(c: Column) -> Column:
        spoken = (c["who"] != "") & (c["said"] != "")
        return _segment(c["start"], F.when(c["end"] >= c["start"], c["end"] - c["start"]).otherwise(0.0), F.when(spoken, c["said"]).otherwise(_plain(c["body"])), F.when(spoken, c["who"]))

    return _whole(F.transform(F.transform(F.transform(cues, lines_of), parts), one))


def from_ttml(payload: Column) -> Column:
    """<p begin end dur>; an end goes before a duration, and no duration is negative."""
    rule = r"<p\b([^>]*)>([\s\S]*?)</p>"

    def attributes(p: Column) -> Column:
        value = lambda name: F.nullif(F.regexp_extract(p["attrs"], rf'(?s)^.*\b{name}="([^"]*)"', 1), F.lit(""))
        return F.struct(F.coalesce(value("begin"), value("start")).alias("begin"), value("end").alias("end"), value("dur").alias("dur"), p["body"].alias("body"))

    def times(a: Column) -> Column:
        return F.struct(timecode(a["begin"]).alias("start"), timecode(a["end"]).alias("end"), timecode(a["dur"]).alias("dur"), a["body"].alias("body"))

    def one(t: Column) -> Column:
        duration = F.coalesce(t["end"] - t["start"], t["dur"], F.lit(0.0))
        return _segment(t["start"], F.greatest(F.lit(0.0), duration), _plain(F.regexp_replace(decoded(t["body"]), _TAG, "")))

    found = F.arrays_zip(F.regexp_extract_all(payload, F.lit(rule), F.lit(1)).alias("attrs"), F.regexp_extract_all(payload, F.lit(rule), F.lit(2)).alias("body"))
    # step by step, so that no attribute or time is worked out twice
    return _whole(F.transform(F.transform(F.transform(found, attributes), times), one))


def parsed(payload: Column, form: Column | str = "") -> Column:
    """By format: json3, vtt, ttml; for any other the first of XML, JSON and VTT that gives a segment."""
    form = F.lit(form) if isinstance(form, str) else form
    some = lambda found, other: F.when(F.size(found) > 0, found).otherwise(other)
    sniffed = some(from_xml(payload), some(from_json(payload), from_vtt(payload)))
    return F.when(form == "json3", from_json(payload)).when(form == "vtt", from_vtt(payload)).when(form == "ttml", from_ttml(payload)).otherwise(sniffed)


def caption_tracks(payload: Column) -> Column:
    """Each <track .../> as a map of its attributes."""
    pair = r'([A-Za-z_]+)="([^"]*)"'
    pairs = lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(pair), F.lit(1)).alias("key"), F.regexp_extract_all(t, F.lit(pair), F.lit(2)).alias("value"))
    return F.transform(F.regexp_extract_all(payload, F.lit(r"<track\b[^>]*/>"), F.lit(0)), lambda t: F.map_from_entries(F.transform(pairs(t), lambda e: F.struct(e["key"], decoded(e["value"])))))


def segments(files: DataFrame, payload: str, form: Column | str = "") -> DataFrame:
    """One row a segment: the other columns, seq from 0, start, duration, text, speaker."""
    kept = [c for c in files.columns if c != payload]
    return files.select(*kept, F.posexplode(parsed(F.col(payload), form)).alias("seq", "_s")).select(*kept, "seq", "_s.*")
