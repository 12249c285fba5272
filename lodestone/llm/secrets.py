"""Secret scans over a trigram inverted index.

Each rule's regex is parsed into a Boolean query over lower-case ASCII byte trigrams: literal
runs that every match must hold give trigrams joined by AND, alternatives are joined by OR.
For every block of documents the operator indexes the trigrams that the rules ask for
(trigram -> rows), evaluates each rule's query by intersecting and uniting postings, and runs the
regex over the rows left. A rule without a mandatory trigram (the hex rule) scans every row.
Parsing only ever weakens a query, so no match is lost; tests compare with a plain scan.

Defined results: an empty table gives an empty table; null and empty texts have no span; spans count code points, end exclusive, and
are sorted by start, then by the order of the rules. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, lean, with_text


@dataclass(frozen=True)
class Rule:
    """least: the shortest length that counts, of group `group` (0: of the whole match)."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0


#: Fixed patterns: the first three are the contract's, the rest name public token formats. None looks at a character more
#: than a bounded number of times: a run that a rule can fail behind is only entered at its start.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("live", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)

#: A query is True (all rows), a trigram, or ("and" | "or", queries).
ALL = True


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(node: tuple, most: int = 64) -> list[str] | None:
    """Every string the node can match, if they are few; None otherwise."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        if any(x[0] is not sre.LITERAL for x in arg):
            return None
        found = sorted({chr(x[1]).lower() for x in arg})
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(list(arg[3]), most)
    if op is sre.BRANCH:
        each = [_sequence(list(x), most) for x in arg[1]]
        return None if None in each else sorted({s for x in each for s in x})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
        inner = _sequence(list(arg[2]), most)
        if inner is None:
            return None
        out, now = set(inner if arg[0] == 1 and arg[1] == 1 else []), [""]
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out.update(now)
            now = [a + b for a in now for b in inner]
            if len(now) > most:
                return None
        return sorted(out)
    return None


def _sequence(nodes: list, most: int = 64) -> list[str] | None:
    now = [""]
    for node in nodes:
        each = _strings(node, most)
        if each is None:
            return None
        now = [a + b for a in now for b in each]
        if len(now) > most:
            return None
    return now


def _of_strings(strings: list[str]) -> object:
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) if s.isascii() else ALL for s in strings])


def trigram_query(pattern: str) -> object:
    """A Boolean query over trigrams that holds for every text in which the pattern matches."""
    nodes = list(parser.parse(pattern, re.ASCII))

    def walk(nodes: list) -> object:
        parts, run = [], [""]

        def close() -> None:
            nonlocal run
            parts.append(_of_strings(run))
            run = [""]

        for node in nodes:
            each = _strings(node)
            if each is not None and len(joined := [a + b for a in run for b in each]) <= 64:
                run = joined
                continue
            close()
            if each is not None:
                run = each
                continue
            op, arg = node
            if op is sre.SUBPATTERN:
                parts.append(walk(list(arg[3])))
            elif op is sre.BRANCH:
                parts.append(_any_of([walk(list(x)) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(walk(list(arg[2])))
        close()
        return _all_of(parts)

    return walk(nodes)


def trigrams_of(query: object) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class BlockIndex:
    """Postings (rows, ascending) of the wanted trigrams over one block of texts."""

    _fold = np.arange(256, dtype=np.int32)
    _fold[65:91] += 32

    def __init__(self, texts: pa.Array, wanted: dict[str, int], lut: np.ndarray):
        self.rows = len(texts)
        self.postings: dict[str, np.ndarray] = {}
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        if hi - lo < 3:
            return
        buf = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        names = {v: k for k, v in wanted.items()}
        found_at, found = [], []
        for start in range(lo, hi - 2, 1 << 21):
            part = self._fold[buf[start : min(hi, start + (1 << 21) + 2)]]
            codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            hit = np.flatnonzero(lut[codes])
            found_at.append(hit + start)
            found.append(codes[hit])
        at, codes = np.concatenate(found_at), np.concatenate(found)
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[rows + 1]
        pairs = np.unique(codes[inside].astype(np.int64) * (self.rows + 1) + rows[inside])
        code, row = pairs // (self.rows + 1), pairs % (self.rows + 1)
        for part in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1):
            if len(part):
                self.postings[names[int(code[part[0]])]] = row[part]

    def rows_for(self, query: object) -> np.ndarray:
        if query is ALL:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings.get(query, np.zeros(0, dtype=np.int64))
        kind, parts = query
        if kind == "or":
            return np.unique(np.concatenate([self.rows_for(p) for p in parts]))
        out = None
        for p in parts:
            rows = self.rows_for(p)
            out = rows if out is None else np.intersect1d(out, rows, assume_unique=True)
            if not len(out):
                break
        return out


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


SPAN = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan_batches(rules: tuple[Rule, ...], of):
    @lean
    def run(batches):
        queries = [trigram_query(r.pattern) for r in rules]
        # a rule whose length floor has no group can be verified by a pattern that holds the floor itself
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        quick = [re.compile(r.pattern[:-1] + "{%d,}" % r.least, re.ASCII) if q is ALL and r.group == 0 and r.least and r.pattern.endswith("]+") and r.pattern.count("[") == 1 and r.pattern[0] == "[" else None for r, q in zip(rules, queries, strict=True)]
        wanted = {t: _code(t) for q in queries for t in trigrams_of(q)}
        lut = np.zeros(1 << 24, dtype=bool)
        lut[list(wanted.values())] = True
        for batch in batches:
            texts = of(batch)
            index = BlockIndex(texts, wanted, lut)
            spans: dict[int, list] = {}
            for k, rule in enumerate(rules):
                rows = index.rows_for(queries[k])
                for row in rows.tolist():
                    text = texts[row].as_py()
                    if text:
                        for m in (quick[k] or compiled[k]).finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                spans.setdefault(row, []).append((m.start(), k, m.end()))
            empty: list = []
            out = [[{"rule": rules[k].name, "start": a, "end": b} for a, k, b in sorted(spans[i])] if i in spans else empty for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN)], ["key", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (doc_id by default) and spans array<struct<rule, start, end>> of each row's secrets."""
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, keep or ["doc_id"], text_col)
    out = df.mapInArrow(_scan_batches(tuple(rules), texts), f"{key}, spans array<struct<rule:string,start:int,end:int>>")
    return out.select("key.*", "spans")


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts by base rule, the SHA-256 of the base spans and all spans as text."""
    names = [r.name for r in base]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.rule, s.start, s.end)), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.rule == name)).cast("long").alias(f"n_{name}")

    only = F.filter("spans", lambda s: s.rule.isin(names))
    return scanned.select("doc_id", *map(count, names), F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
