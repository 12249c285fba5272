"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and runs of white space become one space. An item of n characters may
occur with up to k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece of any such occurrence
is exact. One Aho-Corasick pass over each document finds all exact pieces of all items; around each hit
Myers' bit-parallel algorithm gives the least edit distance of the item in the window where it can lie,
and the occurrence counts if that is at most k.

The items are taken in blocks of about BLOCK_CHARS characters (an item is never cut, so a longer one is a block), one
pass over the documents for each; where there are several, each pass is written before the next block is read, so the
driver and every task hold one block and one automaton. Documents are streamed; no pair of documents ever meets.

Defined results: null and blank texts and items match nothing; an item shorter than min_chars after normalising
is matched exactly only (k = 0) and only between word boundaries, as inside other words a short string proves
nothing; an item shorter than least_chars is too short to tell a leak from chance and matches nothing. Repeated
items are reported under each id, items with a null id under null. Empty tables of documents or items give no match.
Extra columns are ignored by `contaminated` and kept by `decontaminated`.
"""

from __future__ import annotations

from collections import deque

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, discard, lean, with_text, written

BLOCK_CHARS = 4_000_000
#: How many windows of an item are remembered, so that they are not measured again.
RECENT = 16


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, text) that cover the item, lengths at most one apart."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the window, where the first such substring ends)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best, at = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(window, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if now < best:
            best, at = now, j
    return best, at


def apart(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float, min_chars: int, least_chars: int):
        self.items, self.automaton, self.min_chars = [], ahocorasick.Automaton(), min_chars
        where: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = normalised(text or "")
            if len(item) < max(1, least_chars):
                continue
            k = int(len(item) * rate) if len(item) >= min_chars else 0
            for offset, piece in pieces(item, k):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((key, item, k, masks(item)))
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int]]:
        """(item key, distance, end) of the best occurrence of each item that occurs; end in the normalised text."""
        if not self.items or not text:
            return []
        text = normalised(text)
        # the last windows of each item: pieces of one occurrence lie close together
        tried: dict[int, deque[tuple[int, int]]] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                key, item, k, peq = self.items[i]
                if i in best and best[i][0] == 0:
                    continue
                start = last + 1 - size - offset
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                if k:
                    windows = tried.setdefault(i, deque(maxlen=RECENT))
                    if any(a <= lo and hi <= b for a, b in windows):
                        continue
                    windows.append((lo, hi))
                if start >= 0 and text.startswith(item, start):
                    if len(item) >= self.min_chars or apart(text, start, start + len(item)):
                        best[i] = (0, start + len(item))
                    continue
                if k == 0:
                    continue
                d, at = myers(peq, len(item), text[lo:hi])
                if d <= k and (i not in best or (d, lo + at) < best[i]):
                    best[i] = (d, lo + at)
        return [(self.items[i][0], d, end) for i, (d, end) in sorted(best.items())]


def _match_batches(items: list, limits: tuple, of):
    @lean
    def run(batches):
        matcher = Matcher(items, *limits)
        for batch in batches:
            rows, keys, dist, ends = [], [], [], []
            for row, text in enumerate(of(batch).to_pylist()):
                for key, d, end in matcher.find(text) if text else ():
                    rows.append(row)
                    keys.append(key)
                    dist.append(d)
                    ends.append(end)
            key = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, pa.array(keys, pa.int64()), pa.array(dist, pa.int32()), pa.array(ends, pa.int32())], ["key", "item_id", "distance", "end_char"])

    return run


def _clean_batches(items: list, limits: tuple, of):
    @lean
    def run(batches):
        matcher = Matcher(items, *limits)
        for batch in batches:
            yield batch.filter(pa.array([not x or not matcher.find(x) for x in of(batch).to_pylist()], pa.bool_()))

    return run


class _Blocks:
    """The items, a block of bounded size at a time."""

    def __init__(self, benchmark: DataFrame, item_id_col: str, item_text_col: str, block_chars: int):
        self.items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
        chars = self.items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
        self.n = max(1, -(-chars // block_chars))

    def __iter__(self):
        for b in range(self.n):
            yield [tuple(r) for r in self.items.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == b).orderBy("i", "t").collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.05,
    min_chars: int = 40,
    least_chars: int = 12,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    keep: list[str] | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row for each document and item that occurs in it: kept columns (doc_id by default), item_id, distance, end_char."""
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, keep or ["doc_id"], text_col)
    out, blocks = None, _Blocks(benchmark, item_id_col, item_text_col, block_chars)
    for block in blocks:
        part = df.mapInArrow(_match_batches(block, (rate, min_chars, least_chars), texts), f"{key}, item_id long, distance int, end_char int")
        part = written(part) if blocks.n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.select("key.*", "item_id", "distance", "end_char")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.05,
    min_chars: int = 40,
    least_chars: int = 12,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of docs, all columns, in which no item occurs."""
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, docs.columns, text_col)
    before, blocks = None, _Blocks(benchmark, item_id_col, item_text_col, block_chars)
    for block in blocks:
        df = df.mapInArrow(_clean_batches(block, (rate, min_chars, least_chars), texts), key)
        if blocks.n > 1:
            df = written(df)
            if before is not None:
                discard(before)
            before = df
    return df.select("key.*")
