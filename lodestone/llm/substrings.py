"""Substring dedup by seed and extend.

Words are the runs `[^\\x20\\x09-\\x0D]+`. Seeds are winnowed anchors: of every `length - gram + 1` consecutive
word grams the least hash (the leftmost of equals) is an anchor, so each window of `length` words has exactly one,
and equal windows have the same anchor at the same place. An anchor's reach is the run of windows whose anchor it is;
the words these windows cover are its context.

1. Seeds are counted, and those that occur once are dropped before anything is written.
2. Occurrences are joined with the repeated seeds. Those of equal seed and equal reach form a class: in a class of two
   or more, each occurrence matches over its whole reach.
3. Where a seed has several classes, each is joined on the seed with the first of them, its representative, and the match
   is extended from the seed to the left and to the right, as far as both contexts have equal words. Matches of
   `length` words or more are kept for both sides. So a seed with m classes costs m extensions, not m squared.
4. What a class has beyond its match differs from the representative but may match a third class. Then both hold the seed
   extended by the first differing word: these extended seeds are counted, and only windows behind a repeated one are
   compared, by digest.

The matches of a document are joined into maximal repeats, and the words these cover are removed. Words are compared by
64-bit hashes, windows of step 4 by two 64-bit digests over these. Each intermediate table is deleted when it has
been read; a seed's occurrences never come together in one task, as joins on it have one row for it on one side.

Windows are judged on the input, the same document included. Defined results: null, empty and blank texts
and texts shorter than a window lose nothing; repeated rows are documents of their own and so lose every window;
null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, discard, lean, written
from lodestone.llm.wordhash import _INVERSE, U, hashed, mix, rolled

GRAM = 8
_RANGE = (0x9E3779B97F4A7C15 | 1, _INVERSE)
#: An occurrence's first window, its anchor's place after that, and its last window after that, in one long.
_BITS = 12
_LOW = (1 << _BITS) - 1
AT = "d long, t long, at long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def ranges(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of words[start:end] for each pair."""
    up, down = _powers(_RANGE[0], len(words)), _powers(_RANGE[1], len(words))
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(words * up, dtype=U)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def anchors(words: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window, last window) of each anchor's reach."""
    hashes = rolled(words, gram)
    span = length - gram + 1
    at = np.arange(len(hashes))
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        width += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    place = at[first]
    return hashes[place], place, first, last


def extended(x: np.ndarray, x_at: int, y: np.ndarray, y_at: int, gram: int) -> tuple[int, int]:
    """How many words a match of grams at x_at in x and y_at in y goes on to the left and to the right."""

    def equal(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    return equal(x[:x_at][::-1], y[:y_at][::-1]), equal(x[x_at + gram :], y[y_at + gram :])


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _seed_batches(length: int, gram: int):
    @lean
    def run(batches):
        for batch in batches:
            seeds = [anchors(words, length, gram)[0].view(np.int64) for _, words in hashed(batch.column(0)) if len(words) >= length]
            found, n = np.unique(_flat(seeds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["seed", "n"])

    return run


def _anchor_batches(length: int, gram: int):
    @lean
    def run(batches):
        for batch in batches:
            rows, seeds, reaches, ats = [], [], [], []
            for i, words in hashed(batch.column(2)):
                if len(words) < length:
                    continue
                seed, place, first, last = anchors(words, length, gram)
                rows.append(np.full(len(seed), i))
                seeds.append(seed.view(np.int64))
                reaches.append(mix(ranges(words, first, last + length) ^ mix((place - first).astype(U))).view(np.int64))
                ats.append(first << 2 * _BITS | (place - first) << _BITS | last - first)
            at = pa.array(_flat(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(_flat(ats)), pa.array(_flat(seeds)), pa.array(_flat(reaches))],
                ["d", "t", "at", "seed", "reach"],
            )

    return run


def _context_batches(length: int):
    """The word hashes of each context asked for in a document's `open` list."""

    @lean
    def run(batches):
        for batch in batches:
            rows, out, contexts = [], {"seed": [], "at": [], "n": [], "first": []}, []
            wanted = batch.column(3)
            for i, words in hashed(batch.column(2)):
                for x in wanted[i].as_py():
                    rows.append(i)
                    for name, values in out.items():
                        values.append(x[name])
                    start = x["at"] >> 2 * _BITS
                    contexts.append(words[start : start + (x["at"] & _LOW) + length].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(out["at"], pa.int64()),
                    pa.array(out["seed"], pa.int64()),
                    pa.array(out["n"], pa.int64()),
                    pa.array(out["first"], pa.bool_()),
                    pa.array(contexts, pa.binary()),
                ],
                ["d", "t", "at", "seed", "n", "first", "context"],
            )

    return run


def _extension_batches(length: int, gram: int):
    """Each class against its seed's representative: matched words [a, b) of either side (key null), or
    an extended seed (key) with the windows [a, b) behind it."""

    @lean
    def run(batches):
        for batch in batches:
            out = set()
            for d, t, at, n, context, d0, t0, at0, n0, context0 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, t, at) == (d0, t0, at0):
                    continue
                first, off, run_ = at >> 2 * _BITS, at >> _BITS & _LOW, at & _LOW
                first0, off0 = at0 >> 2 * _BITS, at0 >> _BITS & _LOW
                words, words0 = np.frombuffer(context, dtype=U), np.frombuffer(context0, dtype=U)
                left, right = extended(words, off, words0, off0, gram)
                a, b = off - left, off + gram + right
                if b - a >= length:
                    if n == 1:
                        out.add((d, t, at, n, None, first + a, first + b))
                    if n0 == 1:
                        out.add((d0, t0, at0, n0, None, first0 + off0 - left, first0 + off0 + gram + right))
                beyond = [(a - 1, off + gram, 0, a)] if a > 0 else []
                if b < len(words):
                    beyond.append((off, b + 1, max(0, b - length + 1), run_ + 1))
                if beyond:
                    keys = ranges(words, np.array([x[0] for x in beyond]), np.array([x[1] for x in beyond])).view(np.int64)
                    for key, (_, _, lo, hi) in zip(keys.tolist(), beyond, strict=True):
                        hi = min(hi, run_ + 1)
                        if lo < hi:
                            out.add((d, t, at, n, key, first + lo, first + hi))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "t", "at", "n", "key", "a", "b"])

    return run


def _window_batches(length: int):
    """Digests of the windows [a, b) of a context."""

    @lean
    def run(batches):
        for batch in batches:
            rows, ones, twos, starts = [], [], [], []
            for i, (at, context, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:6]), strict=True)):
                first = at >> 2 * _BITS
                words = np.frombuffer(context, dtype=U)[a - first : b - 1 - first + length]
                rows.append(np.full(b - a, i))
                ones.append(rolled(words, length).view(np.int64))
                twos.append(rolled(mix(words), length, seed=1).view(np.int64))
                starts.append(np.arange(a, b))
            at = pa.array(_flat(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(6).take(at), pa.array(_flat(ones)), pa.array(_flat(twos)), pa.array(_flat(starts))],
                ["d", "t", "n", "w1", "w2", "a"],
            )

    return run


@lean
def _cut_batches(batches):
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        words_n, removed, kept, repeats = [], [], [], []
        for i in range(batch.num_rows):
            data = texts[i].as_py() or b""
            words = data.split()
            n = len(words)
            mine = spans[i].as_py()
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in mine) if mine else ():
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            if merged:
                parts, at = [], 0
                for a, b in merged:
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                words = parts
            words_n.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
            repeats.append([{"first_word": a, "end_word": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(repeats, REPEATS)],
            ["id", "n_words", "n_removed", "kept_sha256", "repeats"],
        )


REPEATS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, text): id (lowest long for null), text hash and bytes; rows of equal d and t are repeated rows."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))


def repeated(docs: DataFrame, length: int = 35, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, spans): ranges [a, b) of words that match elsewhere, of the document with id d (lowest long for null) and text hash t."""
    gram = min(GRAM, length)
    if length - gram > _LOW:
        raise ValueError(f"length is at most {_LOW + gram}")
    arrow_rows(docs.sparkSession)
    source = _keyed(docs, id_col, text_col)
    who = F.struct("d", "t", "at")

    counted = source.select("text").mapInArrow(_seed_batches(length, gram), "seed long, n long")
    seeds = written(counted.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed"))
    found = source.mapInArrow(_anchor_batches(length, gram), f"{AT}, seed long, reach long")
    # the same join at every size: the repeated seeds grow with the input
    found = written(found.join(seeds.hint("merge"), "seed"))
    discard(seeds)

    classes = written(found.groupBy("seed", "reach").agg(F.count("*").alias("n"), F.min(who).alias("who")))
    several = classes.where("n > 1").select("seed", "reach")
    whole = found.join(several, ["seed", "reach"]).select("d", "t", F.shiftright("at", 2 * _BITS).cast("int").alias("a"), (F.shiftright("at", 2 * _BITS) + F.col("at").bitwiseAND(_LOW) + length).cast("int").alias("b"))
    spans = [written(whole)]
    discard(found)

    # written, so that Spark may split a common seed's partition in the join
    first = written(classes.groupBy("seed").agg(F.count("*").alias("m"), F.min("who").alias("rep")).where("m > 1").select("seed", "rep"))
    open_ = classes.join(first.hint("merge"), "seed").select("who.*", "seed", "n", (F.col("who") == F.col("rep")).alias("first"))
    open_ = written(open_.groupBy("d", "t").agg(F.collect_list(F.struct("seed", "at", "n", "first")).alias("open")))
    for df in (classes, first):
        discard(df)
    contexts = written(source.join(open_.hint("merge"), ["d", "t"]).select("d", "t", "text", "open").mapInArrow(_context_batches(length), f"{AT}, seed long, n long, first boolean, context binary"))
    discard(open_)

    # repeated rows give a representative several times
    reps = written(contexts.where("first").groupBy("seed").agg(F.first(F.struct("d", "t", "at", "n", "context")).alias("rep")).select("seed", *[F.col(f"rep.{c}").alias(f"{c}0") for c in ("d", "t", "at", "n", "context")]))
    sides = contexts.join(reps.hint("merge"), "seed").select("d", "t", "at", "n", "context", "d0", "t0", "at0", "n0", "context0")
    extensions = written(sides.mapInArrow(_extension_batches(length, gram), f"{AT}, n long, key long, a long, b long"))
    discard(reps)
    spans.append(extensions.where("key is null").select("d", "t", F.col("a").cast("int"), F.col("b").cast("int")))

    shared = extensions.where("key is not null").groupBy("key").agg(F.min(who).alias("x"), F.max(who).alias("y")).where("x < y").select("key")
    beyond = extensions.where("key is not null").join(shared, "key").select("d", "t", "at", "a", "b", "n").distinct()
    windows = contexts.select("d", "t", "at", "context").join(beyond, ["d", "t", "at"]).select("d", "t", "at", "context", "a", "b", "n")
    windows = written(windows.mapInArrow(_window_batches(length), "d long, t long, n long, w1 long, w2 long, a long"))
    discard(contexts)
    start = F.struct("d", "t", "a")
    again = windows.groupBy("w1", "w2").agg(F.min(start).alias("x"), F.max(start).alias("y")).where("x < y").select("w1", "w2")
    single = windows.where("n = 1").join(again, ["w1", "w2"])
    spans.append(single.select("d", "t", F.col("a").cast("int"), (F.col("a") + length).cast("int").alias("b")))

    # repeated rows report the same ranges; a set keeps one of each
    out = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = written(out)
    for df in (spans[0], extensions, windows):
        discard(df)
    return out


def without_repeats(docs: DataFrame, length: int = 35, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, repeats) of each row; repeats: its maximal repeats as word ranges."""
    found = repeated(docs, length, id_col=id_col, text_col=text_col)
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    out = key.join(found, ["d", "t"], "left").select("id", "text", "spans")
    out = out.mapInArrow(_cut_batches, "id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first_word:int,end_word:int>>")
    return out.withColumnRenamed("id", id_col)
