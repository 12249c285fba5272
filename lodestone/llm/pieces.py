"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and scores come from a public .model file (a protocol buffer, read here); scores
count as log scores. A text is escaped (space -> U+2581, one marker before it), and the best
segmentation is the one with the highest sum of scores; equal sums go to the earlier start of the
last piece. Characters that no piece covers cost the lowest score minus 10 and become byte pieces.

A cut between two characters is safe where no piece holds them side by side: the best
segmentation of the whole is then the concatenation of the parts' best ones. Texts are cut so, and
the parts' ids are kept for parts met again (up to a limit), which changes no result.

Defined results: null gives null ids; the empty text gives no ids. Decoding replaces ill-formed
byte runs by U+FFFD and drops the marker before the text, so decode(encode(x)) == x unless x
holds U+2581 itself.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import arrow_rows, lean, with_text

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(field number, value) of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


class DoubleArray:
    """A trie over bytes: a node's child by byte b is base[node] + b + 1, if check there is the node.

    value[node] is the id of the key that ends there, or -1.
    """

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0] = 0
        lone = crowded = 1  # where to look for room for one child, for several
        todo = [(0, tree)]
        while todo:
            node, children = todo.pop()
            self.value[node] = children.get(-1, -1)
            labels = sorted(b for b in children if b >= 0)
            if not labels:
                continue
            spot = max(lone if len(labels) == 1 else crowded, labels[0] + 1)
            tries = 0
            while True:
                base = spot - labels[0] - 1
                while base + 258 >= len(self.check):
                    for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        x.extend(array("i", [fill]) * len(x))
                if all(self.check[base + b + 1] == -1 for b in labels):
                    break
                spot += 1
                tries += 1
                if len(labels) > 1 and tries >= 64:
                    crowded, tries = spot, 0
            if len(labels) == 1:
                lone = max(lone, spot)
            self.base[node] = base
            for b in labels:
                self.check[base + b + 1] = node
                todo.append((base + b + 1, children[b]))

    def get(self, key: bytes) -> int:
        node = 0
        for b in key:
            child = self.base[node] + b + 1
            if self.check[child] != node:
                return -1
            node = child
        return self.value[node]


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    prefix: bool
    trie: DoubleArray
    pairs: frozenset[str]
    cut_at_marks: bool
    worst: float
    unknown: int
    byte_ids: list[int]
    out: list[bytes]
    scores: list[float]

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, prefix = [], True
        for number, value in _fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((text, score, kind))
            elif number == 3:
                prefix = dict(_fields(value)).get(3, 1) != 0
        usable = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p}
        byte_ids, unknown = [-1] * 256, 0
        out = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == UNKNOWN:
                unknown = i
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if kind == CONTROL else p.replace(MARK, " ").encode())
        pairs = frozenset(p[i : i + 2] for p, _, kind in pieces if kind in (NORMAL, USER) for i in range(len(p) - 1))
        worst = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        return cls(pieces, prefix, DoubleArray(usable), pairs, all(x[0] == MARK for x in pairs if x[1] == MARK), worst, unknown, byte_ids, out, [x for _, x, _ in pieces])

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of escaped text, without any cut."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        score = [-math.inf] * (n + 1)
        came = [0] * (n + 1)
        ids = [-1] * (n + 1)
        score[0] = 0.0
        missing = self.worst - UNKNOWN_PENALTY
        start = 0
        while start < n:
            b = data[start]
            first = start + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            here, node, end, single = score[start], 0, start, False
            while end < n:
                child = base[node] + data[end] + 1
                if check[child] != node:
                    break
                node = child
                end += 1
                found = value[node]
                if found >= 0:
                    new = here + scores[found]
                    if new > score[end]:
                        score[end], came[end], ids[end] = new, start, found
                    if end == first:
                        single = True
            if not single:
                new = here + missing
                if new > score[first]:
                    score[first], came[first], ids[first] = new, start, -1
            start = first
        out: list[int] = []
        at = n
        while at:
            if ids[at] >= 0:
                out.append(ids[at])
            else:
                part = [self.byte_ids[b] for b in data[came[at] : at]]
                out += [self.unknown] if -1 in part else part[::-1]
            at = came[at]
        return out[::-1]


class Codec:
    """Encoder and decoder that keeps the ids (packed int32) of parts met before."""

    def __init__(self, model: PieceModel, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of escaped text, cut wherever that is safe."""
        model, pairs, out, start = self.model, self.model.pairs, [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in pairs:
                part = word[start:i]
                ids = self.parts.get(part)
                if ids is None:
                    ids = array("i", model.best(part)).tobytes()
                    if len(part) <= 64:
                        if len(self.parts) >= self.limit:
                            self.parts.clear()
                        self.parts[part] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of a text as int32 in the machine's byte order."""
        if not text:
            return b""
        if not self.model.cut_at_marks or "  " in text or text[0] == " " or text[-1] == " " or not self.model.prefix or MARK in text:
            return self._word((MARK if self.model.prefix else "") + text.replace(" ", MARK))
        split = text.split(" ")
        found = list(map(self.words.get, split))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    w = split[i]
                    found[i] = ids = self._word(MARK + w)
                    if len(w) <= 64:
                        if len(self.words) >= self.limit:
                            self.words.clear()
                        self.words[w] = ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.model.out.__getitem__, ids))
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _encode_batches(model: PieceModel, digest: bool):
    @lean
    def run(batches, of):
        codec = Codec(model)
        is_byte = np.array([kind == BYTE for _, _, kind in model.pieces])
        for batch in batches:
            texts = of(batch).to_pylist()
            packed = [None if x is None else codec.packed(x) for x in texts]
            offsets = np.concatenate(([0], np.cumsum([len(x or b"") // 4 for x in packed]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(x for x in packed if x), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([x is None for x in packed], pa.bool_()))
            if not digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])
                continue
            cols: list[list] = [[], [], [], []]
            for x, found in zip(texts, packed, strict=True):
                if x is None:
                    for c in cols:
                        c.append(None)
                    continue
                cols[0].append(len(found) // 4)
                cols[1].append(int(is_byte[np.frombuffer(found, dtype=np.int32)].sum()))
                cols[2].append(zlib.crc32(found))
                cols[3].append(codec.decode(array("i", found)) == x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            told = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *told], ["key", "ids", "n_ids", "n_bytes", "ids_crc32", "round_trip"])

    return run


def _run(docs: DataFrame, make, schema: str, text_col: str, keep: list[str] | None) -> DataFrame:
    arrow_rows(docs.sparkSession)
    df, key, texts = with_text(docs, keep or ["doc_id"], text_col)
    return df.mapInArrow(lambda batches: make(batches, texts), f"{key}, {schema}").select("key.*", *[x.split()[0] for x in schema.split(", ")])


def encode(docs: DataFrame, model: PieceModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (doc_id by default) and ids array<int> of the whole text."""
    return _run(docs, _encode_batches(model, False), "ids array<int>", text_col, keep)


def encode_digest(docs: DataFrame, model: PieceModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encode, with the number of ids and of byte pieces, the CRC-32 of the ids (little-endian int32), and whether decoding gives the text back."""
    return _run(docs, _encode_batches(model, True), "ids array<int>, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean", text_col, keep)


def decode(encoded: DataFrame, model: PieceModel, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Kept columns and the decoded text; null for null ids."""

    @lean
    def run(batches, of):
        codec = Codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return _run(encoded, run, "text string", ids_col, keep)
