"""Words and their hashes, over UTF-8 bytes, without a Python object per word.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these are exactly
the runs of code points `[^\\x20\\x09-\\x0D]+`. A word's hash is a polynomial over random
64-bit values of its bytes, finished with the splitmix64 mixer. Work goes block by block, so
the memory of one call does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_VALUE[IS_SPACE] = 0
_UP = _DOWN = np.zeros(0, dtype=U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    return _UP, _DOWN


def _block(buf: np.ndarray, first: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one block; `first` marks where documents begin."""
    space = IS_SPACE[buf]
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, dtype=U)
    up, down = _tables(len(buf))
    value = _VALUE[FOLD[buf] if fold else buf]
    value *= up[: len(buf)]
    sums = np.add.reduceat(value, starts)
    return starts, mix(sums * down[starts])


def hashed(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row of a binary or string array.

    fold lower-cases A-Z first. Null rows have no words. Rows are taken together into blocks;
    a longer row is cut at white space (a single word longer than a block makes its own block).
    """
    texts = texts.cast(pa.large_binary())
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row, n = 0, len(texts)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= BLOCK:
            first = np.zeros(hi - lo, dtype=bool)
            inside = offsets[row:last] - lo
            first[inside[inside < hi - lo]] = True
            starts, hashes = _block(buf[lo:hi], first, fold)
            cuts = np.searchsorted(starts, offsets[row : last + 1] - lo)
            for i in range(row, last):
                yield i, hashes[cuts[i - row] : cuts[i - row + 1]]
        else:
            parts = []
            while lo < hi:
                end = min(hi, lo + BLOCK)
                if end < hi:
                    back = np.flatnonzero(IS_SPACE[buf[lo:end]])
                    if len(back):
                        end = lo + int(back[-1]) + 1
                    else:
                        while end < hi and not IS_SPACE[buf[end]]:
                            ahead = np.flatnonzero(IS_SPACE[buf[end : min(hi, end + BLOCK)]])
                            end = end + int(ahead[0]) if len(ahead) else min(hi, end + BLOCK)
                parts.append(_block(buf[lo:end], np.zeros(end - lo, dtype=bool), fold)[1])
                lo = end
            yield row, np.concatenate(parts)
        row = last


def rolled(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    if k <= 8:
        out = np.zeros(n, dtype=U)
        base = U(0x2545F4914F6CDD1D + 2 * seed)
        for j in range(k):
            out = out * base + words[j : j + n]
        return mix(out)
    base = (0x2545F4914F6CDD1D + 2 * seed) % (1 << 64) | 1
    out, step, unit, done, total = None, words, base, 0, k
    # doubling: step holds hashes of runs of 2^b words, out those of the bits of k already used
    length = 1
    while total:
        if total & 1:
            if out is None:
                out, done = step, length
            else:
                m = len(words) - done - length + 1
                out = out[:m] * U(unit) + step[done : done + m]
                done += length
        total >>= 1
        if total:
            m = len(step) - length
            step = step[:m] * U(unit) + step[length:]
            unit, length = unit * unit % (1 << 64), length * 2
    return mix(out[:n] + U(seed))
