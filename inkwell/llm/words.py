"""Vectorised words, word hashes and word n-gram hashes over Arrow text buffers.

Separators are always ASCII bytes, so UTF-8 texts are cut on bytes. A word's hash is a
polynomial over random 64-bit byte codes, read off prefix sums; no Python loop per word.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = CODES[LOWER]

#: Bytes of words: all but white space; and lower-case letters, digits and all that is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes whose prefix sums are held at once, and the powers of the base and of its inverse for them.
BLOCK = 1 << 16
POWERS, INVERSES = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(BLOCK, b, np.uint64))]) for b in (BASE, INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose low and high bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sum(data: np.ndarray, codes: np.ndarray) -> np.uint64:
    """The polynomial of a span of any length, block by block."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        total += (codes[part] * POWERS[: len(part)]).sum(dtype=np.uint64) * shift
        shift *= POWERS[BLOCK : BLOCK + 1]
    return total[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """Hash of data[start:end] for each pair, in rising order of starts and of ends; memory is bounded by a block."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + BLOCK, "right"))
        if j <= i:
            out[i] = _sum(data[a : int(ends[i])], codes)
            i += 1
            continue
        b = int(ends[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(codes[data[a:b]] * POWERS[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * INVERSES[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of consecutive texts."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    mask = inside[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = mask[cuts]
    finish[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive hashes; row borders are the caller's business."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    q = np.uint64((0xD1342543DE82EF95 + 2 * salt * 0x2545F4914F6CDD1D) & ((1 << 64) - 1) | 1)
    g = hashes[:n].copy()
    for j in range(1, k):
        g *= q
        g += hashes[j : j + n]
    return mix(g + np.uint64(k))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost smallest value in each window of w values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = values[:n].copy(), np.arange(n)
    for j in range(1, w):
        nxt = values[j : j + n]
        less = nxt <= best
        best[less] = nxt[less]
        at[less] = np.flatnonzero(less) + j
    return at
