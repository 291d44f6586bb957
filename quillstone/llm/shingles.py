"""Sets of word shingles of many texts at once, as sorted 64-bit hashes, made from the texts' bytes with numpy.

A word is a run of ASCII letters, digits and non-ASCII characters, after lower-casing. A shingle is `width` words in a
row; a shorter text with words has one shingle of all of them, and a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstone.llm.common import slices, utf8

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[65:91] = WORD_BYTE[128:] = True
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xC2B2AE3D27D4EB4F
#: A window this large keeps the intermediate arrays in the processor's cache.
WINDOW_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, in order. A word's value is a polynomial in its bytes, so prefix sums give all.

    The bytes are read in windows, so that a very long text takes no more memory than its words' hashes. A word that a
    window cuts is put together from its pieces' values.
    """
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    up, down = powers(BASE, min(window, len(data))), powers(INVERSE, min(window, len(data)))
    values, begins = [], []
    held, held_at, held_size = 0, -1, 0
    for at in range(0, len(data), window):
        part = data[at : at + window]
        inside = WORD_BYTE[part]
        cut = starts[at : at + len(part)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:]
        last[:-1] &= ~inside[1:] | cut[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        value = (sums[end] - sums[begin]) * down[begin]
        if held_at >= 0:
            if len(begin) and begin[0] == 0 and not cut[0]:
                value[0] = (held + pow(BASE, held_size, 1 << 64) * int(value[0])) % (1 << 64)
                begin[0] = held_at - at
            else:
                values.append(np.array([held], np.uint64)), begins.append(np.array([held_at]))
            held_at = -1
        if len(end) and end[-1] == len(part) and at + window < len(data):
            held, held_at = int(value[-1]), int(begin[-1]) + at
            held_size = at + len(part) - held_at
            value, begin = value[:-1], begin[:-1]
        values.append(value), begins.append(begin + at)
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return mixed(np.concatenate(values) if values else np.zeros(0, np.uint64)), np.searchsorted(offsets, begin, "right") - 1


def shingle_sets(column: pa.Array, width: int = 5, window: int = WINDOW_BYTES) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending."""
    data, offsets = utf8(pc.utf8_lower(column))
    out: list[np.ndarray] = []
    for a, b in slices(offsets, 2 * WINDOW_BYTES):
        out += sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, window)
    return out


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int, window: int) -> list[np.ndarray]:
    empty = np.zeros(0, np.uint64)
    words, owner = word_hashes(data, offsets, window)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    out: list[np.ndarray] = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[lo:hi]
        if hi == lo:
            out.append(empty)
            continue
        # a short text's shingle is told from the others by its number of words
        n = max(1, hi - lo - width + 1)
        runs = np.full(n, 0 if hi - lo >= width else hi - lo, np.uint64)
        for k in range(min(width, hi - lo)):
            runs = runs * np.uint64(STEP) + own[k : k + n]
        out.append(np.unique(mixed(runs)))
    return out
