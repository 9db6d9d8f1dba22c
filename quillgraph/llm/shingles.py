"""Word shingles of Arrow text batches as 64-bit hashes, in numpy over whole batches.

A word's hash is the sum of a random number per byte times a power of its place, made
independent of where the word stands and then mixed; a shingle's hash mixes its words'.
"""

from __future__ import annotations

import numpy as np

from quillgraph.llm.common import SPACE

U = np.uint64
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=U)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
BASE = U(0x9E3779B97F4A7C15 | 1)
PLACE = _RANDOM.integers(0, 2**64, 16, dtype=U) | U(1)
_INVERSE = U(pow(int(BASE), -1, 2**64))
#: Bytes that are hashed at a time; a row is never cut, so a longer one is hashed alone.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows, and how many words each row has."""
    n = len(data)
    space = np.zeros(256, bool)
    space[np.frombuffer(SPACE.encode(), np.uint8)] = True
    inside = ~space[data]
    border = np.zeros(n + 1, bool)  # a row begins here
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    power = np.cumprod(np.full(n, BASE, U))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * power)])
    back = np.cumprod(np.full(n, _INVERSE, U))
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))
    per_row = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return words, per_row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5):
    """For each row its sorted distinct shingle hashes. A row of fewer words has one hash, one without words none."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, min(int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1, rows))
        part = offsets[first : last + 1]
        words, per_row = _word_hashes(data[part[0] : part[-1]], part - part[0])
        shingles = np.zeros(max(0, len(words) - size + 1), U)
        for k in range(size):
            shingles += words[k : k + len(shingles)] * PLACE[k]
        shingles, at = mix(shingles), 0
        for n in per_row.tolist():
            if n >= size:
                yield np.unique(shingles[at : at + n - size + 1])
            elif n:
                yield mix((words[at : at + n] * PLACE[:n]).sum(keepdims=True) + U(n))
            else:
                yield np.zeros(0, U)
            at += n
        first = last
