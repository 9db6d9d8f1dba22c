"""Suffix arrays of a shard of byte strings in numpy: Larsson-Sadakane refinement and Kasai's common prefixes.

Every string ends in a symbol of its own, so no suffix is equal to another and no common
prefix runs over a string's end.
"""

from __future__ import annotations

import numpy as np


def concatenate(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, each with its own end symbol (256 and up), and where each string begins."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.empty(int(sizes.sum()) + len(strings), np.int64)
    ends = starts + sizes
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8)
    text[ends] = 256 + np.arange(len(strings))
    return text, starts


#: Symbols of 9 bits that one word holds.
WIDE = 7


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The WIDE symbols from each place on in one word, all end symbols written alike, and whether one of them is an end."""
    padded = np.concatenate([np.minimum(text, 256), np.full(WIDE - 1, 256, np.int64)])
    n = len(text)
    word, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(WIDE):
        ended |= padded[k : k + n] == 256
        word = word << 9 | np.where(ended, 256, padded[k : k + n])  # what follows an end does not count
    return word, ended


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank). Groups of suffixes that are equal to depth h carry their last place as rank; a step sorts
    the groups that have more than one member by the rank h symbols on, and so doubles h. Sorted groups rest.
    A suffix whose end comes within the first words rests from the start: ends rank by their places.
    """
    n, depth = len(text), WIDE
    key, ended = _words(text)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | ended[order][1:]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first + size - 1, size)
    open_places = np.flatnonzero(np.repeat(size, size) > 1)
    while len(open_places):
        at = order[open_places]
        key = rank[at] * (n + 1) + rank[np.minimum(at + depth, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_places] = at  # the places of a group are one run, so groups stay where they are
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(open_places[first + size - 1], size)
        open_places = open_places[np.repeat(size, size) > 1]
        depth *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the prefix that the suffixes at places r and r + 1 share (0 at the last place).

    Kasai: from one suffix of a string to the next, the length falls by one at most. All
    strings take a step together; those whose length grows by more compare whole words.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    sizes = np.diff(np.append(starts, n))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    length = np.zeros(len(starts), np.int64)
    word, ended = _words(text)
    padded = np.concatenate([text, np.arange(-WIDE, 0)])  # no symbol beyond the last one is met
    following = np.concatenate([order[1:], [n]])[rank]  # n: the last place has no follower
    alive = len(starts)
    longest = int(sizes[0]) if len(sizes) else 0
    left = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")  # strings that have a symbol at each step
    for j in range(longest):
        alive = int(left[j])
        i = starts[:alive] + j
        k = following[i]
        here = np.maximum(length[:alive] - 1, 0)
        going = np.flatnonzero(padded[np.minimum(i + here, n)] == padded[np.minimum(k + here, n + 1)])
        here[going] += 1
        rest = going
        while len(rest):
            a, b = np.minimum(i[rest] + here[rest], n - 1), np.minimum(k[rest] + here[rest], n - 1)
            rest = rest[(word[a] == word[b]) & ~ended[a]]
            here[rest] += WIDE
        while len(going):
            going = going[padded[np.minimum(i[going] + here[going], n)] == padded[np.minimum(k[going] + here[going], n + 1)]]
            here[going] += 1
        here[k == n] = 0
        length[:alive] = here
        out[rank[i]] = here
    return out
