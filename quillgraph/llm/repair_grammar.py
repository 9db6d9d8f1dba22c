"""Re-Pair over word ids in numpy, and the periodic runs that its grammar yields.

Frequent pairs become nonterminals round after round. In a round a place goes to the pair
with the most occurrences (in powers of two, then by a mixed key) of those that overlap
there, so each round replaces many pairs at once; when no pair repeats, what is left of
each string is joined in halves. Every string then derives from one nonterminal, and a run
lies across the boundary of exactly one lowest nonterminal that holds it whole. Runs
across a boundary are computed once for each nonterminal and translated to all places
where it was put in.

Windows are compared by exact names (prefix doubling), never by hashes.
"""

from __future__ import annotations

import numpy as np

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Grammar:
    """Rules by their first place (start, boundary, end) and the places of all, of LEAST_WORDS words and more."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """words: ids of all strings, one after another. ends: each string's end."""
        self.start, self.boundary, self.end = [], [], []
        self.rule, self.at = [], []
        self._ids: dict = {}
        self._known_keys, self._known_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(ends, prepend=0)
        symbol = words.astype(np.int64)
        first = np.arange(len(words))
        size = np.ones(len(words), np.int64)
        string = np.repeat(np.arange(len(ends)), sizes)
        self._next = int(symbol.max()) + 1 if len(symbol) else 0
        self._lowest = self._next
        while len(symbol) > 1:
            chosen = self._repeated(symbol, string)
            if not len(chosen):
                break
            symbol, first, size, string = self._replace(symbol, first, size, string, chosen, True)
        while len(symbol) > 1:
            rank = np.arange(len(string)) - np.searchsorted(string, string, "left")
            chosen = np.flatnonzero((rank[:-1] % 2 == 0) & (string[:-1] == string[1:]))
            if not len(chosen):
                break
            symbol, first, size, string = self._replace(symbol, first, size, string, chosen, False)
        self.start, self.boundary, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.start, self.boundary, self.end))
        self.rule, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.rule, self.at))

    @staticmethod
    def _repeated(symbol: np.ndarray, string: np.ndarray) -> np.ndarray:
        """Places of this round's pairs: each more frequent than the pairs it overlaps; of equal pairs in a row every second."""
        pair = symbol[:-1] << 31 | symbol[1:]
        inside = np.flatnonzero(string[:-1] == string[1:])
        _, inverse, counts = np.unique(pair[inside], return_inverse=True, return_counts=True)
        often = counts >= 2
        if not often.any():
            return np.zeros(0, np.int64)
        weight = np.zeros(len(pair) + 2, np.uint64)
        power = np.frexp(counts.astype(float))[1].astype(np.uint64)
        weight[1 + inside] = np.where(often[inverse], power[inverse] << np.uint64(58) | _mixed(pair[inside]) >> np.uint64(6), 0)
        same = np.r_[False, (pair[1:] == pair[:-1]) & (weight[2:-1] > 0) & (weight[1:-2] > 0)]
        group = np.maximum.accumulate(np.where(same, 0, np.arange(len(pair))))
        even = (np.arange(len(pair)) - group) % 2 == 0
        here = weight[1:-1]
        beats_left = same | (here > weight[:-2])
        beats_right = np.r_[same[1:], False] | (here > weight[2:])
        return np.flatnonzero((here > 0) & even & beats_left & beats_right)

    def _replace(self, symbol, first, size, string, chosen, shared: bool):
        start, boundary = first[chosen], first[chosen] + size[chosen]
        end = boundary + size[chosen + 1]
        if shared:
            keys, where, inverse = np.unique(symbol[chosen] << 31 | symbol[chosen + 1], return_index=True, return_inverse=True)
            at = np.searchsorted(self._known_keys, keys)
            known = at < len(self._known_keys)
            known[known] = self._known_keys[at[known]] == keys[known]
            ids = np.empty(len(keys), np.int64)
            ids[known] = self._known_ids[at[known]]
            ids[~known] = self._next + np.arange((~known).sum())
            new = where[~known]
            self._known_keys = np.insert(self._known_keys, at[~known], keys[~known])
            self._known_ids = np.insert(self._known_ids, at[~known], ids[~known])
            ids = ids[inverse]
        else:
            ids, new = self._next + np.arange(len(chosen)), np.arange(len(chosen))
        self._next += len(new)
        self.start.append(start[new]), self.boundary.append(boundary[new]), self.end.append(end[new])
        long = end - start >= LEAST_WORDS
        self.rule.append(ids[long] - self._lowest), self.at.append(start[long])
        symbol, size = symbol.copy(), size.copy()
        symbol[chosen] = ids
        size[chosen] = end - start
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        return symbol[keep], first[keep], size[keep], string[keep]


def _names(words: np.ndarray, left: np.ndarray):
    """Names of the windows of 1, 2, 4, ... words (equal names: equal words; -1 over a string's end), and each window's next place.

    left: words to the end of the string, itself included.
    """
    names, width = words.astype(np.int32), 1
    yield names, None
    longest = int(left.max()) if len(left) else 0
    while 2 * width <= longest:
        inside = np.flatnonzero(left >= 2 * width)
        key = names[inside].astype(np.int64) << 32 | names[inside + width]
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order[1:]] != key[order[:-1]]]
        names = np.full(len(words), -1, np.int32)
        names[inside[order]] = np.cumsum(new) - 1
        after = np.zeros(len(words), np.int64)
        again = np.flatnonzero(~new)
        after[inside[order[again - 1]]] = inside[order[again]]
        width *= 2
        yield names, after


def runs_in_strings(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs, by period and start. Strings lie one after another; no run crosses their ends."""
    nothing = np.zeros(0, np.int64)
    if not len(words):
        return nothing, nothing, nothing
    g = Grammar(words, ends)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(words))
    levels, found = [], []
    for names, after in _names(words, left):
        levels.append(names)
        if after is None:
            continue
        k = 1 << (len(levels) - 2)  # windows of 2k words tell periods from k to 2k - 1
        rules = np.flatnonzero(g.end - g.start >= max(LEAST_WORDS, LEAST_PERIODS * k))
        for t in range(7):  # one of these places lies in the run with three periods behind it
            at = g.boundary[rules] - t * k
            fits = at >= g.start[rules]
            rule, at = rules[fits], at[fits]
            period = after[at] - at
            good = (period >= k) & (period < 2 * k) & (at + period + 2 * k <= g.end[rule])
            found.append((rule[good], at[good], period[good]))
    if not found:
        return nothing, nothing, nothing
    rule, at, period = (np.concatenate(x) for x in zip(*found))
    low, high = g.start[rule], g.end[rule]
    right, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    top = len(words) - 1
    for level in range(len(levels) - 1, -1, -1):
        width, names = 1 << level, levels[level]
        x, y = at + right, at + period + right
        equal = (y + width <= high) & (names[np.minimum(x, top)] == names[np.minimum(y, top)])
        right += equal * width
        x, y = at - back - width, at + period - back - width
        equal = (x >= low) & (names[np.maximum(x, 0)] == names[np.maximum(y, 0)])
        back += equal * width
    start, end = at - back, at + period + right
    good = (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)) & (start < g.boundary[rule]) & (end > g.boundary[rule])
    crossing = np.unique(np.column_stack([rule, start - low, end - low, period])[good], axis=0)
    # to every place of the rule
    order = np.argsort(g.rule, kind="stable")
    lo, hi = (np.searchsorted(g.rule[order], crossing[:, 0], side) for side in ("left", "right"))
    many = hi - lo
    which = np.repeat(np.arange(len(crossing)), many)
    place = g.at[order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]]
    return _maximal(place + crossing[which, 1], place + crossing[which, 2], crossing[which, 3])


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Intervals of a period that no other of the same period contains: a run's parts lie in the run."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    group = np.cumsum(np.r_[0, period[1:] != period[:-1]]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + group)
    keep = np.r_[True, (end + group)[1:] > reach[:-1]]
    return start[keep], end[keep], period[keep]
