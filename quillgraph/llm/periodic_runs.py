"""Periodic runs of words in documents, found on a Re-Pair grammar of the words.

A run is a maximal stretch of words with smallest period q and at least max(6, 4 q) words.
Within a run every five words come again q words later, so words that no repeated
five-gram near by covers are left out before the grammar is built: no run holds them.
Tasks take about 4 MB of text at a time; a longer text stands alone. No text moves.

Defined results: a null, empty or blank text has no words and no run; a null id keeps its
words as they are; very long texts are taken whole (about 100 bytes a word while their
names are held); rows that repeat are searched each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import release_memory, text_runs, utf8_view
from quillgraph.llm.repair_grammar import LEAST_PERIODS, _mixed, runs_in_strings

GRAM = 5
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the words that five-grams cover which come again, within their text, at a distance that a run's period may have."""
    n = len(ids) - GRAM + 1
    mask = np.zeros(len(ids) + 1, np.int64)
    if n < 2:
        return mask[:-1] > 0
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    h = _mixed(text[:n] + 1)
    for j in range(GRAM):
        h = _mixed(h ^ ids[j : n + j].astype(np.uint64))
    inside = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    a, b = order[:-1], order[1:]
    near = (h[a] == h[b]) & (b - a <= sizes[text[a]] // LEAST_PERIODS)
    at = np.unique(np.concatenate([a[near], b[near]]))
    np.add.at(mask, at, 1)
    np.add.at(mask, at + GRAM, -1)
    return np.cumsum(mask)[:-1] > 0


def find_in_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    number: dict = defaultdict(itertools.count().__next__)
    offsets = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(offsets[-1]))
    covered = _stretches(ids, offsets)
    covered_at = np.flatnonzero(covered)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(covered_at):
        text = np.searchsorted(offsets, covered_at, "right")
        last = np.r_[(np.diff(covered_at) > 1) | (np.diff(text) > 0), True]
        start, end, period = runs_in_strings(np.unique(ids[covered_at], return_inverse=True)[1], np.flatnonzero(last) + 1)
        of = np.searchsorted(offsets, covered_at[start], "right") - 1 if len(start) else start
        for i, s, n, q in zip(of.tolist(), covered_at[start].tolist(), (end - start).tolist(), period.tolist()):
            runs[i].append((s - int(offsets[i]), n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return list(itertools.compress(words, (np.cumsum(depth)[:-1] == 0).tolist()))


def _finder(prepare: Callable | None):
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in (part for b in batches for part in text_runs(b, 1)):
            data, offsets = utf8_view(batch.column(1))
            blob, ids = data.tobytes(), batch.column(0).to_pylist()
            texts = [blob[a:b].split() for a, b in zip(offsets[:-1], offsets[1:])]  # bytes split at the six ASCII blanks alone
            if prepare is not None:
                texts = [prepare(i, w) for i, w in zip(ids, texts)]
            runs = find_in_texts(texts)
            flat = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(kind.value_type)))
            kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), lists, kept], names=["doc_id", "n_words", "runs", "collapsed"])
        release_memory()

    return run


def periodic_runs(docs: DataFrame, prepare: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without repeats of periods.

    `prepare` gets an id and a text's words and returns the words to search.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_finder(prepare), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def cycled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: one text in ten goes round in a cycle of words from some place on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs(docs, cycled)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    rows = rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"), "runs_sha256", "collapsed_sha256")
    return rows.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
