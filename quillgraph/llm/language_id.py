"""Language identification by mixture inference.

A document is taken as a mixture of languages, each a distribution over hashed byte
trigrams. Expectation-maximisation finds the proportions; the set of languages is the one
with the best likelihood less a charge for each language, among the nested sets in order
of proportion. The language of the largest proportion in that set is predicted.

Trigram counts are summed over all learning rows; a table of (languages x BUCKETS) numbers
is all that a task needs, whatever the size of the corpus (16 kB a language; every value of
the language column is one). A letter is a character of a Unicode letter category.

Defined results: null texts and texts without a letter get `und` and score 0; rows with a
null language are not learnt from; without any learning row every text gets `und`; texts of
fewer than three bytes are padded; ties go to the language that sorts first; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, release_memory, utf8_view

BUCKETS = 4096
#: Bytes that are counted at a time; a longer text is counted in pieces.
STEP = 1 << 20


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte. ASCII capitals count as small letters; the last two are padded with spaces."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    wide = np.concatenate([low, np.full(2, 32, np.uint8)]).astype(np.uint32)
    code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(20)


def _rows(data: np.ndarray, offsets: np.ndarray):
    """Runs of rows of about STEP bytes: first row, and a matrix of counts (rows x BUCKETS)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, min(int(np.searchsorted(offsets, offsets[first] + STEP, "right") - 1), first + 256, n))
        counts = np.zeros((last - first) * BUCKETS, np.float32)
        for a in range(int(offsets[first]), int(offsets[last]), 4 * STEP):
            b = min(a + 4 * STEP, int(offsets[last]))
            size = np.diff(np.clip(offsets[first : last + 1], a, b))
            row = np.repeat(np.arange(last - first), size)
            counts += np.bincount(row * BUCKETS + _buckets(data[a:b]), minlength=len(counts))
        yield first, counts.reshape(-1, BUCKETS)
        first = last


def _count(batches):
    """Trigram counts of each language in this task: one row per language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        data, offsets = utf8_view(batch.column(1))
        for first, counts in _rows(data, offsets):
            here = langs[first : first + len(counts)]
            for lang in set(here):
                total.setdefault(lang, np.zeros(BUCKETS))
                total[lang] += counts[here == lang].sum(0, dtype=np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], names=["lang", "counts"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of the buckets (languages x BUCKETS)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, counts array<long>")
    summed = counts.select("lang", F.posexplode("counts").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "n")))["n"].alias("n")).orderBy("lang").collect()  # a row per language
    table = np.array([r["n"] for r in got], dtype=float).reshape(-1, BUCKETS) + 0.5
    return [r["lang"] for r in got], table / table.sum(1, keepdims=True)


def mixture(counts: np.ndarray, p: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) after EM steps from equal ones, and the log-likelihood. counts: rows x BUCKETS."""
    w = np.full((len(counts), len(p)), 1.0 / len(p), np.float32)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(steps):
        w = w * ((counts / (w @ p)) @ p.T) / size
    return w, (counts * np.log(w @ p)).sum(1)


def infer(counts: np.ndarray, p: np.ndarray, charge: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the main language of each row and its proportion in the set that the penalised likelihood selects."""
    p = p.astype(np.float32)
    single = counts @ np.log(p).T
    w, full = mixture(counts, p)
    order = np.argsort(-w, axis=1, kind="stable")
    cost = charge * np.log(np.maximum(counts.sum(1), 2))
    best, share = single.argmax(1), np.ones(len(counts))
    worth = single[np.arange(len(counts)), best] - cost
    for i in np.flatnonzero(full - 2 * cost > worth):  # the full mixture bounds every set of two or more
        value = worth[i]
        for k in range(2, len(p) + 1):
            if full[i] - k * cost[i] <= value:
                break
            chosen = np.sort(order[i, :k])
            seen = np.flatnonzero(counts[i])
            v, like = mixture(counts[i : i + 1, seen], p[np.ix_(chosen, seen)], 20)
            if like[0] - k * cost[i] > value:
                value, best[i], share[i] = like[0] - k * cost[i], chosen[v[0].argmax()], v[0].max()
    return best, share


def _predictor(langs: list[str], p: np.ndarray, charge: float):
    names = np.array([*langs, "und"], dtype=object)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            best, share = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            if langs:
                for first, counts in _rows(data, offsets):
                    best[first : first + len(counts)], share[first : first + len(counts)] = infer(counts, p, charge)
                blank = np.array([t is None or not any(map(str.isalpha, t)) for t in batch.column(1).to_pylist()], bool)
                best[blank], share[blank] = len(langs), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(share, 0, 1), pa.float64())], names=["doc_id", "lang_pred", "score"])
        release_memory()

    return run


def identify_languages(docs: DataFrame, folds: int = 5, held_out_fold: int = 0, charge: float = 3.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from the rows that are not held out; predictions see the text alone."""
    held_out = crc_mod("doc_id", folds) == held_out_fold
    langs, p = train(docs.where(~held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_predictor(langs, p, charge), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
