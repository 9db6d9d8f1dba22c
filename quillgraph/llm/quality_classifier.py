"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are learnt on the driver from at most `max_train` labelled rows (those whose ids
hash lowest), a documented bound that keeps training small at any corpus size. Statistics
of the whole text of every document are computed and scored in Arrow batches.

Defined results: null and empty texts get the score of an empty text's statistics; labels
that repeat for an id count once (the larger one), null labels not at all; without any
label the score is 0.5; of rows that repeat a labelled id one text is learnt from; rows that repeat are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import boosted_trees
from quillgraph.llm.common import crc_mod, release_memory, text_runs, utf8_view

#: Byte classes that are counted, each by its share of the text's bytes.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\f\r", b".,;:?'\"()", b"!", b"|", b"#*$%&<>", b"/\\@_=+-[]{}~^`", bytes(range(128, 256)))
N_FEATURES = len(CLASSES) + 9
#: Bytes that are classed at a time.
STEP = 1 << 19


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for k, c in enumerate(CLASSES):
        table[np.frombuffer(c, np.uint8)] = k
    return table


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class by row; rows are taken in runs of about STEP bytes, longer rows in pieces."""
    table, width = _class_table(), len(CLASSES) + 1
    out = np.zeros((len(offsets) - 1) * width, np.int64)
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        sizes = np.diff(np.clip(offsets[first : last + 1], a, b))
        rows = np.repeat(np.arange(last - first), sizes)
        out[first * width : last * width] += np.bincount(rows * width + table[data[a:b]], minlength=(last - first) * width)
    return out.reshape(-1, width)


def _word_features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 8
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    threes = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    short = sum(map((1).__eq__, map(len, words)))
    return [np.log1p(n), distinct / n, threes, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), short / n, sum(map(str.isupper, words)) / n, max(map(len, words))]


def document_features(texts: pa.Array) -> np.ndarray:
    data, offsets = utf8_view(texts)
    counts = _class_counts(data, offsets)
    size = np.diff(offsets)
    shares = counts[:, : len(CLASSES)] / np.maximum(size, 1)[:, None]
    rest = np.array([_word_features(t or "") for t in texts.to_pylist()], dtype=float).reshape(-1, 8)
    mean_word = (size - counts[:, 3]) / np.maximum(np.expm1(rest[:, 0]), 1)
    return np.column_stack([shares, rest, mean_word])


def _featurize(batches):
    release_memory()  # of earlier stages
    for batch in (part for b in batches for part in text_runs(b, 0)):
        x = document_features(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "y", "doc_id", "h"])
    release_memory()


def _scorer(model: dict):
    def run(batches):
        release_memory()  # of earlier stages
        for batch in (part for b in batches for part in text_runs(b, 1)):
            score = boosted_trees.predict(model, document_features(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])
        release_memory()

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> dict:
    """Fit on the max_train labelled ids with the lowest hashes, each with one text: of rows that repeat an id, the text with the lowest hash."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # max_train ids at most
    found = rows.select("text", "y", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).mapInArrow(_featurize, "x array<double>, y double, doc_id long, h long")
    one = found.groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("r.x", "r.y")
    got = one.orderBy("y", "x").toPandas()  # a fixed order, nothing is cut
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return boosted_trees.fit(x, got["y"].to_numpy(float), **options)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scorer(model), "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels are learnt only from rows that are not held out."""
    held_out = crc_mod("doc_id", folds) == held_out_fold
    model = train(docs, labels.where(~held_out), max_train)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keeper(model: dict, at: int, threshold: float):
    def run(batches):
        release_memory()  # of earlier stages
        for batch in (part for b in batches for part in text_runs(b, at)):
            score = boosted_trees.predict(model, document_features(batch.column(at))) if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array(score >= threshold))
        release_memory()

    return run


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, max_train: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject. Scored where they are read: no shuffle."""
    model = train(docs, labels.where(crc_mod("doc_id", folds) != held_out_fold), max_train)
    return docs.mapInArrow(_keeper(model, docs.columns.index("text"), threshold), docs.schema)
