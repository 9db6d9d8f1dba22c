"""What tasks leave in a worker, and take at a time: workers outlive their stages, beside the executor's heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, models

from quillgraph.llm import id_filter, packing, quality_classifier, tokens
from quillgraph.llm.quality_classifier import CLASSES


def vocabulary(folder):
    path = str(folder / "words.json")
    Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]")).save(path)
    return path


def held():
    return tokens._chunks.cache_info().currsize


def test_token_caches_stay_for_the_stage_and_go_with_the_next(tmp_path):
    tokens.forget()
    docs = [pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})]
    cut = packing._cutter(vocabulary(tmp_path), 2048, 0)
    pieces = [b.to_pylist() for b in cut(docs)]
    assert held() == 1
    keep = quality_classifier._keeper({"base": 0.0, "depth": 1, "feature": [], "threshold": [], "value": []}, 1, 0.5)
    assert [b.num_rows for b in keep(docs)] == [1] and held() == 0
    assert [b.to_pylist() for b in cut(docs)] == pieces and held() == 1
    keys = [pa.RecordBatch.from_pydict({"text": ["a"], "_place": pa.array([5], pa.int64())})]
    assert [b.num_rows for b in id_filter._split(np.zeros(2, np.int64), False)(keys)] == [1] and held() == 0


def test_bytes_are_classed_in_small_steps():
    data = np.frombuffer((b"Some words, 12 of them!\n" * 400_000)[: 8 << 20], np.uint8)
    offsets = np.array([0, 100, 100, 3 << 20, len(data)], np.int64)
    tracemalloc.start()
    counts = quality_classifier._class_counts(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for row, a, b in zip(counts, offsets, offsets[1:]):
        assert row.tolist()[:-1] == [int(np.isin(data[a:b], np.frombuffer(c, np.uint8)).sum()) for c in CLASSES] and row.sum() == b - a
    assert peak < 32 << 20
