"""Personal data: base patterns, and spans that boosted trees pick among overlapping candidates.

Generators propose spans with high recall (written-out addresses, grouped numbers, codes);
trees score them by format and context; per-kind thresholds, calibrated by a rising fit on
held-out items, select redactions. Of picked spans that overlap, the likeliest stays, then
the longest, then the first. Base spans always stay, and nothing is added over them.

No table labels personal data, so the trees learn from `planted` items: made-up numbers,
addresses and look-alikes set into places of at most `contexts` texts (the rows whose ids
hash lowest). Training is bounded by these two parameters at any corpus size.

Defined results: a null text is empty and has no span; spans are in code points, end
exclusive; every text is scanned by every pattern, whole, however long; rows that repeat are scanned each; a null id stays
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import boosted_trees, pii_training
from quillgraph.llm.common import release_memory, text_runs
from quillgraph.llm.pii_candidates import KINDS, N_FEATURES, base_spans, candidates, features

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>"
#: Characters of a training context.
CONTEXT = 300


def train(docs: DataFrame, contexts: int = 2000, planted: int = 15_000, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: trees, and for each kind the steps of its probability and its threshold."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    place = F.pmod(F.xxhash64(t), F.greatest(F.length(t) - CONTEXT, F.lit(1))).cast("int")
    share = min(1.0, 4 * contexts / max(1, docs.count()))  # so that few more rows than are taken leave their tasks, with their pieces alone
    h = F.xxhash64(id_col, t)
    near = docs.where(F.pmod(h, F.lit(1 << 20)) < F.lit(share) * (1 << 20)).select(h.alias("h"), F.substring(t, place + 1, F.lit(CONTEXT)).alias("t"))
    found = near.orderBy("h", "t").limit(contexts).collect()  # `contexts` pieces of CONTEXT characters
    return pii_training.fit(sorted(r.t for r in found), planted, precision)


def _select(scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Of overlapping picks the likeliest, then longest, then first."""
    import bisect

    starts: list[int] = []
    taken: list[tuple[int, int, int, float]] = []
    ends: dict[int, int] = {}
    for p, k, s, e in sorted(scored, key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        at = bisect.bisect_left(starts, e)
        if at and ends[starts[at - 1]] > s:
            continue
        bisect.insort(starts, s)
        ends[s] = e
        taken.append((k, s, e, p))
    return taken


def scan_texts(texts: list[str], model: dict) -> list[list[tuple[int, int, int, bool, float]]]:
    """(kind's place, start, end, base, probability) of each text, by kind, then start."""
    base = [base_spans(t) for t in texts]
    proposed = [candidates(t, b) for t, b in zip(texts, base)]
    flat = [(i, c) for i, found in enumerate(proposed) for c in found]
    picked: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(flat), 1 << 14):
        part = flat[at : at + (1 << 14)]
        x = np.array([features(texts[i], *c) for i, c in part], float).reshape(-1, N_FEATURES)
        for (i, (k, s, e)), v in zip(part, boosted_trees.predict(model["trees"], x).tolist()):
            low, share, threshold = model["steps"][k]
            if v >= threshold:
                picked[i].append((float(share[np.searchsorted(low, v, "right") - 1]), k, s, e))
    return [sorted([(k, s, e, True, 1.0) for k, s, e in b] + [(k, s, e, False, p) for k, s, e, p in _select(c)]) for b, c in zip(base, picked)]


def redacted(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping base spans become one."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e, *_ in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scanner(model: dict, with_text: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = scan_texts(texts, model)
            spans = [[dict(zip(("kind", "start", "end", "base", "probability"), (KINDS[k], *rest))) for k, *rest in of] for of in found]
            columns = [batch.column(0), pa.array(spans, kind)]
            if with_text:
                columns.append(pa.array([redacted(t, of) for t, of in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][: len(columns)])
        release_memory()

    return run


def find_personal_data(docs: DataFrame, model: dict | None = None, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, whether of a base pattern, calibrated probability; by kind, then start), redacted text."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(model, with_text), f"doc_id long, spans {SPANS}" + (", redacted string" if with_text else ""))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end by kind, then start)."""
    found = find_personal_data(docs, with_text=False).withColumn("base", F.expr("filter(spans, s -> s.base)"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
