"""Removal of long repeated byte strings by suffix arrays.

Every window of `window` bytes has an anchor: the place in it whose ANCHOR bytes hash
lowest, the leftmost of equals. Equal windows have equal anchors, so windows meet by the
hash of their anchor, wherever they stand. Neighbouring windows with one anchor form a run,
kept as one row: anchor hash, hash of the run's bytes, document, place.

- An anchor seen once: none of its windows repeats.
- An anchor whose runs are all equal: all of its windows repeat. So copies of a text, however
  many, meet only in counts that combine before the shuffle.
- Otherwise one run of each kind goes to the shard of its anchor. A shard's suffix array and
  common prefixes show which windows of different runs are equal. Anchors with very many
  kinds of runs are split over several shards, and their windows' digests are merged across
  shards by binary search.

Removed bytes are the union of the repeated windows.

Defined results: a null text is empty; a text shorter than the window loses nothing; rows
that repeat count as other places, so each loses all windows; an empty table gives an empty
result; other columns are ignored. Runs of bytes are told apart by 64-bit hashes beside the
anchor's 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import id_filter
from quillgraph.llm.common import join_counted, materialize, partitions, release_memory, remove, text_or_empty, utf8_view
from quillgraph.llm.shingles import mix
from quillgraph.llm.suffix_array import common_prefixes, concatenate, suffix_array

U = np.uint64
ANCHOR = 48
#: Stands for a null id within the operator.
NO_ID = -(2**63)
#: Bits of a place within a piece of text that is searched at a time.
PLACE = 20
#: Bits of the filter of anchors, a fixed size.
ANCHOR_BITS = 25
#: Runs in a suffix array, and kinds of runs of one anchor in a shard.
SHARD_RUNS = 2_000

_RANDOM = np.random.default_rng(77)
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=U)
BASE = 0xD6E8FEB86659FD93
RUNS = "anchor long, content long, doc_id long, text_hash long, start int, n int"
SPANS = "kind int, doc_id long, text_hash long, start int, stop int, high long, low long, shard int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, U(b), U))]) for b in (BASE, pow(BASE, -1, 2**64)))


def anchored_runs(data: np.ndarray, window: int, powers) -> tuple[np.ndarray, ...]:
    """Of the windows that start at each byte of data but the last window - 1: anchors' places and hashes, and sums for hashes of any part."""
    power, back = powers
    n = len(data)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * power[:n])])
    m = n - ANCHOR + 1
    hashes = mix((sums[ANCHOR:] - sums[:m]) * back[:m])
    low = (hashes & ~U((1 << PLACE) - 1)) | np.arange(m, dtype=U)
    width, span = window - ANCHOR + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & U((1 << PLACE) - 1)).astype(np.int64), hashes, sums


def _pieces(offsets: np.ndarray, window: int):
    """Byte ranges (a, b) of about 2**PLACE bytes. A long text is cut into ranges that overlap by window - 1 bytes."""
    most, first, rows = (1 << PLACE) - 1, 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        if last > first:
            yield int(offsets[first]), int(offsets[last])
            first = last
        else:
            a, end = int(offsets[first]), int(offsets[first + 1])
            while a < end:
                yield a, min(a + most, end)
                a = a + most - window + 1 if a + most < end else end
            first += 1


def _find_runs(window: int):
    def run(batches):
        powers = _powers(1 << PLACE)
        names = ["anchor", "content", "doc_id", "text_hash", "start", "n"]
        for batch in batches:
            ids, text_hashes = batch.column(0), batch.column(2)
            data, offsets = utf8_view(batch.column(1))
            for a, b in _pieces(offsets, window):
                if b - a < window:
                    continue
                place, hashes, sums = anchored_runs(data[a:b], window, powers)
                starts = np.arange(len(place))
                row = np.searchsorted(offsets, starts + a, "right") - 1
                ok = np.flatnonzero(starts + a + window <= offsets[row + 1])
                if not len(ok):
                    continue
                place, row = place[ok], row[ok]
                fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(ok) != 1) | (row[1:] != row[:-1])])
                first = np.flatnonzero(fresh)
                n = np.diff(np.append(first, len(ok)))
                s0, place, row = ok[first], place[first], row[first]
                content = mix((sums[s0 + n - 1 + window] - sums[s0]) * powers[1][s0] + n.astype(U))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[place].view(np.int64)), pa.array(content.view(np.int64)), ids.take(at), text_hashes.take(at), pa.array((s0 + a - offsets[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=names
                )
        release_memory()

    return run


def _filtered(table: np.ndarray, column: int, keep: bool = True):
    def run(batches):
        for batch in batches:
            got = id_filter.passes(table, batch.column(column).to_numpy())
            yield batch.filter(pa.array(got if keep else ~got))
        release_memory()

    return run


def _cut_runs(window: int):
    """Rows (runs of a document, its text): the bytes of each run."""

    def run(batches):
        names = ["anchor", "salt", "salts", "many", "doc_id", "text_hash", "start", "n", "bytes"]
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text_hash, runs, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                data = text.as_buffer().to_pybytes()
                for r in runs:
                    part = data[r["start"] : r["start"] + r["n"] - 1 + window]
                    for column, v in zip(out, (r["anchor"], r["salt"], r["salts"], r["many"], doc_id, text_hash, r["start"], r["n"], part)):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def repeated_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place of the joined strings: whether its window stands at another place too, and whether it is the first of its equals; and where strings begin."""
    text, starts = concatenate(strings)
    order, rank = suffix_array(text)
    same = common_prefixes(text, starts, order, rank) >= window
    repeated, first = np.zeros(len(text), bool), np.ones(len(text), bool)
    repeated[order[:-1][same[:-1]]] = True
    repeated[order[1:][same[:-1]]] = True
    first[order[1:][same[:-1]]] = False
    return repeated, first, starts


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _shard(window: int):
    """Rows come by anchor and salt: suffix arrays of SHARD_RUNS runs or a few more, never cut within an anchor's shard."""

    def solve(rows: list[tuple]):
        out = [[] for _ in range(8)]
        repeated, first, starts = repeated_windows([r[8] for r in rows], window)
        for (anchor, salt, salts, many, doc_id, text_hash, start, n, data), s in zip(rows, starts):
            flags = repeated[s : s + n]
            if many == 1:
                for a, b in _runs_of(flags):
                    for column, v in zip(out, (0, doc_id, text_hash, start + a, start + b - 1 + window, 0, 0, 0)):
                        column.append(v)
            if salts > 1:
                for a in np.flatnonzero(first[s : s + n]).tolist():
                    d = xxhash.xxh3_128_digest(data[a : a + window])
                    high, low = (int.from_bytes(x, "big", signed=True) for x in (d[:8], d[8:]))
                    open_ = many == 1 and not flags[a]
                    for column, v in zip(out, (1 if open_ else 2, doc_id, text_hash, start + a, start + a + window, high, low, salt)):
                        column.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    def run(batches):
        rows, key = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[:2] != key and len(rows) >= SHARD_RUNS:
                    yield solve(rows)
                    rows = []
                key = row[:2]
                rows.append(row)
        if rows:
            yield solve(rows)
        rows.clear()
        release_memory()

    return run


def _merge(batches):
    """Windows of split anchors, those of one digest together: an open window that a binary search finds twice or more in the merged digests repeats."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    high, low, kind = (t.column(c).to_numpy() for c in ("high", "low", "kind"))
    digest = np.empty(len(high), [("h", np.int64), ("l", np.int64)])
    digest["h"], digest["l"] = high, low
    merged = np.sort(digest)
    mine = digest[kind == 1]
    twice = np.searchsorted(merged, mine, "right") - np.searchsorted(merged, mine, "left") >= 2
    at = pa.array(np.flatnonzero(kind == 1)[twice])
    yield from t.select(["doc_id", "text_hash", "start", "stop"]).take(at).to_batches()


def _join_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _remove_spans(batches):
    """Rows (id, text, spans or null): what is removed, and the digest of what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = [[] for _ in names]
        lists = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        data, offsets = utf8_view(batch.column(1))
        blob = memoryview(data)
        for i, (doc_id, spans) in enumerate(zip(batch.column(0).to_pylist(), lists)):
            text = blob[offsets[i] : offsets[i + 1]]
            gone = _join_spans((s["start"], s["stop"]) for s in spans or ())
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            for column, v in zip(out, (doc_id, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest())):
                column.append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())], names=names)
    release_memory()


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """rows (doc_id, text, text_hash): spans (doc_id, text_hash, start, stop) in bytes whose windows all repeat."""
    spark = rows.sparkSession
    n = max(1, partitions(spark))
    runs = materialize(rows.select("doc_id", "text", "text_hash").mapInArrow(_find_runs(window), RUNS), "runs")
    seen = runs.groupBy("anchor").agg(F.count("*").alias("total"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("total > 1")
    seen = materialize(seen.select("anchor", "total", (F.col("c0") != F.col("c1")).alias("mixed")), "anchors")
    table = id_filter.build(seen, "anchor", bits=ANCHOR_BITS)
    met = runs.withColumn("at", id_filter.place("anchor", bits=ANCHOR_BITS)).mapInArrow(_filtered(table, 6), RUNS + ", at long").drop("at")
    met = materialize(met, "likely-repeated")
    remove(runs)
    met = materialize(join_counted(met, seen, ["anchor"], "total", "mixed"), "repeated-anchors")
    mixed = met.where("mixed").drop("mixed")
    kinds = mixed.groupBy("anchor", "content").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("one"))
    kinds = materialize(kinds, "kinds")
    whole = met.where("NOT mixed").select("doc_id", "text_hash", "start", "n")
    copied = join_counted(mixed, kinds.where("many > 1"), ["anchor", "content"], "many").select("doc_id", "text_hash", "start", "n")
    whole = whole.unionByName(copied).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop"))
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumn("salts", F.ceil(F.col("kinds") / SHARD_RUNS).cast("int"))
    placed = join_counted(kinds, materialize(crowd, "crowds"), ["anchor"], "kinds", "salts").withColumn("salt", F.pmod(F.xxhash64("content"), F.col("salts")).cast("int"))
    asked = placed.select("one.*", F.struct("anchor", "salt", "salts", "many", F.col("one.start").alias("start"), F.col("one.n").alias("n")).alias("run"))
    asked = materialize(asked.groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("runs")), "asked")
    # Texts of documents that hold such runs alone are shuffled.
    holders = id_filter.build(asked, "doc_id", "text_hash")
    texts = rows.select("doc_id", "text", "text_hash", id_filter.place("doc_id", "text_hash").alias("at")).mapInArrow(_filtered(holders, 3), "doc_id long, text string, text_hash long, at long")
    texts = texts.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    held = asked.join(texts.dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "runs", "text")
    cut = held.mapInArrow(_cut_runs(window), "anchor long, salt int, salts int, many long, doc_id long, text_hash long, start int, n int, bytes binary")
    sharded = cut.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "start").mapInArrow(_shard(window), SPANS)
    sharded = materialize(sharded, "shard-spans")
    split = sharded.where("kind > 0").repartition(n, "high").select("kind", "doc_id", "text_hash", "start", "stop", "high", "low")
    merged = split.mapInArrow(_merge, "doc_id long, text_hash long, start int, stop int")
    return whole.unionByName(sharded.where("kind = 0").select("doc_id", "text_hash", "start", "stop")).unionByName(merged)


def suffix_dedup(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every byte under a window that starts anywhere else too is removed."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows, window)
    # Rows that repeat a text under one id have the same spans: a set, so that they do not add up.
    per_doc = materialize(spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    table = id_filter.build(per_doc, "doc_id", "text_hash")
    placed = rows.select("doc_id", "text", "text_hash", id_filter.place("doc_id", "text_hash").alias("at"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kind = "doc_id long, text string, text_hash long, at long"
    clean = placed.mapInArrow(_filtered(table, 3, keep=False), kind).select("doc_id", "text").mapInArrow(_remove_spans, out)
    hit = placed.mapInArrow(_filtered(table, 3), kind).alias("d").join(per_doc.alias("s"), (F.col("d.doc_id") == F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    done = clean.unionByName(hit.select("d.doc_id", "text", "spans").mapInArrow(_remove_spans, out))
    return done.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
