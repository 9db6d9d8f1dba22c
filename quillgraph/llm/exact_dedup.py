"""Exact duplicates through an extendible-hash index on shared files.

Rows are hashed; a directory of hash prefixes doubles until no bucket holds more than
`capacity` rows (or the prefix is at its longest; then the bucket's chain overflows). The
index is a Parquet table in the shared folder, one row for the equal texts of a batch.
Owner tasks read contiguous bucket ranges in hash order and walk each chain, comparing the
bytes, so equal hashes of different texts stay apart. Only one text of each chain link is
held at a time, however many rows share it, and the ids of a group are never gathered:
each index row keeps its own ids, and classes are joined back to index rows.

Defined results: a null text counts as empty; a null id is never kept over another id; rows
that repeat id and text are all of one group, and all rows with the kept id are marked kept;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, partitions, release_memory, text_or_empty

#: The longest prefix in bits: the directory has 2**MAX_DEPTH slots at most.
MAX_DEPTH = 16


def build_directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bucket number of each slot of the full-depth directory, and the number of buckets.

    counts holds the rows of each prefix of MAX_DEPTH bits. A bucket that overflows is split
    on its next bit; when its local depth equals the global depth the directory doubles.
    """
    depth, slots = 0, [(0, 0)]  # per slot: first full-depth prefix of its bucket, local depth
    sums = np.concatenate([[0], np.cumsum(counts)])
    size = lambda first, local: sums[first + (1 << (MAX_DEPTH - local))] - sums[first]
    while True:
        over = {b for b in slots if size(*b) > capacity and b[1] < MAX_DEPTH}
        if not over:
            break
        if any(local == depth for _, local in over):
            slots, depth = [b for b in slots for _ in (0, 1)], depth + 1
        at = lambda i: i << (MAX_DEPTH - depth)
        slots = [(b[0] + (1 << (MAX_DEPTH - b[1] - 1)) * (at(i) >= b[0] + (1 << (MAX_DEPTH - b[1] - 1))), b[1] + 1) if b in over else b for i, b in enumerate(slots)]
    number = {b: i for i, b in enumerate(sorted(set(slots)))}
    full = np.repeat([number[b] for b in slots], 1 << (MAX_DEPTH - depth))
    return full.astype(np.int32), len(number)


def _collapse(directory: np.ndarray):
    """Map side: one index row for the equal texts of each batch."""
    names = ["bucket", "hash", "text", "sha256", "top_id", "n", "ids"]

    def run(batches):
        for batch in batches:
            ids, texts, hashes = (batch.column(i) for i in range(3))
            groups: dict = {}
            for i, t in enumerate(texts):
                groups.setdefault(t.as_buffer().to_pybytes(), []).append(i)
            ids, hashes = ids.to_pylist(), hashes.to_numpy()
            first = [g[0] for g in groups.values()]
            h = hashes[first]
            members = [[ids[i] for i in g] for g in groups.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(directory[(h.view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int64)], pa.int32()),
                    pa.array(h, pa.int64()),
                    pa.array(list(groups), pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in groups], pa.string()),
                    pa.array([max((i for i in m if i is not None), default=None) for m in members], pa.int64()),
                    pa.array([len(m) for m in members], pa.int64()),
                    pa.array(members, pa.list_(pa.int64())),
                ],
                names=names,
            )
        release_memory()

    return run


def _chain(batches):
    """Owner: rows come in hash order; every row gets the entry id of the first row with the same bytes."""
    key, chain = None, {}
    for batch in batches:
        entries, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts, out = batch.column(2), []
        for i, (e, h) in enumerate(zip(entries, hashes)):
            if h != key:
                key, chain = h, {}
            t = texts[i].as_buffer().to_pybytes()
            for other, link in chain.items():
                if link == t:
                    out.append(other)
                    break
            else:
                chain[e] = t
                out.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(out, pa.int64())], names=["entry", "class_entry"])
    release_memory()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    prefix = F.shiftrightunsigned("hash", 64 - MAX_DEPTH).cast("int")
    counts = np.zeros(1 << MAX_DEPTH, np.int64)
    for p, n in rows.groupBy(prefix.alias("p")).count().collect():  # 2**MAX_DEPTH rows at most
        counts[p] = n
    directory, n_buckets = build_directory(counts, capacity)
    index = rows.select("id", F.col("text").cast("binary").alias("text"), "hash").mapInArrow(
        _collapse(directory), "bucket int, hash long, text binary, sha256 string, top_id long, n long, ids array<long>"
    )
    index = materialize(index.withColumn("entry", F.monotonically_increasing_id()), "hash-index")
    owners = max(1, min(n_buckets, partitions(spark)))
    owner = F.floor(F.col("bucket") * owners / n_buckets).cast("int")
    chained = (
        index.select("entry", "hash", "text", owner.alias("owner"), "bucket")
        .repartitionById(owners, "owner")
        .sortWithinPartitions("bucket", "hash", "entry")
        .select("entry", "hash", "text")
        .mapInArrow(_chain, "entry long, class_entry long")
    )
    members = materialize(chained.join(index.select("entry", "top_id", "n"), "entry"), "hash-classes")
    classes = members.groupBy("class_entry").agg(F.max("top_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return (
        members.select("entry", "class_entry")
        .join(classes, "class_entry")
        .join(index.select("entry", "sha256", "ids"), "entry")
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))
    )
