"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Lengths are taken in bands, long ones first, a round for each. In a round all documents of
the band and all gaps of open sequences stand in one order, by size downwards, gaps before
documents of the same size; empty sequences, as many as the band could need, stand before
them all. Read as brackets, a gap opens and a document closes: the document gets the
nearest gap before it that is still open, which is the smallest one left that is large
enough (its successor), and no gap is given twice. The height of a bracket comes from
prefix sums: running sums over size classes (2 x capacity at most) and salted ranks within
a class. Brackets of one height alternate, so a window by height finds every pair; the
conflict over a gap is resolved by rank. Gaps then shrink, and the next band's round
follows. A gap with room for several documents of the band stands in the order as several
gaps. Empty sequences are taken only where no gap is left, the last ones first, so all that
are opened are full of the band but one.

Defined results: a null text is an empty document (the end mark alone); rows that repeat are
packed each; longer documents are cut at the capacity, and only those; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import tokens
from quillgraph.llm.common import materialize, release_memory, text_runs

#: Rows of one size class that are ranked in one window.
RANKED = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1)):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, data in zip(ids, tokens.encode(texts, path)):
                data += end
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    for name, v in zip(out, (doc_id, k, a // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
        release_memory(keep_tokens=True)

    return run


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_cutter(vocabulary, capacity, end_id), PIECES)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(lo, hi] bounds of lengths, downwards. hi is capacity // k for k = 2 to 8, then for powers of two.

    As many as k documents of such a band fill an empty sequence but for what a shorter one can use.
    """
    ks = [2, 3, 4, 5, 6, 8]
    while ks[-1] * 2 < capacity:
        ks.append(ks[-1] * 2 if ks[-1] < 16 else ks[-1] * 4)
    tops = list(dict.fromkeys(capacity // k for k in ks if capacity // k > 0))
    return [(lo, hi) for hi, lo in zip(tops, [*tops[1:], 0])]


def _slots(gaps: DataFrame, lo: int, hi: int, wanted: int) -> DataFrame:
    """(seq, size): a gap of free tokens stands free // hi times, the last time with what is left over.

    Gaps with room for one document all stand; of the others, the smallest that hold the documents wanted.
    """
    room = gaps.where(F.col("free") > lo).withColumn("many", F.greatest(F.lit(1), F.floor(F.col("free") / hi)))
    classes = room.where("many > 1").groupBy("free").agg(F.sum("many").alias("n"))
    classes = classes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("free").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    most = classes.where(F.col("before") < wanted).agg(F.max("free")).first()[0] or 0  # a row per size at most
    room = room.where((F.col("many") == 1) | (F.col("free") <= most))
    each = F.explode(F.sequence(F.lit(1), F.col("many").cast("int")))
    size = F.when(F.col("slot") == F.col("many"), F.col("free") - (F.col("many") - 1) * hi).otherwise(F.lit(hi))
    return room.select("seq", "free", "many", each.alias("slot")).select("seq", size.cast("long").alias("size"), "slot")


def match_round(docs: DataFrame, slots: DataFrame, n_rows: int, empty: DataFrame, n_empty: int) -> DataFrame:
    """docs (item, length), slots (seq, size, slot) and empty (seq, height 1 to n_empty): the matches (item, length, seq) of all documents."""
    salts = max(1, min(1024, -(-n_rows // RANKED)))
    rows = docs.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("item").alias("id"), F.lit(0).alias("slot")).unionByName(
        slots.select("size", F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot")
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "slot"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("size", "kind", "salt").count()
    classes = counts.groupBy("size", "kind").agg(F.sum("count").alias("n"))  # 2 x capacity rows at most
    step = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    upto = F.sum(step).over(Window.orderBy(F.col("size").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0))
    classes = classes.select("size", "kind", (F.lit(n_empty) + upto - step).alias("before"))
    within = Window.partitionBy("size", "kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("count").over(within), F.lit(0))).join(classes, ["size", "kind"]).drop("count")
    rank = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id", "slot")) + F.col("first")
    height = F.when(F.col("kind") == 0, F.col("before") + rank).otherwise(F.col("before") - rank + 1)
    rows = rows.join(starts, ["size", "kind", "salt"]).select("kind", "id", "size", height.alias("height"))
    rows = rows.unionByName(empty.select(F.lit(0).alias("kind"), F.col("seq").alias("id"), F.lit(2**62).alias("size"), "height"))
    line = Window.partitionBy("height").orderBy(F.col("size").desc(), "kind")
    rows = rows.select("kind", "id", "size", F.lag("id").over(line).alias("seq"))
    return rows.where("kind = 1").select(F.col("id").alias("item"), F.col("size").alias("length"), "seq")


def best_fit_pack(items: DataFrame, capacity: int) -> DataFrame:
    """items (item, length) with distinct items, 0 or more, and lengths from 1 to capacity: (item, length, seq)."""
    spark = items.sparkSession
    alone = items.where(F.col("length") > capacity // 2).select("item", "length", F.col("item").alias("seq"))
    placed, opened = [alone], 0
    gaps = materialize(alone.where(F.col("length") < capacity).select("seq", (capacity - F.col("length")).alias("free")), "gaps")
    in_band = [(F.col("length") > lo) & (F.col("length") <= hi) for lo, hi in bands(capacity)]
    sizes = items.agg(*[F.count_if(b) for b in in_band]).first()
    for (lo, hi), band, n in zip(bands(capacity), in_band, sizes):
        if not n:
            continue
        each = capacity // hi  # documents of this band that an empty sequence takes for sure
        more = -(-n // each)
        empty = spark.range(more * each).select((-1 - opened - F.floor(F.col("id") / each)).alias("seq"), (F.col("id") + 1).alias("height"))
        got = match_round(items.where(band).select("item", "length"), _slots(gaps, lo, hi, n), n, empty, more * each)
        got = materialize(got, "matches")
        placed.append(got)
        used = got.groupBy("seq").agg(F.sum("length").alias("used"))
        old = gaps.join(used, "seq", "left").select("seq", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free"))
        new = used.where((F.col("seq") < -opened) & (F.col("seq") < 0)).select("seq", (capacity - F.col("used")).alias("free"))
        opened += more
        if hi > 1:
            gaps = materialize(old.unionByName(new).where("free > 0"), "gaps")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(cut_documents(docs, vocabulary, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = best_fit_pack(pieces.select("item", "length"), capacity)
    before = Window.partitionBy("seq").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.select("item", "seq", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return pieces.join(packed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
