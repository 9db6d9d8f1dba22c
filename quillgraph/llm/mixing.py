"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents stand in key order;
distributed prefix sums of their sizes (sums of key ranges first, then within a range) say
where each begins, and the source is cut at its budget to the word. A budget above the
source's size repeats whole epochs first.

Defined results: a null text has size 0 and is never taken; a null source is a source of its
own and comes last; ties in key order fall back on id and size; rows that repeat are taken
as separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, materialize

#: Fixed values of the contract: weights in turn by source, share of all words, and largest number of epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Hex digits of the key that name a key range.
RANGE_DIGITS = 3


def n_words(text_col: str = "text"):
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, cut at most times the size, the excess reshared by weight.

    The resharing ends at one level for all sources that are not cut. Sorted by the level at
    which they are cut, the cut sources are a prefix, found with running sums.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % n + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    t = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns(
        {
            "budget": F.lit(share) * F.sum("source_size").over(whole),
            "cut_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The level that the sources from this one on would share if this were the first that is not cut.
    t = t.withColumn("common", (F.col("budget") - F.col("cut_before")) / F.col("weight_left"))
    t = t.withColumn("found", F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "cut_before", "common"))).over(whole)["common"])
    target = F.least(F.col("cap"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), and mix_key, the place in the source's order."""
    size = n_words(text_col)
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("mix_key")), "mix-sizes")
    rows = rows.withColumn("range", F.substring("mix_key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    started = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(started), F.lit(0)))
    ranges = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "range", "range_start", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = rows.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("range_start") - F.col("inside")))
    return out.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), "mix_key", F.col("d.source").alias("source"))
