"""Global positions of rows, and answers of fixed batches laid beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.scratch import materialize

#: Fixed value: rows of a batch that a service answers at once.
BATCH = 500


def with_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `position`, 0 for the first in order: ranges are sorted each for itself and follow each other, so no task sees all rows.

    The order must tell rows apart. The sorted ranges are written, so that a task that runs again finds the same rows;
    one count a range reaches the driver.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _start long")  # one row a range
    return ranged.join(F.broadcast(offsets), "_range").withColumn("position", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def batched(rows: DataFrame, *order: str, size: int = BATCH) -> DataFrame:
    """Rows with batch and at: which request they go into, and where they stand in it."""
    return with_positions(rows, *order).withColumns({"batch": F.expr(f"position div {size}"), "at": (F.col("position") % size).cast("int")})


def zipped(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """asked (batch, at, ...) with `answer`: answers (batch, items) hold one item a row, in its place; null items, short answers and batches without an answer give null."""
    items = answers.select("batch", F.posexplode_outer("items").alias("at", "answer")).where("at IS NOT NULL")
    return asked.join(items, ["batch", "at"], "left")
