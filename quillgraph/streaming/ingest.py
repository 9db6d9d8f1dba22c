"""Streaming ingest of references and citations (an extension: the batch model has only re-runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import normalize as N


def unseen_works(stream: DataFrame, works: DataFrame) -> DataFrame:
    """Streamed records (title, doi, oa_id, s2_id) whose key is no work's yet, with the key."""
    keyed = stream.withColumn("key", N.node_key("doi", "oa_id", "s2_id", "title"))
    return keyed.join(works.select("key"), "key", "left_anti")


def citation_windows(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Streamed citations (ts, dst) counted by cited work and window; later ones than `late` are dropped with their state."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "dst").count().select(F.col("window.start").alias("start"), "dst", F.col("count").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events (ts, user_id) with no gap longer than `gap`."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").count().select("user_id", F.col("session_window.start").alias("start"), F.col("count").alias("n"))
