"""Writers: versioned tables with a pointer, a commit gate, key lists, worklists, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, commit: bool = True) -> str | None:
    """Write a new version beside the old ones and then point to it; without commit nothing is written. Older versions are the snapshots."""
    if not commit:
        return None
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{root}/versions")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The version written last."""
    files = spark.read.schema("version string").json(f"{root}/versions").select("version", F.col("_metadata.file_modification_time").alias("at"))
    return spark.read.parquet(files.orderBy(F.col("at").desc()).first()["version"])


def write_keys(df: DataFrame, path: str) -> None:
    df.select(F.col("key").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_worklist(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def markdown_lines(df: DataFrame, *columns: str) -> DataFrame:
    """One Markdown table row per row; written with write.text, so a report of any size stays distributed."""
    cells = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" ")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
