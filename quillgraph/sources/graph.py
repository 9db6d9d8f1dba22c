"""Readers of the literature graph's files and of recorded service answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import normalize as N

NODE = "title string, authors array<string>, year int, venue string, abstract string, abstract_source string, doi string, oa_id string, s2_id string, citations long, hop int, is_seed boolean, work_type string, is_review boolean"
GRAPH = f"nodes map<string, struct<{', '.join(f.replace(' ', ': ', 1) for f in NODE.split(', '))}>>, scores map<string, struct<score: int, reason: string, deferred: boolean>>, edges array<struct<`from`: string, `to`: string, hop: int>>"
ISSUES = "description string, depth_scale map<string, string>, issues array<struct<id: string, label: string, question: string, weight: double, core: boolean>>"
MATRIX = "rows array<struct<key: string, title: string, authors: array<string>, year: int, score: int, text_source: string, scores: map<string, int>, note: string, is_review: boolean, score_error: boolean>>"


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """works, relevance and edges of a graph file, each with its order. The file is one JSON value, so it is read by one task; write Parquet from it."""
    raw = spark.read.schema(GRAPH).json(path, multiLine=True)
    works = raw.select(F.posexplode(F.map_entries("nodes")).alias("ord", "e")).select(F.col("e.key").alias("key"), F.col("ord").cast("long").alias("ord"), "e.value.*")
    scores = raw.select(F.explode("scores").alias("key", "v")).select("key", "v.*")
    edges = raw.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.hop", F.col("ord").cast("long").alias("ord"))
    return {"works": works, "relevance": scores, "edges": edges}


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ISSUES).json(path, multiLine=True)
    return raw.select(F.posexplode("issues").alias("ord", "i")).select(F.col("i.id").alias("issue_id"), "i.label", "i.question", F.coalesce("i.weight", F.lit(1.0)).alias("weight"), F.coalesce("i.core", F.lit(True)).alias("core"), "ord")


def read_depth_scale(spark: SparkSession, path: str) -> DataFrame:
    """(depth, meaning) of an issues file."""
    raw = spark.read.schema(ISSUES).json(path, multiLine=True)
    return raw.select(F.explode("depth_scale").alias("depth", "meaning")).select(F.col("depth").try_cast("int").alias("depth"), "meaning")


def flat_openalex(works: DataFrame) -> DataFrame:
    """Records of the works service as flat rows: six authors at most, blanks for what is missing."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    authors = F.transform(F.slice(F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), 1, 6), lambda a: blank(a["author"]["display_name"]))
    return works.select(blank(F.col("title")).alias("title"), authors.alias("authors"), F.col("publication_year").alias("year"), blank(F.col("primary_location.source.display_name")).alias("venue"), blank(F.col("doi")).alias("doi"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), blank(F.col("id")).alias("oa_id"))


def flat_s2(papers: DataFrame) -> DataFrame:
    """Records of the papers service as flat rows; its DOI as a link."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    authors = F.transform(F.slice(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), 1, 6), lambda a: blank(a["name"]))
    doi = F.when(blank(F.col("externalIds.DOI")) != "", F.concat(F.lit("https://doi.org/"), F.col("externalIds.DOI"))).otherwise("")
    return papers.select(blank(F.col("title")).alias("title"), authors.alias("authors"), "year", blank(F.col("venue")).alias("venue"), doi.alias("doi"), F.coalesce("citationCount", F.lit(0)).alias("cited_by_count"), blank(F.col("paperId")).alias("s2_id"))


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that may not be there yet: then it is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).format(fmt).load(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, MATRIX, "json").select(F.explode("rows").alias("r")).select("r.*")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """stem and text of every .txt file."""
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", F.input_file_name().alias("file"))
    return rows.select(F.regexp_extract(F.url_decode("file"), r"([^/]+)\.txt$", 1).alias("stem"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path and html of every saved page; bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder)
    return rows.select(F.col("path").alias("page_id"), F.decode("content", "UTF-8").alias("html"))


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in worklist: quoted cells may hold line ends; one row for each of the keys in a row."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    return rows.withColumn("key", F.explode_outer(F.filter(F.split("sibling_node_keys", r"\|"), lambda k: F.trim(k) != "")))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''")


def parse_openalex(raw: DataFrame) -> DataFrame:
    """Recorded works of the service (nested) as works: at most six authors, abstract from the inverted index."""
    authors = F.slice(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), 1, 6)
    return raw.select(
        F.replace(F.coalesce("id", F.lit("")), F.lit("https://openalex.org/"), F.lit("")).alias("oa_id"), N.doi_lower_trimmed(F.coalesce("doi", F.lit(""))).alias("doi"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"), N.inverted_index_text("abstract_inverted_index").alias("abstract"), F.col("publication_year").alias("year"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("venue"), authors.alias("authors"), F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.lit(None).cast("string").alias("s2_id"),
    )


def parse_s2(raw: DataFrame) -> DataFrame:
    authors = F.slice(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), 1, 6)
    return raw.select(
        F.coalesce("paperId", F.lit("")).alias("s2_id"), N.doi_lower_trimmed(F.coalesce("externalIds.DOI", F.lit(""))).alias("doi"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("abstract", F.lit(""))).alias("abstract"), "year", F.coalesce("venue", F.lit("")).alias("venue"), authors.alias("authors"), F.coalesce("citationCount", F.lit(0)).alias("citations"), F.lit(None).cast("string").alias("oa_id"),
    )
