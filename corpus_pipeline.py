"""From raw documents to packed training sequences: each stage applies one operator and its decisions take effect.

Defined results of all stages: an empty table gives an empty result; columns other than those
of documents are ignored and not returned; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import id_filter
from quillgraph.llm.common import materialize
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.jaccard_join import jaccard_components
from quillgraph.llm.mixing import mix_sources, n_words
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.quality_classifier import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Rows that repeat are judged each; null and empty texts by an empty text's statistics; without labels all stay."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; of rows that repeat both id and text, one."""
    result = exact_dedup(docs)
    keyed = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    dropped = result.where("NOT kept").select("doc_id", "text_sha256")
    again = result.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256")
    table = materialize(dropped.unionByName(again), "dropped")
    rest = id_filter.without(keyed, table, "doc_id", "text_sha256")
    repeated = id_filter.within(keyed, materialize(again, "repeated"), "doc_id", "text_sha256")
    return rest.unionByName(repeated.dropDuplicates(["doc_id", "text_sha256"])).select(*COLUMNS)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, then text hash. Rows are told apart by id and text: an id may repeat with other texts."""
    keyed = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    node = F.xxhash64("doc_id", "text_sha256")
    groups = jaccard_components(docs.select(*COLUMNS).withColumn("doc_id", F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))))
    linked = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct(), "linked")
    linked = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    rows = materialize(keyed.select("doc_id", "text_sha256", node.alias("node")).join(linked, "node").select("component", "doc_id", "text_sha256"), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_sha256")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    dropped = rows.join(first, "component").where(order != F.col("first")).select("doc_id", "text_sha256")
    return id_filter.without(keyed, materialize(dropped, "dropped"), "doc_id", "text_sha256").select(*COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is taken; one that a source's budget cuts keeps its first words.

    Texts without a word have size 0 and are not taken; a null source is a source of its own; rows that repeat an id are
    told apart by size, then text, and each is taken as its own row.
    """
    taken = mix_sources(docs).groupBy("doc_id", "size").agg(F.sort_array(F.collect_list("taken")).alias("all_taken"))
    place = Window.partitionBy("doc_id", "size").orderBy("text")
    rows = docs.select(*COLUMNS).withColumn("size", n_words("text")).withColumn("place", F.row_number().over(place))
    rows = rows.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.size") == F.col("t.size")))
    rows = rows.select("d.*", F.get("all_taken", F.col("place") - 1).alias("taken")).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    rows = rows.withColumn("epoch", times).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
    cut = F.concat_ws(" ", F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"), 1, F.col("words").cast("int")))
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("words") < F.col("size"), F.length(cut)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Rows that repeat are packed each; an empty text is its end mark."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", dissimilar_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_documents),
]

#: Neither the classifier nor the packing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
