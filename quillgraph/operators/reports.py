"""Reports as DataFrames: what the Markdown reports list and count, ready for `sinks.markdown_lines`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import normalize as N
from quillgraph.functions import predicates as P


def candidates(works: DataFrame, relevance: DataFrame, least: int = 3) -> DataFrame:
    """Works by score and citations, with a link; order by score, citations, key."""
    rows = works.join(relevance.where(F.col("score") >= least).select("key", "score"), "key")
    return rows.select("key", "score", "citations", "title", "year", P.link_of("doi", "oa_id", "s2_id").alias("url"))


def candidate_counts(works: DataFrame, relevance: DataFrame) -> DataFrame:
    """Works and abstracts by score and hop, with subtotals (null stands for all)."""
    rows = works.join(relevance.select("key", "score"), "key")
    return rows.cube("score", "hop").agg(F.count("*").alias("n"), F.count_if(P.has_text("abstract")).alias("with_abstract"))


def best_per_issue(listed: DataFrame, n: int = 25) -> DataFrame:
    """The first n works of each issue by depth, score and key."""
    w = Window.partitionBy("issue_id").orderBy(F.col("depth").desc(), F.col("score").desc(), F.col("key"))
    return listed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def backfill_counts(resolved: DataFrame) -> DataFrame:
    """Values found by source, and missing ones."""
    return resolved.groupBy(F.coalesce("source", F.lit("missing")).alias("source")).agg(F.count("*").alias("n"))


def overlooked(cocited: DataFrame) -> DataFrame:
    """Absent texts by how many sources cite them: once, or more often."""
    return cocited.groupBy(F.when(F.col("cocite") >= 2, "cocited").otherwise("single").alias("lane")).agg(F.count("*").alias("n"), F.max("cocite").alias("most"))


def books(works: DataFrame, parents: DataFrame) -> DataFrame:
    """Kinds of books, and chapters with and without a parent among the works."""
    kinds = works.where("work_type = 'book'").groupBy(P.book_kind("title").alias("kind")).agg(F.count("*").alias("n"))
    linked = works.where("work_type = 'book-chapter'").join(parents.select("key", F.lit(True).alias("linked")), "key", "left")
    chapters = linked.groupBy(F.when(F.col("linked"), "chapter with parent").otherwise("chapter").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(chapters)


def best_per_title(rows: DataFrame, by_score: bool = True) -> DataFrame:
    """One row for each lower-case title: the best text source, then (unless by source alone) the score, then the first.

    rows: title, text_source, score, ord. A null title is empty, a null score 0.
    """
    worth = [N.source_rank("text_source").alias("source"), *([F.coalesce("score", F.lit(0)).alias("score")] if by_score else [])]
    keyed = rows.withColumn("_title", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    # An aggregate combines before the shuffle, so a title that many rows share is no heavy group.
    best = keyed.groupBy("_title").agg(F.max(F.struct(*worth, (-F.col("ord")).alias("first"))).alias("best")).select((-F.col("best.first")).alias("ord"), F.col("_title"))
    return keyed.join(best, ["_title", "ord"], "left_semi").drop("_title")


def most_cited(rows: DataFrame, cited: str, k: int) -> DataFrame:
    """The k rows cited most, a missing count as 0; the rows' own order breaks ties."""
    return rows.orderBy(F.coalesce(cited, F.lit(0)).desc(), "ord").limit(k)


def distinct_openings(notes: DataFrame, length: int = 80) -> DataFrame:
    """notes (doc_id, pos, body): in each text the first of the notes that open alike."""
    first = notes.groupBy("doc_id", F.substring("body", 1, length).alias("opening")).agg(F.min(F.struct("pos", "body")).alias("n"))
    return first.select("doc_id", "n.pos", "n.body")


def scoring_order() -> list:
    """Works to score: by score, then title."""
    return [F.coalesce("score", F.lit(0)).desc(), F.col("title"), F.col("key")]


def overlooked_order() -> list:
    """Absent texts: the most cited together first, then the latest."""
    return [F.col("cocite").desc(), F.coalesce("year", F.lit(0)).desc(), F.col("ident")]


# ── Reports of the worklists and the audit, as tables ────────────────────────
def _link(rows: DataFrame):
    return P.link_of("doi", "oa_id", "s2_id")


def triage_report(surfaced: DataFrame, works: DataFrame) -> DataFrame:
    """surfaced (key, lane, indeg, score, title_signal, cite_signal): (lane, key, indeg, score, signal, year, title, venue, link); order by triage_order()."""
    rows = surfaced.join(works.select("key", "title", "year", "venue", "doi", "oa_id", "s2_id"), "key")
    signal = F.concat_ws("+", F.when(F.col("title_signal"), "title"), F.when(F.col("cite_signal"), "cited"))
    # Characters that the report shows of a title and a venue.
    return rows.select("lane", "key", "indeg", "score", signal.alias("signal"), "year", F.substring(F.coalesce("title", F.lit("")), 1, 70).alias("title"), F.substring(F.coalesce("venue", F.lit("")), 1, 28).alias("venue"), _link(rows).alias("link"))


def ranked_report(ranked: DataFrame, works: DataFrame) -> DataFrame:
    """ranked (key, priority, exclude, reason, indeg, score): keepers, then excludes, each by priority, citations and title, with their place.

    The report is one ordered list, so one window numbers each of its two sections; a list for a person's hands is no corpus.
    """
    rows = ranked.join(works.select("key", F.coalesce("title", F.lit("")).alias("title"), "year", "venue", "doi", "oa_id", "s2_id"), "key")
    order = Window.partitionBy("exclude").orderBy(F.desc("priority"), F.desc("indeg"), F.lower("title"), "key")
    section = F.when(F.col("exclude"), "exclude").otherwise("keep")
    return rows.select(section.alias("section"), F.row_number().over(order).alias("place"), "key", "priority", "indeg", "score", "year", F.substring("title", 1, 64).alias("title"), F.substring(F.coalesce("venue", F.lit("")), 1, 24).alias("venue"), F.substring("reason", 1, 80).alias("reason"), _link(rows).alias("link"))


def priority_spread(ranked: DataFrame) -> DataFrame:
    """How many keepers each priority has, those of none too."""
    found = ranked.where("NOT exclude").groupBy("priority").agg(F.count("*").alias("n"))
    every = ranked.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("priority"))
    return every.join(found, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def no_abstract_report(title_only: DataFrame, works: DataFrame, cited: DataFrame, levs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Matrix rows scored by title alone: (section, key, priority, weighted, raw, lev, year, title, author, link). ranked: key, priority, exclude."""
    rows = title_only.select("key").join(works.select("key", "title", "year", "author1", "doi", "oa_id", "s2_id"), "key")
    rows = rows.join(cited.select("key", "weighted", "raw"), "key", "left").join(levs, "key", "left").join(ranked.select("key", "priority", "exclude"), "key", "left")
    section = F.when(F.coalesce("exclude", F.lit(False)), "exclude").otherwise("keep")
    return rows.select(section.alias("section"), "key", "priority", F.coalesce("weighted", F.lit(0.0)).alias("weighted"), F.coalesce("raw", F.lit(0)).cast("long").alias("raw"), F.coalesce("lev", F.lit(0.0)).alias("lev"), "year", F.substring(F.coalesce("title", F.lit("")), 1, 52).alias("title"), F.substring(F.coalesce("author1", F.lit("")), 1, 18).alias("author"), _link(rows).alias("link"))


def audit_report(anomalies: DataFrame, works: DataFrame, degrees: DataFrame, matrix: DataFrame) -> DataFrame:
    """anomalies (signal, key, other): a row for every work of every cluster, with its facts: (section, signal, cluster, key, title, ...).

    A cluster of a DOI is named by it and has all its works; one of two works is named by both keys.
    """
    by_doi = F.col("signal").isin("AUTO-same-doi", "S-dupdoi-review")
    paired = F.col("signal").isin("AUTO-exact-twin", "S2-neardup")
    facts = works.select("key", N.doi_lower("doi").alias("bare"))
    groups = anomalies.where(by_doi).select("signal", F.col("key").alias("cluster")).join(facts, F.col("cluster") == F.col("bare")).select("signal", "cluster", "key")
    name = F.when(paired, F.concat_ws(" ", "key", "other")).otherwise(F.col("key"))
    keys = F.when(paired, F.array("key", "other")).otherwise(F.array("key"))
    pairs = anomalies.where(~by_doi).select("signal", name.alias("cluster"), F.explode(keys).alias("key"))
    rows = groups.unionByName(pairs).join(works.select("key", "title", "author1", "year", "work_type", "is_review", "abstract"), "key")
    rows = rows.join(degrees, "key", "left").join(matrix.select("key", "text_source"), "key", "left")
    section = F.when(F.col("signal").startswith("AUTO"), "auto").otherwise("gated")
    return rows.select(section.alias("section"), "signal", "cluster", "key", F.substring("title", 1, 60).alias("title"), "author1", "year", "work_type", "is_review", P.has_text("abstract").alias("has_abstract"), F.coalesce("indeg", F.lit(0)).cast("long").alias("indeg"), F.coalesce("outdeg", F.lit(0)).cast("long").alias("outdeg"), "text_source")
