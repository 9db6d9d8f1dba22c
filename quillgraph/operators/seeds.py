"""Seeds of a crawl: identifiers by DOI, else by the best search result; guards before money is spent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import normalize as N

#: Words of a title that a search result must hold, and characters of a topic's description.
LEAST_SHARE, LEAST_DESCRIPTION = 0.4, 80


def _words(x):
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""))


def best_results(asked: DataFrame, results: DataFrame) -> DataFrame:
    """asked (id, title), results (id, rank, title, ...): for each id the result with the largest share of the title's words, the first of equals, if it is enough."""
    named = results.withColumnRenamed("title", "found_title")
    rows = asked.select("id", "title").join(named, "id")
    mine = _words(F.col("title"))
    rows = rows.withColumn("share", F.size(F.array_intersect(mine, _words(F.col("found_title")))) / F.greatest(F.size(mine), F.lit(1)))
    best = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in named.columns if c != "id"], "share"), F.struct("share", -F.col("rank"))).alias("r"))
    return best.where(F.col("r.share") >= LEAST_SHARE).select("id", "r.*")


def resolve_seeds(seeds: DataFrame, papers: DataFrame, results: DataFrame) -> DataFrame:
    """seeds (id, title, doi, s2_id, abstract) with what the services know filled in, and `how`.

    papers (doi, s2_id, abstract): answers by DOI. results (id, rank, title, doi, s2_id, abstract): searches, asked only
    for seeds that no paper was found for. Seeds with an id of the service, or neither DOI nor title, stay as they are.
    """
    d = N.doi_lower("doi")
    known = F.coalesce(N.empty_to_null("s2_id").isNotNull(), F.lit(False)) | (N.coalesce_nonempty("doi", "title").isNull())
    rows = seeds.withColumns({"_known": known, "_doi": d})
    one = papers.select(N.doi_lower("doi").alias("_doi"), F.struct("s2_id", "doi", "abstract").alias("p")).where("_doi IS NOT NULL").groupBy("_doi").agg(F.min("p").alias("p"))
    rows = rows.join(one, "_doi", "left")
    missing = rows.where("NOT _known AND p IS NULL").where(N.empty_to_null("title").isNotNull())
    hits = best_results(missing, results).select("id", F.struct("s2_id", "doi", "abstract").alias("q"))
    rows = rows.join(hits, "id", "left")
    got = F.when(~F.col("_known"), F.coalesce("p", "q"))
    fill = lambda c: N.coalesce_nonempty(c, got[c])
    how = F.when(F.col("_known"), "as given").when(F.col("p").isNotNull(), "doi").when(F.col("q").isNotNull(), "search").otherwise("unresolved")
    return rows.select("id", "title", fill("doi").alias("doi"), fill("s2_id").alias("s2_id"), fill("abstract").alias("abstract"), how.alias("how"))


def config_faults(seeds: DataFrame, description: str, placeholder: str, example_stems: list[str]) -> list[str]:
    """Reasons not to start a paid crawl: no seeds (stem), a description that is the placeholder or too short, seeds left from the example."""
    faults = []
    if not seeds.limit(1).count():
        faults.append("no seeds")
    if placeholder in description or len(description.strip()) < LEAST_DESCRIPTION:
        faults.append("no description of the topic")
    if seeds.where(F.lower(F.trim("stem")).isin(example_stems)).limit(1).count():
        faults.append("seeds of the example")
    return faults
