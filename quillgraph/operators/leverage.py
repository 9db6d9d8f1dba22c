"""Leverage: weighted depth over the core issues, its cutoffs, and the ranked reading table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import normalize as N
from quillgraph.functions import predicates as P
from quillgraph.sources.scratch import materialize

# Fixed values of the ranking rules.
BOOST, BOOST_LEVERAGE, BOOST_CITES = 1.5, 9.0, 3.0
STAR_CITED = 5.0
VISIBLE_SHARE, STAR_SHARE, LEAST_SCORED = 0.75, 0.95, 12
VISIBLE_FALLBACK, STAR_FALLBACK = 9.0, 15.0


def core_issues(issues: DataFrame, depths: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Issues that count, with their weights: all that are not marked as not core, or those whose ids begin with a prefix.

    Without any, and with depths (issue_id), every issue that a depth is recorded for counts once.
    """
    counts = F.col("issue_id").startswith(prefix) if prefix is not None else F.coalesce("core", F.lit(True))
    found = issues.where(counts).select("issue_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    if depths is None or found.limit(1).count():
        return found
    return depths.select("issue_id").distinct().withColumn("weight", F.lit(1.0))


def leverage(depths: DataFrame, issues: DataFrame) -> DataFrame:
    """(key, lev). The issues are a handful of rows; every depth row meets one of them."""
    weighed = depths.join(core_issues(issues), "issue_id")
    return weighed.groupBy("key").agg(F.round(F.sum(F.col("weight") * F.coalesce("depth", F.lit(0))), 1).alias("lev"))


def dedup_titles(rows: DataFrame) -> DataFrame:
    """First pass of the table's dedup: per lower-case title and, for chapters, book stem, the best source, then score, then order."""
    stem = F.when(N.doi_role("key") == "chapter", N.doi_stem("key")).otherwise("")
    w = Window.partitionBy(F.lower(F.trim("title")), stem).orderBy(N.source_rank("text_source").desc(), F.coalesce("score", F.lit(0)).desc(), "ord")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def fold_truncated(rows: DataFrame, authors: str = "author1") -> DataFrame:
    """Second pass: a title that another of the same surname and year continues at a word's end is the same work.

    A pair is settled by source and score, the longer title at a tie. Titles are taken from the
    longest on, and one that has lost to a shorter one still beats others, so the outcome needs no
    loop: a shorter title goes if any continuation of it is as good (that one, or whoever beat it,
    had its turn), and a longer one goes if it meets a better shorter title that no earlier turn has
    taken. Continuations are found by equal keys, every cut of a title at a space. Chapters,
    rows without surname and titles without a letter or digit stay; no year equals no year.
    """
    surname = F.lower(N.surname_shown(authors))
    block = rows.where((F.coalesce(N.doi_role("key"), F.lit("")) != "chapter") & (surname != "")).select(
        "key", "ord", N.title_stripped("title").alias("norm"), surname.alias("surname"), F.coalesce("year", F.lit(-1)).alias("year"),
        F.struct(N.source_rank("text_source").alias("source"), F.coalesce("score", F.lit(0)).alias("score")).alias("worth"),
        F.struct((-F.length("title")).alias("length"), F.col("ord").alias("ord"), F.col("key").alias("key")).alias("turn"),
    )
    block = block.where("norm <> ''")
    words = F.split("norm", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    longer = block.where(F.size(words) > 1).withColumn("cut", F.explode(cuts)).alias("a")
    met = (F.col("a.cut") == F.col("b.norm")) & (F.col("a.surname") == F.col("b.surname")) & (F.col("a.year") == F.col("b.year")) & (F.col("a.turn") < F.col("b.turn"))
    pairs = longer.join(block.alias("b"), met)
    pairs = materialize(pairs.select(F.col("a.turn").alias("long"), F.col("b.turn").alias("short"), (F.col("a.worth") >= F.col("b.worth")).alias("wins")), "continued-titles")
    taken = pairs.where("wins").groupBy("short").agg(F.min("long").alias("taken"))
    beaten = pairs.where("NOT wins").join(taken, "short", "left").where(F.col("taken").isNull() | (F.col("taken") > F.col("long")))
    gone = taken.select("short.ord", "short.key").unionByName(beaten.select("long.ord", "long.key")).distinct()
    return rows.join(gone, ["key", "ord"], "left_anti")


def clusters(rows: DataFrame) -> DataFrame:
    """(key, stem, parent_key, cluster_top): books with chapters among the rows, and which member has the highest leverage.

    rows: key, lev. Ties go to the book, then to the larger key.
    """
    roles = rows.select("key", "lev", N.doi_stem("key").alias("stem"), N.doi_role("key").alias("role")).where("stem IS NOT NULL")
    per_stem = roles.groupBy("stem").agg(
        F.max_by(F.when(F.col("role") == "book", F.col("key")), F.when(F.col("role") == "book", F.col("key"))).alias("book_key"),
        F.max(F.col("role") == "chapter").alias("has_chapter"),
        F.max(F.struct("lev", F.col("role") == "book", "key"))["key"].alias("top_key"),
    )
    found = roles.join(per_stem.where("book_key IS NOT NULL AND has_chapter"), "stem")
    return found.select("key", "stem", F.when(F.col("role") == "chapter", F.col("book_key")).alias("parent_key"), (F.col("key") == F.col("top_key")).alias("cluster_top"))


def cutoffs(rows: DataFrame, visible_min: float | None = None, star_min: float | None = None) -> DataFrame:
    """One row: visible_min, star_min. rows: lev, is_review, text_source. Pinned, else by percentile, else fallback."""
    scored = rows.where("NOT is_review AND text_source <> 'title'")
    p = scored.agg(F.count("*").alias("n"), F.percentile("lev", F.array(F.lit(VISIBLE_SHARE), F.lit(STAR_SHARE))).alias("p"))
    auto = lambda i, other: F.when(F.col("n") >= LEAST_SCORED, F.round(F.col("p")[i], 1)).otherwise(other)
    pinned = lambda v, col: F.lit(float(v)) if v is not None else col
    return p.select(F.col("n").alias("n_scored"), pinned(visible_min, auto(0, VISIBLE_FALLBACK)).alias("visible_min"), pinned(star_min, auto(1, STAR_FALLBACK)).alias("star_min"))


def leverage_percentiles(rows: DataFrame, shares=(0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 1.0)) -> DataFrame:
    scored = rows.where("NOT is_review AND text_source <> 'title'")
    p = scored.agg(F.percentile("lev", F.array(*[F.lit(s) for s in shares])).alias("p"))
    return p.select(*[F.round(F.col("p")[i], 4).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)])


def rank_table(rows: DataFrame, cuts: DataFrame, hand_keep: tuple[str, ...] = ()) -> DataFrame:
    """Flags and composite of every row, and its place in the table's order.

    rows: key, ord, title, author, year, is_review, text_source, lev, cites_per_year,
    cite_reliable, in_corpus_weighted, stem, parent_key, cluster_top; copies, if given, is kept.
    """
    no_abstract = (F.col("text_source") == "title") & ~F.col("is_review")
    ranked = ~F.col("is_review") & ~no_abstract
    boosted = ~F.col("is_review") & F.col("cite_reliable") & (F.col("lev") >= BOOST_LEVERAGE) & (F.coalesce("cites_per_year", F.lit(0.0)) >= BOOST_CITES)
    cited = (F.coalesce("in_corpus_weighted", F.lit(0.0)) >= STAR_CITED) | (F.col("key").isin(*hand_keep) if hand_keep else F.lit(False))
    one_star = F.col("stem").isNull() | F.col("cluster_top")
    out = rows.join(F.broadcast(cuts), how="cross").select(  # cuts is one row
        "key", "ord", "title", "author", "year", "is_review", "stem", "parent_key",
        no_abstract.alias("no_abstract"),
        boosted.alias("boosted"),
        F.when(~no_abstract, F.col("lev")).alias("lev"),
        F.when(~no_abstract, F.round(F.col("lev") + F.when(boosted, BOOST).otherwise(0.0), 1)).alias("composite"),
        (ranked & (F.col("lev") >= F.col("visible_min"))).alias("visible"),
        (ranked & (F.col("lev") >= F.col("star_min")) & cited & one_star).alias("star"),
        "cites_per_year", "in_corpus_weighted", *[c for c in rows.columns if c == "copies"],
    )
    return out


def table_order() -> list:
    """Stars first, then composite, cites per year, author; the works' own order breaks ties."""
    return [F.col("star").desc(), F.coalesce("composite", F.lit(0.0)).desc(), F.coalesce("cites_per_year", F.lit(0.0)).desc(), F.lower("author"), F.col("ord")]


def payload_totals(table: DataFrame) -> DataFrame:
    """How many rows have each flag; a row counts as often as its `copies` say, if it has them."""
    n = F.col("copies") if "copies" in table.columns else F.lit(1)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return table.agg(*[total(F.when(F.col(c), n)).alias(f"n_{c}") for c in ("star", "visible", "boosted", "no_abstract", "is_review")], total(n).alias("n_rows"))
