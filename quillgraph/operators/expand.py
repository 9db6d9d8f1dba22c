"""Snowball expansion of the citation graph and its economics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P


def neighbors(frontier: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """(seed, key, ord): works that a frontier work (key) cites or is cited by. Both directions in one scan of the edges."""
    out = F.struct(F.col("src").alias("seed"), F.col("dst").alias("key"), (F.col("ord") * 2).alias("ord"))
    back = F.struct(F.col("dst").alias("seed"), F.col("src").alias("key"), (F.col("ord") * 2 + 1).alias("ord"))
    ways = {"both": [out, back], "backward": [out], "forward": [back]}[direction]
    ends = edges.select(F.explode(F.array(*ways)).alias("e")).select("e.*")
    return ends.join(frontier.select(F.col("key").alias("seed")).distinct(), "seed", "left_semi")


def score_candidates(candidates: DataFrame, verdicts: DataFrame, gate=P.keyword_gate) -> DataFrame:
    """candidates (key, title, abstract), verdicts (key, score): recorded verdicts first, then no title (0), then the gate (1, deferred), else unscored (null)."""
    rows = candidates.join(verdicts.select("key", F.col("score").alias("known")), "key", "left")
    blank = ~P.has_text("title")
    passes = gate("title", "abstract")
    score = F.when(F.col("known").isNotNull(), F.col("known")).when(blank, 0).when(~passes, 1)
    reason = F.when(F.col("known").isNotNull(), "recorded").when(blank, "no title").when(~passes, "failed keyword pre-filter").otherwise("to score")
    return rows.select("key", score.cast("int").alias("score"), reason.alias("reason"), (reason == "failed keyword pre-filter").alias("deferred"))


def snowball(edges: DataFrame, seeds: DataFrame, passing: DataFrame, hops: int, write=None, direction: str = "both") -> tuple[DataFrame, list[dict]]:
    """Works reached from seeds within some hops: (key, hop), and each hop's counts.

    A hop expands the new works of the last one that pass (a semi-join with `passing`), and
    stops when there are none. State is written after each hop by `write`, so that lineage
    stays short and a lost executor costs one hop.
    """
    keep = write or (lambda df, name: df)
    nodes = keep(seeds.select("key", F.lit(0).alias("hop")).distinct(), "hop-0")
    frontier, economics = nodes.select("key"), []
    for hop in range(1, hops + 1):
        met = neighbors(frontier, edges, direction)
        new = met.select("key").distinct().join(nodes.select("key"), "key", "left_anti").select("key", F.lit(hop).alias("hop"))
        new = keep(new, f"new-{hop}")
        after = keep(nodes.unionByName(new), f"hop-{hop}")
        onward = keep(new.select("key").join(passing.select("key"), "key", "left_semi"), f"frontier-{hop}")
        n_seeds, n_new, n_next = frontier.count(), new.count(), onward.count()
        economics.append({"hop": hop, "seeds": n_seeds, "new": n_new, "passed": n_next})
        nodes, frontier = after, onward
        if not n_next:
            break
    return nodes, economics


LOG = "part int, epoch int, hop int, seeds long, new long, passed long"
STATE = "key string, hop int, epoch int, scored boolean"


def _last_part(spark: SparkSession, store: str):
    """The last complete part of a crawl's log, or None: a part counts once its line in the log is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/log")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LOG).parquet(f"{store}/log/*").orderBy(F.desc("part")).first()


def crawl(edges: DataFrame, seeds: DataFrame, passing: DataFrame, hops: int, store: str, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """A snowball that keeps its state in a folder, goes on from its last complete hop, and starts anew from new seeds.

    Every hop is a part: the works that it found (key, hop, epoch, and whether they pass), and
    then one line of the log (part, epoch, hop, seeds, new, passed). A part without its line,
    left by a killed run, is written again. Called again with more hops, the crawl expands the
    passing works of the last hop. Called with seeds that it does not know, it begins another
    epoch: they come in at hop 0 and are the only frontier, and hops are counted from 1 again.
    Seeds are expanded whether they pass or not. Returns (state, log).
    """
    spark = edges.sparkSession
    last = _last_part(spark, store)
    part, epoch, hop = (last.part, last.epoch, last.hop) if last else (-1, -1, 0)
    passes = passing.select("key").distinct().withColumn("scored", F.lit(True))

    def known() -> DataFrame:
        paths = [f"{store}/works/part={p}" for p in range(part + 1)]
        return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)

    def commit(found: DataFrame, seeds_: int) -> DataFrame:
        nonlocal part
        part += 1
        marked = found.select("key").join(passes, "key", "left").select("key", F.lit(hop).alias("hop"), F.lit(epoch).alias("epoch"), F.coalesce("scored", F.lit(False)).alias("scored"))
        marked.write.mode("overwrite").parquet(f"{store}/works/part={part}")
        written = spark.read.schema(STATE).parquet(f"{store}/works/part={part}")
        n = written.agg(F.count("*").alias("n"), F.count_if("scored").alias("p")).first()
        line = spark.createDataFrame([(part, epoch, hop, seeds_, n.n, n.p)], LOG)
        line.coalesce(1).write.mode("overwrite").parquet(f"{store}/log/part={part}")
        return written

    fresh = seeds.select("key").distinct().join(known().select("key"), "key", "left_anti")
    if fresh.limit(1).count():
        epoch, hop = epoch + 1, 0
        frontier = commit(fresh, 0)
    else:
        frontier = known().where((F.col("hop") == hop) & F.col("scored")) if hop else known().where((F.col("hop") == 0) & (F.col("epoch") == epoch))
    while hop < hops:
        n_seeds = frontier.count()
        if not n_seeds:
            break
        hop += 1
        found = neighbors(frontier, edges, direction).select("key").distinct().join(known().select("key"), "key", "left_anti")
        frontier = commit(found, n_seeds).where("scored")
    return known(), spark.read.schema(LOG).parquet(f"{store}/log/*") if part >= 0 else spark.createDataFrame([], LOG)


def forecast(economics: DataFrame, rate_per_1000: float = 0.0) -> DataFrame:
    """Fan-out, pass rate and what the next hop would cost, per hop. economics: hop, seeds, new, passed."""
    fanout = F.col("new") / F.col("seeds")
    share = F.col("passed") / F.col("new")
    rows = economics.where("seeds > 0 AND new > 0")
    projected = F.col("passed") * fanout
    return rows.select(
        "hop", F.round(fanout, 4).alias("fanout"), F.round(share, 4).alias("pass_rate"), (share > 0.30).alias("warn"), F.round(projected, 2).alias("projected_new"),
        F.round(projected * share, 2).alias("projected_paid"), F.round(projected * share / 1000 * rate_per_1000, 4).alias("cost"),
    )


def expand_once(edges: DataFrame, listed: DataFrame, known: DataFrame, hop: int) -> DataFrame:
    """One hop from listed works: every edge met, with a flag for works that are new."""
    met = neighbors(listed, edges)
    seen = known.select("key").distinct().withColumn("known", F.lit(True))
    return met.join(seen, "key", "left").select("seed", "key", F.lit(hop).alias("hop"), F.col("known").isNull().alias("is_new"))
