"""The snowball's stored state: resumed, killed half-way, seeded anew."""

from quillgraph.operators import expand
from quillgraph.sources.scratch import scratch_path

LINKS = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("x", "y"), ("y", "z"), ("z", "c")]


def tables(spark):
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(LINKS)], "src string, dst string, ord long")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    return edges, keys


def state(df):
    return sorted((r.key, r.hop, r.epoch, r.scored) for r in df.collect())


def test_a_stopped_crawl_goes_on(spark):
    edges, keys = tables(spark)
    passing = keys("a", "c", "e")
    once, log = expand.crawl(edges, keys("s"), passing, 4, scratch_path(spark, "crawl"))
    store = scratch_path(spark, "crawl")
    for hops in (1, 1, 2, 4):
        got, steps = expand.crawl(edges, keys("s"), passing, hops, store)
    assert state(got) == state(once)
    assert [tuple(r) for r in steps.orderBy("part").collect()] == [tuple(r) for r in log.orderBy("part").collect()]
    assert {(k, h) for k, h, *_ in state(once)} == {("s", 0), ("a", 1), ("b", 1), ("c", 2), ("e", 3), ("z", 3)}  # b does not pass, so d is not met


def test_a_half_written_part_is_written_again(spark):
    edges, keys = tables(spark)
    store = scratch_path(spark, "crawl")
    expand.crawl(edges, keys("s"), keys("a", "b"), 1, store)
    spark.createDataFrame([("junk", 2, 0, True)], expand.STATE).write.parquet(f"{store}/works/part=2")  # killed before its line in the log
    got, _ = expand.crawl(edges, keys("s"), keys("a", "b"), 2, store)
    assert {k for k, *_ in state(got)} == {"s", "a", "b", "c", "d"}


def test_new_seeds_replace_the_frontier(spark):
    edges, keys = tables(spark)
    store = scratch_path(spark, "crawl")
    expand.crawl(edges, keys("s"), keys("a", "b"), 1, store)
    got, log = expand.crawl(edges, keys("s", "x"), keys("a", "b", "y"), 2, store)
    assert state(got) == [("a", 1, 0, True), ("b", 1, 0, True), ("s", 0, 0, False), ("x", 0, 1, False), ("y", 1, 1, True), ("z", 2, 1, False)]
    assert [(r.epoch, r.hop, r.seeds, r.new) for r in log.orderBy("part").collect()] == [(0, 0, 0, 1), (0, 1, 1, 2), (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 1)]


def test_no_seeds(spark):
    edges, keys = tables(spark)
    got, log = expand.crawl(edges, keys("s").limit(0), keys("a"), 2, scratch_path(spark, "crawl"))
    assert got.collect() == [] and log.collect() == []
