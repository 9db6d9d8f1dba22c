"""Literature operators on small graphs, and every registered query against its SQL at the smallest scale."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import audit, citedness, enrich, expand, leverage, match, resolve, worklists
from quillgraph.plans import queries as plans
from quillgraph.plans import search
from quillgraph.sources import graph, sinks

SF = "/root/testdata/sf0.001"
WORK = "key string, ord long, doi string, oa_id string, s2_id string, title string, author1 string, author2 string, year int, venue string, abstract string, text_source string, work_type string, is_review boolean, is_seed boolean, score int"


def work(key, title, author="Smith, J", year=2000, **more):
    base = {"ord": 0, "doi": None, "oa_id": None, "s2_id": None, "author2": None, "venue": "V", "abstract": "", "text_source": "abstract", "work_type": "article", "is_review": False, "is_seed": False, "score": 5} | more
    return (key, base["ord"], base["doi"], base["oa_id"], base["s2_id"], title, author, base["author2"], year, base["venue"], base["abstract"], base["text_source"], base["work_type"], base["is_review"], base["is_seed"], base["score"])


@pytest.fixture(scope="module")
def works(spark):
    return lambda *rows: spark.createDataFrame([(r[0], i, *r[2:]) for i, r in enumerate(rows)], WORK)


def scores(works_):
    return works_.select("key", "score", F.lit("").alias("reason"), F.lit(False).alias("deferred"))


def reasons(works_):
    w = works_.drop("score")
    return {r["norm_title"]: r["reason"] for r in resolve.merge_groups(w, scores(works_)).collect()}


def test_merge_guards(works):
    assert reasons(works(work("a", "T"), work("b", "T", "Jones, K"))) == {"t": "surname"}
    assert reasons(works(work("a", "T", year=2000), work("b", "T", year=2011))) == {"t": "years"}
    assert reasons(works(work("a", "T", year=2000), work("b", "t!", year=2010))) == {"t": None}
    # The surname guard sees reviews too, so one by another author blocks the merge.
    assert reasons(works(work("a", "T"), work("b", "T"), work("c", "T", "Jones, K", is_review=True))) == {"t": "surname"}
    assert reasons(works(work("a", "T"), work("b", "T", is_review=True))) == {"t": "reviews"}
    assert reasons(works(work("a", "T", None), work("b", "T", None))) == {"t": "surname"}


def test_merge_and_repoint(spark, works):
    w = works(work("oa:1", "T", abstract="short", venue=None), work("doi:2", "T", abstract="", venue="J"), work("s2:3", "T", abstract="a longer one", doi="10.1/x"), work("doi:9", "U"))
    m = resolve.merge_map(w.drop("score"), scores(w))
    assert {r["alias"]: r["canonical"] for r in m.collect()} == {"doi:2": "oa:1", "s2:3": "oa:1"}
    edges = spark.createDataFrame([("doi:2", "doi:9", 1, 0), ("oa:1", "doi:9", 2, 1), ("s2:3", "oa:1", 1, 2), ("doi:9", "s2:3", 3, 3)], "src string, dst string, hop int, ord long")
    assert {tuple(r) for r in resolve.repoint_edges(edges, m).collect()} == {("oa:1", "doi:9", 1), ("doi:9", "oa:1", 3)}
    merged = {r["key"]: r for r in resolve.merged_works(w.drop("score"), m).collect()}
    assert set(merged) == {"oa:1", "doi:9"}
    assert (merged["oa:1"]["abstract"], merged["oa:1"]["venue"], merged["oa:1"]["doi"], merged["oa:1"]["aliases"]) == ("a longer one", "J", "10.1/x", "doi:2|s2:3")


def test_title_dedup_keeps_chapters_of_different_books(works):
    w = works(work("doi:10.1/a.003.0001", "Negligence"), work("doi:10.1/b.003.0001", "Negligence"), work("oa:1", "negligence ", text_source="title"), work("oa:2", "Negligence", text_source="full"))
    assert {r["key"] for r in leverage.dedup_titles(w).collect()} == {"doi:10.1/a.003.0001", "doi:10.1/b.003.0001", "oa:2"}


def test_truncated_titles_fold(works):
    keys = lambda *rows: {r["key"] for r in leverage.fold_truncated(works(*rows)).collect()}
    assert keys(work("a", "The Selfish: A Study"), work("b", "The Selfish")) == {"a"}
    assert keys(work("a", "The Selfish: A Study"), work("b", "The Self")) == {"a", "b"}
    assert keys(work("a", "The Selfish: A Study"), work("b", "The Selfish", year=1999)) == {"a", "b"}
    assert keys(work("a", "The Selfish: A Study"), work("b", "The Selfish", "Jones, K")) == {"a", "b"}
    # The longest loses to the second and still eliminates the third.
    assert keys(work("a", "One two three four", text_source="abstract"), work("b", "One two three", text_source="full"), work("c", "One two", text_source="title")) == {"b"}


def test_truncated_titles_fold_as_the_loop_does(works):
    import random

    rng = random.Random(5)
    sources = {"title": 0, "abstract": 1, "full": 2}
    rows = []
    for i in range(150):
        title = " ".join(rng.choice(["a", "b", "b!"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "!!", "?"])
        rows.append(work(f"k{i}", title, rng.choice(["Lee, A", "Ann Lee 1966-", "Kim, B"]), year=rng.choice([1999, None]), text_source=rng.choice(list(sources))))
    table = works(*rows)
    data = sorted(table.collect(), key=lambda r: r["ord"])
    data.sort(key=lambda r: -len(r["title"]))
    norm = lambda r: "".join(c for c in r["title"].lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ").strip()
    family = lambda r: "kim" if "Kim" in r["author1"] else "lee"
    worth = lambda r: (sources[r["text_source"]], r["score"] or 0)
    gone = set()
    for i, r in enumerate(data):
        for s in data[i + 1 :] if r["key"] not in gone else []:
            if s["key"] not in gone and norm(s) and norm(r).startswith(norm(s) + " ") and family(r) == family(s) and r["year"] == s["year"]:
                gone.add(s["key"] if worth(r) >= worth(s) else r["key"])
    assert len(gone) > 30
    assert {r["key"] for r in leverage.fold_truncated(table).collect()} == {r["key"] for r in data} - gone
    assert leverage.fold_truncated(table.limit(0)).count() == 0


def test_leverage_is_linear_in_weights(spark):
    depths = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 0), ("b", "z", 3)], "key string, issue_id string, depth int")
    issues = spark.createDataFrame([("x", 1.5, True), ("y", None, None), ("z", 9.0, False)], "issue_id string, weight double, core boolean")
    assert {r["key"]: r["lev"] for r in leverage.leverage(depths, issues).collect()} == {"a": 5.5, "b": 0.0}


def test_cutoffs_need_twelve_rows(spark):
    rows = lambda n: spark.createDataFrame([(float(i), False, "abstract") for i in range(n)], "lev double, is_review boolean, text_source string")
    assert tuple(leverage.cutoffs(rows(11)).first()) == (11, 9.0, 15.0)
    assert tuple(leverage.cutoffs(rows(12)).first()) == (12, 8.3, 10.5) or math.isclose(leverage.cutoffs(rows(12)).first()["visible_min"], 8.3, abs_tol=0.1)
    assert tuple(leverage.cutoffs(rows(12), 1.0, 2.0).first()) == (12, 1.0, 2.0)


def test_three_in_degrees_differ(spark, works):
    """A duplicate edge and a self-loop count in the raw degree, not among distinct works."""
    w = works(work("a", "A", oa_id="1"), work("b", "B", oa_id="2"), work("c", "C", oa_id="1"))
    edges = spark.createDataFrame([("b", "a", 1, 0), ("b", "a", 1, 1), ("a", "a", 1, 2), ("b", "c", 1, 3)], "src string, dst string, hop int, ord long")
    lev = spark.createDataFrame([("b", 15.0)], "key string, lev double")
    assert {r["key"]: r["indeg"] for r in citedness.degrees(edges).collect()}["a"] == 3
    assert {r["key"]: (r["raw"], r["weighted"]) for r in citedness.node_citedness(edges, lev).collect()}["a"] == (3, 7.0)
    assert [tuple(r) for r in citedness.identity_citedness(edges, citedness.identities(w), lev).collect()] == [("oa:1", 1, 3.0)]


def test_audit_rules(spark, works):
    text = "Book synopsis: a tale of ships and storms far away, told by sailors who saw them all and more besides."
    w = works(
        work("a", "Same Title", doi="10.1/a"), work("b", "Same title"), work("c", "Same title again", doi="10.1/c", abstract="x"), work("d", "Other", "Lee, A", doi="10.1/a", abstract="y"),
        work("r", "Some Book", "Ray, B", is_review=True, doi="10.7/r", abstract="z"), work("s", "Moral Luck Reconsidered", "Kay, C", abstract=text, doi="10.8/s"), work("j", "A Book", "Jay, D", doi="10.2307/1", work_type="book", abstract="z"),
    )
    edges = spark.createDataFrame([(x, "r", 1, i) for i, x in enumerate("abc")], "src string, dst string, hop int, ord long")
    got = {(r["signal"], r["key"], r["other"]) for r in audit.detect(w.drop("score"), scores(w), edges).collect()}
    assert got == {("AUTO-exact-twin", "a", "b"), ("S2-neardup", "a", "c"), ("S2-neardup", "b", "c"), ("AUTO-same-doi", "10.1/a", "2"), ("S1-review-cites", "r", "3"), ("S4-wrong-abstract", "s", ""), ("S5-jstor-book", "j", "book")}
    assert {r["signal"] for r in audit.detect(w.drop("score"), scores(w), edges, ratio=None).collect()} == {g[0] for g in got}


def test_matching(spark, works):
    w = works(work("a", "The Innocence of Negligence", "Hurd, Heidi", abstract="x"), work("b", "Negligence and Blame", "Gardner, J"), work("c", "Innocence of Negligence: a review", "Hurd, Heidi", is_review=True))
    p = spark.createDataFrame([(1, "l", "The Innocence of Negligence", "Hurd"), (2, "l", "Something else entirely", "Nobody"), (3, "l", "of", "x")], "probe_id long, bib string, title string, surname string")
    got = {r["probe_id"]: (r["bucket"], r["key"]) for r in match.audit_list(p, w.drop("score"), scores(w)).collect()}
    assert got == {1: ("in_matrix", "a"), 2: ("absent", None), 3: ("absent", None)}


def test_siblings_and_targets(spark, works):
    w = works(work("a", "On Blame", year=2000), work("b", "on blame!", year=2003), work("c", "On Blame", year=2004), work("d", "On Blame", year=None))
    assert {r["key"]: r["siblings"] for r in match.siblings(w).collect()} == {"a": "b|d", "b": "a|c|d", "c": "b|d", "d": "a|b|c"}
    t = works(work("a", "On Blame and Luck", doi="10.1/A"), work("b", "Other", "Lee, A"))
    e = spark.createDataFrame([("1", "x", "Y", "doi:10.1/a"), ("2", "On blame, and luck", "Smith, J", None), ("3", "Othar", "A Lee", None)], "entry_id string, title string, author string, doi string")
    assert {tuple(r) for r in match.page_targets(e, t).collect()} == {("1", "a", "doi"), ("3", "b", "fuzzy")}


def test_full_text_matches(spark, works):
    t = spark.createDataFrame([("HURD the innocence of negligence", ""), ("GARDNER other", "")], "stem string, text string")
    w = works(work("a", "The Innocence of Negligence", "Hurd, Heidi"), work("b", "Blame", "Gardner, J"))
    assert [tuple(r) for r in match.full_text_matches(t, w).collect()] == [("a", "HURD the innocence of negligence")]


def test_snowball_expands_only_what_passes(spark):
    edges = spark.createDataFrame([("s", "a", 1, 0), ("b", "a", 1, 1), ("b", "c", 1, 2), ("x", "y", 1, 3)], "src string, dst string, hop int, ord long")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    nodes, economics = expand.snowball(edges, keys("s"), keys("a", "b"), 5)
    assert {tuple(r) for r in nodes.collect()} == {("s", 0), ("a", 1), ("b", 2), ("c", 3)}
    assert [e["new"] for e in economics] == [1, 1, 1]
    assert {r["key"] for r in expand.snowball(edges, keys("s"), keys("b"), 5)[0].collect()} == {"s", "a"}


def test_candidate_scoring_defers_gate_misses(spark, works):
    w = works(work("a", "moral law"), work("b", "cooking"), work("c", ""), work("d", "cooking"))
    known = spark.createDataFrame([("d", 4)], "key string, score int")
    assert {r["key"]: (r["score"], r["deferred"]) for r in expand.score_candidates(w, known).collect()} == {"a": (None, False), "b": (1, True), "c": (0, False), "d": (4, False)}


def test_enrichment_takes_the_first_good_value(spark, works):
    w = works(work("a", "A"), work("b", "B"), work("c", "C"))
    table = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    got = {r["key"]: (r["value"], r["source"]) for r in enrich.abstracts(w, table(("a", "short"), ("b", "x" * 60)), table(("a", "y" * 61), ("c", None)), table(("b", "z" * 70))).collect()}
    assert got == {"a": ("y" * 61, "crossref"), "b": ("x" * 60, "openalex"), "c": (None, None)}


def test_rescore_actions(spark, works):
    w = works(work("a", "A", text_source="full"), work("b", "B"), work("c", "C"), work("d", "D"))
    prior = spark.createDataFrame([("a", "abstract", False), ("b", "abstract", True), ("c", "abstract", None)], "key string, text_source string, score_error boolean")
    assert {r["key"]: r["action"] for r in worklists.rescore_actions(w, prior, upgrade=True).collect()} == {"a": "rescore", "b": "rescore", "c": "reuse", "d": "score"}


def test_search(spark):
    t = spark.createDataFrame([("a", "Hurd", "Heidi Hurd", "On Blame", "", "1999", True, False), ("b", "Lee", "A Lee", "Hurd on luck", "", "2001", False, True)], "key string, author string, authors_full string, title string, abstract string, year string, visible boolean, star boolean")
    keys = lambda *a, **k: [r["key"] for r in search.shown(t, *a, **k).collect()]
    assert keys(search.term("hurd", "AU")) == ["a"] and sorted(keys(search.term("HURD"))) == ["a", "b"]
    assert keys(search.term("hurd") & ~search.term("hurd", "au")) == ["b"]
    assert keys() == ["a"] and keys(show_all=True, stars_only=True) == ["b"] and len(keys(search.term(" "))) == 2


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": {"doi:1": {"title": "A", "authors": ["X Y"], "year": 2000}, "oa:2": {"title": "B"}}, "scores": {"doi:1": {"score": 5, "reason": "r"}}, "edges": [{"from": "doi:1", "to": "oa:2"}], "completed_hop": 1}')
    g = graph.read_graph(spark, str(tmp_path / "g.json"))
    assert {r["key"]: r["title"] for r in g["works"].collect()} == {"doi:1": "A", "oa:2": "B"}
    assert [tuple(r) for r in g["edges"].collect()] == [("doi:1", "oa:2", None, 0)] and g["relevance"].first()["score"] == 5
    (tmp_path / "i.json").write_text('{"issues": [{"id": "A1", "label": "x", "question": "q", "weight": 1.5}, {"id": "B1", "core": false}]}')
    assert [(r["issue_id"], r["weight"], r["core"]) for r in graph.read_issues(spark, str(tmp_path / "i.json")).orderBy("ord").collect()] == [("A1", 1.5, True), ("B1", 1.0, False)]
    assert graph.read_matrix(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "HURD on blame.txt").write_text("two\nlines")
    assert [tuple(r) for r in graph.read_texts(spark, str(tmp_path / "txt")).collect()] == [("HURD on blame", "two\nlines")]
    (tmp_path / "w.csv").write_text('﻿tier,title,sibling_node_keys,abstract\n1,"A ""b""","k1|k2","two\nlines"\n')
    assert [(r["tier"], r["key"], r["abstract"]) for r in graph.read_worklist(spark, str(tmp_path / "w.csv")).collect()] == [("1", "k1", "two\nlines"), ("1", "k2", "two\nlines")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.write_version(spark.range(1), root, commit=False) is None and not os.path.exists(root)
    sinks.write_version(spark.range(2), root)
    sinks.write_version(spark.range(5), root)
    assert sinks.read_version(spark, root).count() == 5
    sinks.write_keys(spark.createDataFrame([("b",), ("a",), ("b",)], "key string"), str(tmp_path / "k"))
    assert sorted(r["key"] for r in graph.read_keys(spark, str(tmp_path / "k")).collect()) == ["a", "b"]


def test_service_records(spark):
    raw = spark.createDataFrame([("https://openalex.org/W1", "https://doi.org/10.1/A", " T ", {"a": [0]}, 2000, None, [({"display_name": f"N{i}"},) for i in range(8)], None)], "id string, doi string, title string, abstract_inverted_index map<string, array<int>>, publication_year int, primary_location struct<source: struct<display_name: string>>, authorships array<struct<author: struct<display_name: string>>>, cited_by_count int")
    r = graph.parse_openalex(raw).first()
    assert (r["oa_id"], r["doi"], r["title"], r["abstract"], len(r["authors"]), r["citations"]) == ("W1", "10.1/a", "T", "a", 6, 0)


def test_streaming(spark, tmp_path):
    from quillgraph.streaming import ingest

    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("dst"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.citation_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n FROM windows").first()["n"]
    assert 0 < got <= events.count()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "lineitem", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = plans.queries()[name](spark, SF)
    expected = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    text = lambda v: f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)
    left = sorted(tuple(text(r[c]) for c in names) for r in found.collect())
    assert left == sorted(tuple(text(v) for v in r) for r in expected.fetchall())


def test_the_library_stands_without_its_subpackage():
    """Nothing outside imports the corpus operators."""
    import pathlib

    root = pathlib.Path(plans.__file__).parents[1]
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert "quillgraph.llm" not in f.read_text()


def test_auto_merges_follow_chains(spark, works):
    """a is b's empty twin, b shares a DOI with c under another title: all three are one work."""
    w = works(work("oa:a", "Same Title"), work("doi:b", "Same title", doi="10.1/b", abstract="x"), work("s2:c", "Another", "Lee, A", doi="10.1/B", abstract="longer"), work("doi:z", "Else", "Zed, Z", doi="10.1/z"))
    got = {r["alias"]: r["canonical"] for r in audit.auto_merge_map(w.drop("score"), scores(w)).collect()}
    assert got == {"oa:a": "doi:b", "s2:c": "doi:b"}


def test_components(spark):
    from quillgraph.operators.components import connected_components

    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (3, 3)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(n, 5) for n in (5, 6, 7, 8, 9)} | {(1, 1), (2, 1)}


def density_by_all_pairs(rows, cosine, least, least_cluster):
    """The clusters as sets of ids, from all cosines at once."""
    import numpy as np

    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    near = cosines >= cosine
    core = near.sum(axis=1) >= least
    of = np.full(len(rows), -1)
    for i in np.flatnonzero(core):
        front = [i] if of[i] < 0 else []
        while front:
            of[front] = i
            front = np.flatnonzero(near[front].any(axis=0) & core & (of < 0)).tolist()
    for i in np.flatnonzero(~core):
        best = max(np.flatnonzero(core), key=lambda j: cosines[i, j], default=None)
        of[i] = of[best] if best is not None and near[i, best] else -1
    groups = [frozenset(rows[i][0] for i in np.flatnonzero(of == c)) for c in set(of.tolist()) - {-1}]
    return {g for g in groups if len(g) >= least_cluster}


@pytest.mark.parametrize("room, largest", [(250, 2000), (20, 60)])
def test_density_clusters(spark, monkeypatch, room, largest):
    import numpy as np

    from quillgraph.operators import cluster

    monkeypatch.setattr(cluster, "ROOM", room)
    monkeypatch.setattr(cluster, "LARGEST", largest)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = [centres[i % 12] + rng.normal(size=16) * 0.18 for i in range(400)] + list(rng.normal(size=(150, 16))) + [centres[0]] * 100 + [centres[1] * (1 + i / 200) for i in range(150)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    expected = density_by_all_pairs(rows, 0.9, 3, 6)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (None, rows[0][1]), (2004, [None] * 16), (2005, [1.0] * 15)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    got = cluster.density_clusters(table, 16, least=3).collect()
    of = {r["vec_id"]: r["cluster"] for r in got}
    assert len(got) == len(rows) + len(odd) and {of[i] for i in (*range(2000, 2006), None)} == {-1}
    found = {c: {i for i in of if of[i] == c} for c in set(of.values()) - {-1}}
    assert all(min(g) == c for c, g in found.items()) and len(expected) >= 10
    # Nothing joins what all pairs keep apart, and at least 0.9 of each cluster's members are found together.
    assert all(any(g <= e for e in expected) for g in found.values())
    kept = sum(max((len(g & e) for g in found.values()), default=0) for e in expected)
    assert kept >= 0.9 * sum(len(e) for e in expected)


def test_density_clusters_of_few_or_no_vectors(spark):
    from quillgraph.operators import cluster

    table = lambda *rows: spark.createDataFrame(list(rows), "vec_id long, embedding array<double>")
    assert cluster.density_clusters(table(), 2).count() == 0
    assert cluster.cluster_sizes(cluster.density_clusters(table((1, [1.0, 0.0]), (2, [1.0, 0.0])), 2)).collect() == [(-1, 2)]
    # An id may repeat with several vectors.
    got = cluster.density_clusters(table((5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0]), (7, [0.1, 2.0])), 2, least_cluster=3).collect()
    assert sorted((r["vec_id"], r["cluster"]) for r in got) == [(5, -1), (5, 5), (6, 5), (7, 5)]


def test_serial_venues_and_junk_titles(spark):
    from quillgraph.operators.enrich import serial_venues
    from quillgraph.operators.worklists import authorless

    works = spark.createDataFrame(
        [("a", "Oxford Studies in Metaethics", "Volume 7", None), ("b", "x", "oxford studies in normative ethics, Vol. 3", "9"), ("c", "Mind", None, None), ("d", None, "Oxford Studies in Metaethics", None)],
        "key string, venue string, container_title string, volume string",
    )
    got = {r["key"]: (r["work_type"], r["venue"], r["volume"]) for r in serial_venues(works).collect()}
    assert got == {"a": ("article", "Oxford Studies in Metaethics", "7"), "b": ("article", "oxford studies in normative ethics", "9"), "d": ("article", "Oxford Studies in Metaethics", None)}
    titles = ["105-127) of it", "If T is its own", "A mental action that is", "Luck, pp. 3", "-- *** --", "One; and Two", "short", None, "Éthique générale", "Moral luck and ice floes", "On iffy things"]
    rows = [(str(i), t, "", " ", i == 10) for i, t in enumerate(titles)] + [("n", "5 names", "Ann", None, False)]
    got = {r["key"]: r["kind"] for r in authorless(spark.createDataFrame(rows, "key string, title string, author1 string, author2 string, junk_title boolean")).collect()}
    assert got == {str(i): "recover" if i in (8, 9) else "junk" for i in range(len(titles))}


def test_best_per_title_and_openings(spark):
    from quillgraph.operators import reports

    rows = spark.createDataFrame([(1, "A", "title", 5), (2, " a", "full", None), (3, "a ", "full", 4), (4, "B", "abstract", 1), (5, "b", "abstract", 1), (6, None, None, None)], "ord long, title string, text_source string, score int")
    assert {r["ord"] for r in reports.best_per_title(rows).collect()} == {3, 4, 6}
    assert {r["ord"] for r in reports.best_per_title(rows, by_score=False).collect()} == {2, 4, 6}
    assert [r["ord"] for r in reports.most_cited(rows, "score", 3).collect()] == [1, 3, 4]
    notes = spark.createDataFrame([(1, 0, "x" * 80 + "a"), (1, 1, "x" * 80 + "b"), (1, 2, "x" * 79), (2, 0, "x" * 80 + "b")], "doc_id long, pos int, body string")
    assert {(r["doc_id"], r["pos"]) for r in reports.distinct_openings(notes).collect()} == {(1, 0), (1, 2), (2, 0)}


def test_author_lanes_and_rescue_chain(spark):
    from quillgraph.operators.worklists import junk_title

    nodes = spark.createDataFrame(
        [("a", "W1", "10.1/A", None, "On blameless wrongs"), ("b", None, "https://doi.org/10.1/b", "S2", "On luck and law"), ("c", "W3", "10.1/c", "S3", "On acts of will"), ("d", None, None, None, "On omissions"), ("e", "W1", None, "S5", "12-15)"), ("f", " ", "", "S6", "On harms done")],
        "key string, oa_id string, doi string, s2_id string, title string",
    )
    names = lambda *rows: spark.createDataFrame(list(rows), "id string, value array<string>")
    oa = names(("W1", [" ", ""]), ("W1", [" Ann Lee ", ""]), ("doi:10.1/b", None), ("doi:10.1/c", ["Wrong"]), (None, ["Nobody"]))
    got = {r["key"]: (r["lane"], r["authors"], r["source"]) for r in enrich.author_lanes(nodes, oa, names(("10.1/b", ["Bo Kim"])), names(("10.1/b", ["x"]), ("10.1/c", ["Cy Poe"])), junk_title()).collect()}
    assert got == {"a": ("recovered", ["Ann Lee"], "openalex"), "b": ("recovered", ["Bo Kim"], "crossref"), "c": ("recovered", ["Cy Poe"], "semantic_scholar"), "d": ("stuck", None, None), "e": ("junk", None, None), "f": ("stuck", None, None)}
    text = lambda *rows: spark.createDataFrame(list(rows), "id string, value string")
    s2 = text(("doi:10.1/b", None), ("s2:S2", "hidden by the record of its DOI"), ("s2:S3", "from s2"), ("s2:S5", "five"), ("s2:S6", " "))
    got = {r["key"]: (r["value"], r["source"]) for r in enrich.rescue_abstracts(nodes, text(("W1", ""), ("doi:10.1/a", "by doi")), s2).collect()}
    assert got == {"a": ("by doi", "openalex"), "b": (None, None), "c": ("from s2", "semantic_scholar"), "d": (None, None), "e": ("five", "semantic_scholar"), "f": (None, None)}
    assert enrich.rescue_abstracts(nodes.limit(0), text(), text()).count() == 0


def test_twins_fold_into_their_canonical_work(spark):
    parked = spark.createDataFrame([("a", 9.0), ("b", 12.0), ("c", 12.0), ("d", 8.0), ("e", 8.0), ("f", 30.0)], "key string, weighted double")
    canon = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "x"), ("e", "y"), ("f", "z")], "key string, canon string")
    known = spark.createDataFrame([("x", 4), ("y", 3)], "key string, score int")
    assert {r["key"] for r in citedness.fold_twins(parked, canon, known).collect()} == {"a", "b", "e", "f"}
