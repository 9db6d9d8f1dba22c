"""Column functions on small literal tables; expected values are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import extract as X
from quillgraph.functions import normalize as N
from quillgraph.functions import notes
from quillgraph.functions import pages as G
from quillgraph.functions import predicates as P


@pytest.fixture(scope="module")
def one(spark):
    """value(expr, **columns): an expression over one row of strings."""

    def value(expr, **columns):
        names = list(columns)
        kinds = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in columns.items()) or "none string"
        row = tuple(columns.values()) or (None,)
        return spark.createDataFrame([row], kinds).select(expr.alias("v")).first()["v"] if names else spark.createDataFrame([row], kinds).select(expr.alias("v")).first()["v"]

    return value


def test_doi_forms(one):
    assert one(N.doi_bare("d"), d=" HTTPS://dx.doi.org/10.1/Ab") == "10.1/Ab"
    assert one(N.doi_unprefixed("d"), d="DOI:10.1/Ab") == "10.1/Ab"
    assert one(N.doi_lower("d"), d="doi:https://doi.org/10.1/Ab") == "10.1/ab"
    assert one(N.doi_lower("d"), d="doi:") is None
    # A leading set of characters is stripped, not a prefix: the o of oxfordhb goes too.
    assert one(N.doi_lower_trimmed("d"), d="https://doi.org/oxfordhb/9") == "xfordhb/9"
    assert one(N.doi_of_key("k", "d"), k="doi:10.2/x", d="10.1/y") == "10.2/x"
    assert one(N.doi_of_key("k", "d"), k="oa:W1", d="https://doi.org/10.1/y") == "10.1/y"


def test_titles(one):
    assert one(N.title_spaced("t"), t="The  Café: A-B") == "the caf a b"
    assert one(N.title_plain("t"), t="The  Café: A-B") == "the cafe a b"
    assert one(N.title_stripped("t"), t="A-B  c!") == "ab  c"
    assert one(N.title_stub("t"), t="Ünder,  the sea!") == "ünder the sea"
    assert one(N.tidy_title("t"), t="THE INNOCENCE OF NEGLIGENCE") == "The Innocence of Negligence"
    assert one(N.tidy_title("t"), t="WHY MR SMITH AND THE BJC II") == "Why MR Smith and the BJC Ii"
    assert one(N.tidy_title("t"), t=" Mixed Case ") == "Mixed Case"
    assert one(N.head_overlap(N.title_sequence("a"), N.title_sequence("b")), a="The Grammar of Blame: A Study", b="Grammar and Blame in Law") == pytest.approx(2 / 3)
    assert one(N.jaccard(N.title_tokens("a"), N.title_tokens("b")), a="moral luck here", b="moral luck there") == pytest.approx(0.5)


def test_names(one):
    assert one(N.surname_letters("a"), a="Gardner, John") == "gardner"
    assert one(N.surname_letters("a"), a="John B. Gardner") == "gardner"
    assert one(N.surname_letters("a"), a="123") is None
    assert one(N.surname_plain("a"), a="José Núñez") == "nunez"
    assert one(N.surname_shown("a"), a="Dana Kay Nelkin 1966-") == "Nelkin"
    assert one(N.author_short(F.array(F.lit("John Gardner"), F.lit("Hurd, Heidi"))), x="") == "Gardner & Hurd"
    assert one(N.author_short(F.array(F.lit("A B"), F.lit("C D"), F.lit("E F"))), x="") == "B et al."
    assert one(N.author_short(F.array().cast("array<string>")), x="") == "—"


def test_keys(one):
    assert one(N.node_key("d", "o", "s", "t"), d="", o="W1", s="S1", t="T") == "oa:W1"
    assert one(N.node_key("d", "o", "s", "t"), d=None, o=None, s="", t="On  Blame!") == "title:on blame"
    assert one(N.identity("d", "o", "s", "t"), d="none", o="None", s="S1", t="T") == "s2:S1"
    assert one(N.identity("d", "o", "s", "t"), d=" HTTPS://doi.org/10.1/A", o="W", s="S", t="T") == "doi:10.1/a"
    for key, stem, role in (("doi:10.1/b.001.0001", "10.1/b", "book"), ("doi:10.1/b.003.0004", "10.1/b", "chapter"), ("doi:10.1017/cbo978.004", "10.1017/cbo978", "chapter"), ("doi:10.1017/CBO978", "10.1017/cbo978", "book"), ("doi:10.1/x", None, None), ("oa:W1", None, None)):
        assert (one(N.doi_stem("k"), k=key), one(N.doi_role("k"), k=key)) == (stem, role)


def test_numbers(one):
    assert one(N.page_span("p"), p="10-12") == 3
    assert one(N.page_span("p"), p="7") == 1
    assert one(N.page_span("p"), p="32-5588-32-5588") is None
    assert one(N.page_span("p"), p="9-3") is None
    assert one(N.safe_int("p"), p="x") is None
    assert one(N.cites_per_year("c", "y"), c=50, y=2021) == 10.0
    assert one(N.cites_per_year("c", "y"), c=50, y=2030) == 50.0
    assert one(N.cites_per_year("c", "y"), c=5, y=0) is None


def test_inverted_index(spark):
    df = spark.createDataFrame([({"a": [0, 3], "b": [1]},), ({},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in df.select(N.inverted_index_text("m")).collect()] == ["a b  a", "", ""]
    assert [r[0] for r in df.select(N.inverted_index_text("m", keep_gaps=False)).collect()] == ["a b a", "", ""]


def test_gate_stems_match_whole_words_only(one):
    # "culpab" is a stem with a word's end after it: inflected words do not match unless asked for.
    assert one(P.keyword_gate("t"), t="culpable courts") is False
    assert one(P.keyword_gate("t", inflected=True), t="culpable courts") is True
    assert one(P.keyword_gate("t"), t="moral law") is True
    assert one(P.keyword_gate("t"), t="moral tales") is False
    assert one(P.keyword_gate("t"), t="On free will") is True


def test_reviews(one):
    assert one(P.merge_review(F.lit(False), "d", "a"), d="10.5860/choice.1", a="") is True
    assert one(P.merge_review(F.lit(None).cast("boolean"), "d", "a"), d=None, a="In this review we") is True
    assert one(P.strong_review("t", "d", "a"), t="A survey", d="10.1/x", a="In this review we") is False
    assert one(P.strong_review("t", "d", "a"), t="Review of Blame", d=None, a=None) is True
    assert one(P.tagged_review("t", "d", "a", "p"), t="Blame.", d="10.1/x", a="", p=2) is True
    assert one(P.tagged_review("t", "d", "a", "p"), t="Blame.", d="10.1/x", a="", p=3) is False


def test_types(one):
    assert one(P.normal_type("t"), t="Journal-Article") == "article"
    assert one(P.guessed_type("d", "v"), d="10.1/acprof:oso/9.003.0001", v="") == "book-chapter"
    assert one(P.guessed_type("d", "v"), d="10.1/b.001.0001", v="") == "book"
    assert one(P.guessed_type("d", "v"), d=None, v="Oxford Handbook of X") == "book-chapter"
    assert one(P.book_kind("t"), t="Selected Essays and Handbook") == "essay-collection"
    assert one(P.book_kind("t"), t="On Blame") == "monograph"
    assert one(P.chapter_like("d", "t"), d="10.1093/oxfordhb/1", t="article") is True
    assert one(P.case_citation("t"), t="see Smith v. Jones") is True
    assert one(P.case_citation("t"), t="see Smith") is False


@pytest.mark.parametrize(
    "oa, cr, sc, expected",
    [
        (11, 4, None, (4, "crossref", False)), (12, 4, None, (4, "crossref", True)),
        (7, 0, None, (0, "crossref", False)), (8, 0, None, (0, "crossref", True)),
        (100, 9, 9, (9, "scopus", True)), (100, 5, 9, (5, "crossref", True)),
        (50, None, None, (50, "openalex", False)), (None, None, None, (None, None, False)), (None, 3, 7, (7, "scopus", False)),
    ],
)
def test_reconciled_citedness(spark, oa, cr, sc, expected):
    df = spark.createDataFrame([(oa, cr, sc)], "oa int, cr int, sc int").select(P.reconciled_citedness("oa", "cr", "sc").alias("r")).select("r.*")
    assert tuple(df.first()) == expected


def test_format_detection(spark):
    text = "Body text.\nReferences\n1. Smith, J. On Blame. 10.1234/abc\n2. Jones\n--- Page 1 ---\n"
    r = X.detect_format(spark.createDataFrame([("a", text), ("b", "plain")], "stem string, text string")).orderBy("stem").collect()
    assert (r[0]["format"], r[0]["endnotes"], r[0]["parser"], r[0]["confidence"], r[0]["page_count"]) == ("endnotes", 70, "bibliography", "high", 1)
    assert (r[1]["format"], r[1]["confidence"], r[1]["parser"]) == ("unknown", "low", "either")


def entries(spark, text):
    rows = notes.reference_entries(spark.createDataFrame([("t", text)], "stem string, text string"), whole=True)
    return [r.entry for r in rows.orderBy("n").collect()]


def test_reference_entries(spark):
    numbered = "1  Smith J. On blame. 1990.\n2  Jones K. Luck\n   again. 2001.\n3  Lee A. No year.\n"
    assert entries(spark, numbered) == ["Smith J. On blame. 1990.", "Jones K. Luck again. 2001."]
    dated = "Smith, J. (1990) On blame.\n  continued\n—— (1995) More.\nJones, K. (2001) Luck."
    assert entries(spark, dated) == ["Smith, J. (1990) On blame. continued", "Smith, (1995) More.", "Jones, K. (2001) Luck."]
    # Two numbered entries are too few: they are taken as a dated list.
    assert entries(spark, "1  Smith J. 1990.\n2  Jones K. 2001.") == ["1  Smith J. 1990. 2  Jones K. 2001."]
    assert entries(spark, "—— (1995) nobody before\nHart HLA, Punish-\nment 1968") == ["—— (1995) nobody before", "Hart HLA, Punishment 1968"]
    assert entries(spark, "") == []


def test_references_section(one):
    assert one(X.references_section("t"), t="Intro\nReferences\nold\nReferences\nSmith 1990\n\nAppendix\nx") == "Smith 1990"
    assert one(X.references_section("t"), t="none") is None


def test_pages(one):
    page = '<html><head><title> A\n B </title><meta name="citation_doi" content="doi:10.1234/AbC"><meta content="' + "x" * 90 + '" name="description"></head><body><script>var t="</p>"</script><p>Hi <b>there</b></p></body></html>'
    assert one(X.page_title("h"), h=page) == "A B"
    assert one(G.record_doi("h"), h=page.replace('meta name="citation_doi" content', 'meta name="citation_doi"  content')) == "10.1234/abc"
    assert tuple(one(G.record_abstract("h"), h=page[page.index("<meta content") :])) == ("x" * 90, "meta:description")
    assert one(G.record_abstract("h"), h=page) is None  # the rule takes the first field's value up to the second one's quote
    assert one(X.visible_text("h"), h="<p>Hi <b>there</b></p><script>x</script>") == "Hi there"
    assert one(X.unescape("h"), h="a &amp; b &#233;") == "a & b é"


def test_rendered_text(spark):
    from quillgraph.functions import render as R

    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(R.holds_any(R.CITING_SUBJECTS, lit("On Tortious acts"), none)) and not one(R.holds_any(R.CITING_SUBJECTS, lit("On"), lit("luck")))
    # A phrase may run over from one text to the next.
    assert one(R.holds_any(("criminal law",), lit("Criminal"), lit("Law")))
    assert one(R.fix_ligatures(lit("a specibc debnition, akrmative"))) == "a specific definition, affirmative" and one(R.fix_ligatures(none)) is None
    words = lambda *w: F.array(*[lit(x) for x in w]) if w else F.array().cast("array<string>")
    assert one(R.term_cloud(words("a", "b"), words(), words("c"))) == f"{R.TIERS[0]}: a, b\n{R.TIERS[2]}: c"
    assert one(R.term_cloud(words(), F.lit(None).cast("array<string>"), words())) == ""
    assert one(R.citation_line(lit("T"), words("A", "", "C", "D", "E"), lit(2001), lit("V"), lit(3), lit("10.1/x"))) == "  - **T** — A, ?, C, D (2001), *V* [cited by 3]  \n    DOI: 10.1/x"
    assert one(R.citation_line(none, words(), F.lit(None).cast("int"), none, lit(0), none)) == "  - **(no title)** —  (?)"
