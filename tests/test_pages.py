"""Saved pages of every kind and its fallbacks."""

import json

from quillgraph.functions import pages as G

LONG = "A long account of blame and risk. " * 4
LISTING = """<ol class='entryList'><li class='entry'><span class='articleTitle recTitle'>On <b>Blame</b> &amp; Luck</span><span class='name'>Hurd, H</span>
<span class="pubYear">1994</span><div class="abstract">{a}</div><a href="/go.pl?u=https%3A%2F%2Fdx.doi.org%2F10.1111%2FAbc.1">x</a></li>
<li class='entry'><span class='articleTitle recTitle'>Short</span><div class="abstract">brief</div><a href="https://doi.org/10.2222/Z">x</a></li>
<li class='entry'>no title</li></ol>"""
JOURNAL = """<span class="Z3988" title="rft.atitle=Duty+of+%28Care%29&amp;rft.au=Moore%2C+M&amp;rft.au=Hurd&amp;rft.date=2003-05&amp;rft_id=http%3A%2F%2Fx%3Fhandle%3Dhein.journals%2Fclq92%26div%3D42"></span>
<span data-id="hein.journals/clq92.42" class=" d-none full_summary_text"><p class='summary_sub_headers'><strong>Central Thesis</strong></p><p>{a}</p></span>
<span class="Z3988" title="rft.atitle=No+Summary&amp;rft_id=handle%3Dhein.journals%2Fclq92%26div%3D43"></span>
<span data-id="hein.journals/clq92.43" class="full_summary_text">too short</span>"""
TEXT = """Law Journal Library
Results
1.
The Reasonable
Person ✨ [article]
92 Cornell L. Rev. 1 (2003-2004)
Moore, M.; Hurd, H. (Cited 1,012 times)
DOI: https://doi.org/10.1234/Clq.92.
1. 
--- Page 2 ---
2. Akrmative Duties [comments]
akrmative (1999)
✨ AI Summary
{a}
brst line Read More
12. 34
401. Not an entry [notes]
3. Untyped title
"""
LINKED = '<script type="application/ld+json">{j}</script><meta name="citation_title" content="T &#233;"><meta content="doi:10.5/ABC" name="citation_doi"><meta name="citation_author" content="Doe, J">'


def rows(spark, **page):
    df = spark.createDataFrame([(page.get("name", "x.html"), page.get("html"), "n", 7)], "name string, html string, title0 string, year0 int")
    return G.saved_entries(df).drop("title0", "year0", "name").collect()


def test_listing(spark):
    a, b = rows(spark, html=LISTING.format(a=LONG))
    assert tuple(a) == (0, "listing", "On Blame & Luck", "Hurd, H", 1994, "10.1111/abc.1", LONG.strip(), "html_scrape", None)
    assert tuple(b) == (1, "listing", "Short", None, None, "10.2222/z", None, "html_scrape", None)


def test_journal(spark):
    (a,) = rows(spark, html=JOURNAL.format(a=LONG))
    assert tuple(a) == (0, "journal", "Duty of (Care)", "Moore, M; Hurd", 2003, None, "Central Thesis " + LONG.strip(), "hein_ai_summary", None)


def test_journal_text(spark):
    got = rows(spark, name="Results.PDF", html=TEXT.format(a=LONG))
    assert [tuple(r)[2:7] for r in got] == [
        ("The Reasonable Person", "Moore, M.; Hurd, H.", 2003, "10.1234/clq.92", None),
        ("Akrmative Duties", None, 1999, None, " ".join(LONG.split()) + " first line"),
    ]
    assert rows(spark, name="a.pdf", html="1. Other text [article]") == []


def test_records(spark):
    (a,) = rows(spark, html=LINKED.replace("{j}", json.dumps([1, {"x": 1}, {"abstract": "", "description": f"<p>{LONG}</p>"}])))
    assert tuple(a) == (0, "record", "T é", "Doe, J", None, "10.5/abc", LONG.strip(), "html_scrape", "json-ld")
    meta = '<meta property="og:title" content="O"><meta name="description" content="{a}"><meta name="dcterms.abstract" content="{b}"><a href="http://doi.org/10.1234/q?x">'
    (a,) = rows(spark, html=meta.format(a=LONG + "x", b=LONG))
    assert (a.title, a.doi, a.abstract, a.method) == ("O", "10.1234/q?x", LONG.strip(), "meta:dcterms.abstract")
    for html, method in (
        (f'<div class="x abstract y">{LONG}</div>', "philpapers.div.abstract"), (f'<section id="Abs1-c"><h2>Abstract</h2>{LONG}</section>', "springer.Abs1"),
        (f"<h2>Abstract</h2><p>{LONG}</p><h2>Next</h2>", "generic.AbstractHeading"), (f'<script type="application/ld+json">{{broken</script><meta name="description" content="{LONG}">', "meta:description"),
    ):
        (a,) = rows(spark, html=html)
        assert (a.abstract, a.method) == (LONG.strip(), method)
    assert [tuple(r)[1:] for r in rows(spark, html=None)] == [("record", None, None, None, None, None, "html_scrape", None)]
    (a,) = rows(spark, html='"doi": "https://dx.doi.org/10.7/XY" <meta name="citation_abstract" content="short">')
    assert (a.doi, a.abstract) == ("10.7/xy", None)


def test_a_page_that_looks_like_a_list_but_has_no_entry_is_a_record(spark):
    (a,) = rows(spark, html=f'<div class="entryList"></div><span class="Z3988"></span>full_summary_text<title> T\n</title><meta name="description" content="{LONG}">')
    assert (a.kind, a.title, a.method) == ("record", "T", "meta:description")
