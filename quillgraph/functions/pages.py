"""Saved pages: entries of listings, law-journal results and their texts, and single records, each from one scan of the page.

Every parser is a column expression over one page: an array of entries (title, author,
year, doi, abstract) or one record. Streams inside a page (summaries and encoded metadata,
lines and their marks) are brought together there, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.extract import unescape
from quillgraph.functions.normalize import _c
from quillgraph.functions.render import fix_ligatures

#: Fixed value: characters that an abstract has at least.
LEAST = 80
# Where a page names its DOI, in the order asked; the first hit of each counts if it is one.
DOI_PLACES = (
    r"""(?i)name=["'](?:citation_doi|dc\.identifier|prism\.doi)["']\s+content=["']([^"']+)["']""",
    r"""(?i)content=["']([^"']+)["']\s+name=["'](?:citation_doi|dc\.identifier)["']""",
    r"""(?i)"doi"\s*:\s*"([^"]+)\"""",
    r"""(?i)doi\.org/(10\.\d{4,9}/[^\s"'<>]+)""",
)
# Meta fields that hold an abstract, best first.
ABSTRACT_FIELDS = ("citation_abstract", "dc.description", "dcterms.abstract", "description", "og:description")
# Types that end a title in a list of results, the largest number of an entry, marks of the page's own buttons.
TYPES, MOST_ENTRIES, GLYPHS = "article|comments|notes|chapter|review", 400, "[✉🔖👍🔍✨⎙✏�]"
ENTRY = "struct<title:string,author:string,year:int,doi:string,abstract:string>"


def _group(x: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first match, null without one."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def _strip(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(x, F.lit(" \t\r\n\f\x0b"))


def _all(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def plain(x: Column) -> Column:
    """Text of markup: no scripts, styles and tags, white space squeezed; entities are for decoded()."""
    p = F.regexp_replace(x, r"(?is)<(script|style).*?</\1>", " ")
    return _strip(F.regexp_replace(F.regexp_replace(p, r"(?s)<[^>]+>", " "), r"\s+", " "))


def _entry(title, author, year, doi, abstract) -> Column:
    return F.struct(title.alias("title"), author.alias("author"), year.try_cast("int").alias("year"), doi.alias("doi"), abstract.alias("abstract"))


def _long(x: Column) -> Column:
    return F.when(F.length(x) >= LEAST, x)


# ── Single records ───────────────────────────────────────────────────────────
def record_doi(page) -> Column:
    """The page's own DOI in lower case: meta fields in either order, linked data, a resolver link."""
    p, found = F.coalesce(_c(page), F.lit("")), []
    for place in DOI_PLACES:
        d = F.regexp_replace(F.regexp_replace(_strip(_group(p, place)), r"(?i)^https?://(dx\.)?doi\.org/", ""), "(?i)^doi:", "")
        found.append(F.when(F.lower(d).startswith("10."), F.lower(d)))
    return F.coalesce(*found)


def record_title(page) -> Column:
    p = F.coalesce(_c(page), F.lit(""))
    places = (r"""(?i)name=["']citation_title["']\s+content=["']([^"']+)["']""", r"""(?i)property=["']og:title["']\s+content=["']([^"']+)["']""", r"(?is)<title>(.*?)</title>")
    return _strip(F.coalesce(*[_group(p, x) for x in places]))


def record_abstract(page) -> Column:
    """Struct of text and method, the first that is long enough: linked data, meta fields, blocks, a heading's paragraphs; null without one."""
    p = F.coalesce(_c(page), F.lit(""))
    items = lambda s: F.when(_strip(s).startswith("["), F.from_json(s, "array<string>")).otherwise(F.array(s))
    scripts = F.flatten(F.transform(_all(p, r"(?is)<script[^>]+ld\+json[^>]*>(.*?)</script>"), lambda s: F.coalesce(items(s), F.array().cast("array<string>"))))
    linked = F.filter(F.transform(scripts, lambda i: F.from_json(i, "struct<abstract:string,description:string>")), lambda o: o.isNotNull())
    texts = F.filter(F.transform(linked, lambda o: F.when(o["abstract"] != "", o["abstract"]).otherwise(o["description"])), lambda t: F.length(_strip(t)) >= LEAST)
    # Linked data is measured before its tags are taken off, everything else after.
    options = [("json-ld", plain(F.get(texts, F.lit(0))), F.lit(True))]
    for name in ABSTRACT_FIELDS:
        attr = r"""(?:name|property)=["']""" + name.replace(".", r"\.") + r"""["']"""
        value = F.coalesce(_group(p, rf"""(?is)<meta[^>]+{attr}[^>]+content=["'](.*?)["']\s*/?>"""), _group(p, rf"""(?is)<meta[^>]+content=["'](.*?)["'][^>]+{attr}"""))
        options.append((f"meta:{name}", plain(value), None))
    options += [
        ("philpapers.div.abstract", plain(_group(p, r"""(?is)<div[^>]+class=["'][^"']*abstract[^"']*["'][^>]*>(.*?)</div>""")), None),
        ("springer.Abs1", F.regexp_replace(plain(_group(p, r"""(?is)<section[^>]+id=["']Abs1[^"']*["'][^>]*>(.*?)</section>""")), r"(?i)^abstract[\s:]*", ""), None),
        ("generic.AbstractHeading", plain(_group(p, r"""(?is)>\s*abstract\s*<[^>]*>(?:</[^>]+>)?\s*(.*?)(?:<h\d|<section|<div\s+class=["'][^"']*(?:keyword|footer|reference))""")), None),
    ]
    return F.coalesce(*[F.when((F.length(t) >= LEAST) if sure is None else t.isNotNull(), F.struct(t.alias("text"), F.lit(k).alias("method"))) for k, t, sure in options])


def record_author(page) -> Column:
    return _group(F.coalesce(_c(page), F.lit("")), r"""(?is)<meta[^>]+name=["']citation_author["'][^>]+content=["'](.*?)["']""")


# ── Lists ────────────────────────────────────────────────────────────────────
def listing_rows(page) -> Column:
    """Entries of a listing page: what follows each class 'entry', if it has a title; empty for another page."""
    p = F.coalesce(_c(page), F.lit(""))

    def entry(part: Column) -> Column:
        encoded = F.try_url_decode(_group(part, r"""u=([^"'&]+)"""))
        doi = F.coalesce(_group(encoded, r"""(10\.\d{4,9}/[^\s"'<>&]+)"""), _group(part, r"""(?i)doi\.org/(10\.\d{4,9}/[^\s"'<>&]+)"""))
        year = _group(part, r"""class=['"]pubYear['"]\s*>(\d{4})""")
        return _entry(plain(_group(part, r"""(?s)class=['"]articleTitle recTitle['"]\s*>(.*?)</span>""")), plain(_group(part, r"""(?s)class=['"]name['"]\s*>(.*?)</span>""")), year, F.lower(doi), _long(plain(_group(part, r"""(?s)class=['"]abstract['"]\s*>(.*?)</div>"""))))

    parts = F.split(p, r"""class=['"]entry['"]""")
    rows = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), entry), lambda e: e["title"].isNotNull())
    return F.when(F.contains(p, F.lit("entryList")) | F.contains(p, F.lit("class='entry'")), rows).otherwise(F.array().cast(f"array<{ENTRY}>"))


def journal_summaries(page) -> Column:
    """Summaries (id, text) of a law-journal results page."""
    p = F.coalesce(_c(page), F.lit(""))
    span = r"""(?s)data-id="(hein\.journals/[^"]+)"\s+class="[^"]*full_summary_text"\s*>(.*?)</span>"""
    found = F.filter(F.arrays_zip(_all(p, span).alias("id"), F.transform(_all(p, span, 2), plain).alias("text")), lambda s: F.length(s["text"]) >= LEAST)
    marked = F.contains(p, F.lit("full_summary_text")) & F.contains(p, F.lit("Z3988"))
    return F.when(marked, found).otherwise(F.array().cast("array<struct<id:string,text:string>>"))


def journal_rows(page, summaries) -> Column:
    """Entries of such a page: encoded metadata of a handle, with the summary of the same id (the last). Entries without one are left out."""
    p, summaries = F.coalesce(_c(page), F.lit("")), _c(summaries)

    def entry(raw: Column) -> Column:
        fields = F.split(F.replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit("&amp;"), F.lit("&")), "&")
        values = lambda key: F.transform(F.filter(fields, lambda f: f.startswith(key + "=") & (F.length(f) > len(key) + 1)), lambda f: F.try_url_decode(F.substring(f, len(key) + 2, 1 << 30)))
        first = lambda key: F.get(values(key), F.lit(0))
        place = F.coalesce(F.try_url_decode(F.replace(first("rft_id"), F.lit("+"), F.lit("%2B"))), first("rft_id"))
        name = F.concat(_group(place, r"handle=(hein\.journals/[^&]+)"), F.lit("."), _group(place, r"[?&]div=(\d+)"))
        summary = F.get(F.reverse(F.filter(summaries, lambda s: s["id"] == name)), F.lit(0))["text"]
        authors = F.when(F.size(values("rft.au")) > 0, F.array_join(values("rft.au"), "; "))
        return _entry(_strip(first("rft.atitle")), authors, _group(first("rft.date"), r"(\d{4})"), F.lit(None).cast("string"), summary)

    rows = F.filter(F.transform(_all(p, r"""class="Z3988"\s+title="([^"]+)\""""), entry), lambda e: (e["title"] != "") & e["abstract"].isNotNull())
    return F.when(F.size(summaries) > 0, rows).otherwise(F.array().cast(f"array<{ENTRY}>"))


MARK = r"^\s*(\d{1,3})\.\s*(.*)$"


def journal_lines(text) -> Column:
    """Lines of a law-journal results page saved as text, its misreadings mended; none for another text."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.contains(t, F.lit("Law Journal Library")) | F.contains(t, F.lit("AI Summary")), F.split(fix_ligatures(t), "\n")).otherwise(F.array().cast("array<string>"))


def entry_places(lines) -> Column:
    """Places of the lines that open an entry: a small number and a point, then letters or nothing."""

    def opens(line: Column) -> Column:
        number, rest = _group(line, MARK), _strip(_group(line, MARK, 2))
        return F.coalesce((number.cast("int") <= MOST_ENTRIES) & ((rest == "") | rest.rlike("[A-Za-z]")), F.lit(False))

    return F.filter(F.transform(_c(lines), lambda line, i: F.when(opens(line), i)), lambda i: i.isNotNull())


def journal_text_rows(lines, places) -> Column:
    """Entries between the marks, over page breaks too: a type in brackets ends the title; entries without one are left out."""
    lines, places = _c(lines), _c(places)

    def block(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(places, k + 1), F.size(lines))
        head = _strip(_group(F.get(lines, at), MARK, 2))
        rest = F.slice(lines, at + 2, end - at - 1)
        return F.array_join(F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), rest), "\n")

    def entry(b: Column) -> Column:
        title = F.regexp_replace(_strip(F.regexp_replace(_group(b, rf"(?s)^(.*?)\[(?:{TYPES})\]"), r"\s+", " ")), GLYPHS, "")
        author = F.regexp_replace(_group(b, r"(?m)^([A-Z][^\n]*?)\s*\(Cited\s+[\d,]+\s+times?\)"), r"\s+", " ")
        doi = F.lower(F.rtrim(_group(b, r"DOI:\s*(?:https?://\S*?)?(10\.\d{4,9}/[^\s]+)"), F.lit(".,;")))
        summary = _strip(F.regexp_replace(_group(b, r"(?s)AI Summary\s*(.*?)\s*Read More"), r"\s+", " "))
        return _entry(_strip(title), _strip(author), _group(b, r"\((\d{4})(?:-\d{2,4})?\)"), doi, _long(summary))

    return F.filter(F.transform(F.transform(places, block), entry), lambda e: e["title"] != "")


# ── All kinds ────────────────────────────────────────────────────────────────
def _saved(kind: str, rows: Column, source: str, method: Column | None = None) -> Column:
    return F.transform(rows, lambda e: F.struct(F.lit(kind).alias("kind"), e["title"].alias("title"), e["author"].alias("author"), e["year"].alias("year"), e["doi"].alias("doi"), e["abstract"].alias("abstract"), F.lit(source).alias("source"), (method if method is not None else F.lit(None).cast("string")).alias("method")))


def saved_entries(pages: DataFrame, name_col: str = "name", text_col: str = "html") -> DataFrame:
    """pages (name, html or exported text), other columns kept: one row an entry (n, kind, title, author, year, doi, abstract, source, method).

    A name that ends in .pdf holds exported text; another page is a listing if it has entries, else a
    law-journal page if that has, else a single record. Decided and parsed page by page in one scan.
    Defined results: a null page is a single record without fields; a text without entries gives no row.
    """
    keep = [c for c in pages.columns if c != text_col]
    is_text = F.lower(_c(name_col)).endswith(".pdf")
    # A step of its own for whatever the entries of a page look up, so that it is made once a page.
    p = pages.select(*keep, F.col(text_col).alias("_page"), is_text.alias("_text"))
    p = p.withColumns({"_lines": F.when(F.col("_text"), journal_lines("_page")).otherwise(F.array().cast("array<string>")), "_summaries": F.when(F.col("_text"), F.array().cast("array<struct<id:string,text:string>>")).otherwise(journal_summaries("_page"))})
    p = p.withColumns({"_places": entry_places("_lines"), "_listed": listing_rows("_page"), "_journal": journal_rows("_page", "_summaries"), "_abstract": record_abstract("_page")})
    record = F.array(_entry(record_title("_page"), record_author("_page"), F.lit(None).cast("string"), record_doi("_page"), F.col("_abstract.text")))
    rows = (
        F.when(F.col("_text"), _saved("text", journal_text_rows("_lines", "_places"), "hein_ai_summary"))
        .when(F.size("_listed") > 0, _saved("listing", F.col("_listed"), "html_scrape"))
        .when(F.size("_journal") > 0, _saved("journal", F.col("_journal"), "hein_ai_summary"))
        .otherwise(_saved("record", record, "html_scrape", F.col("_abstract.method")))
    )
    out = p.select(*keep, F.posexplode(rows).alias("n", "e")).select(*keep, "n", "e.*")
    return out.withColumns({c: decoded(c) for c in ("title", "author", "abstract")})


def decoded(x) -> Column:
    """Entities as characters; only texts that hold one leave the JVM."""
    return F.when(F.contains(_c(x), F.lit("&")), unescape(x)).otherwise(_c(x))
