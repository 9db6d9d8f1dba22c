"""Tables of the literature model, derived from the given tables.

Each view is one SELECT that Spark and DuckDB both run: Spark through `view()`, DuckDB as a
common table expression through `with_views()`.

works      one row per document: identifiers, title, authors, year, venue, abstract, type
relevance  a score from 1 to 5 and a reason per work, some missing
issues     the questions that depth is scored on, with weights; one is not core
depths     depth 0 to 3 of each work in each issue, from how often the issue's stem occurs in the whole text
edges      citations with a hop, with duplicates and self-loops
counts     citation counts by source, with gaps
biblio     an external bibliography
letters    works with a title and an abstract of letters alone
cited      a text of two pages for each work, with cases, footnotes and endnotes
saved      a page saved for a work, of one of five kinds: a listing, a law journal's results, their text, a record with meta fields or linked data
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "works": (
        ("documents", "labels"),
        r"""
SELECT ord, CASE WHEN doi IS NOT NULL THEN concat('doi:', doi) ELSE concat('oa:W', CAST(ord AS STRING)) END AS key,
       doi, concat('W', CAST(ord AS STRING)) AS oa_id, CASE WHEN ord % 3 = 0 THEN concat('S', CAST(ord AS STRING)) ELSE 'None' END AS s2_id,
       title, surname, given,
       CASE ord % 3 WHEN 0 THEN concat(surname, ', ', given) ELSE concat(given, ' ', surname) END AS author1,
       CASE ord % 3 WHEN 2 THEN concat(given, ' ', venue, ' 1966-') END AS author2,
       year, venue, abstract, text_source, work_type, is_review, citations, is_seed, hop
FROM (
  SELECT d.doc_id AS ord,
         CASE WHEN d.doc_id % 6 = 5 THEN NULL
              WHEN d.doc_id % 20 = 0 THEN concat('10.1093/acprof:oso/97801992', CAST((d.doc_id - d.doc_id % 20) AS STRING), '.001.0001')
              WHEN d.doc_id % 20 IN (1, 2, 3) THEN concat('10.1093/acprof:oso/97801992', CAST((d.doc_id - d.doc_id % 20) AS STRING), '.003.000', CAST(d.doc_id % 20 AS STRING))
              WHEN d.doc_id % 20 = 6 THEN concat('10.2307/', CAST(d.doc_id AS STRING))
              WHEN d.doc_id % 20 = 7 THEN concat('10.5860/choice.', CAST(d.doc_id AS STRING))
              WHEN d.doc_id % 20 IN (8, 9) THEN concat('10.1017/cbo978', CAST((d.doc_id - d.doc_id % 20) AS STRING), CASE WHEN d.doc_id % 20 = 9 THEN '.004' ELSE '' END)
              ELSE concat('10.1111/W.', CAST(d.doc_id % 4999 AS STRING)) END AS doi,
         substr(coalesce(d.text, ''), 1, 60) AS title,
         regexp_replace(split_part(lower(substr(coalesce(d.text, ''), 1, 60)), ' ', 1), '[^a-z]', '', 'g') AS surname,
         upper(substr(coalesce(d.lang, 'x'), 1, 1)) AS given,
         CAST(1980 + d.n_chars % 45 AS INT) AS year, d.source AS venue,
         CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE coalesce(d.text, '') END AS abstract,
         CASE WHEN d.doc_id % 7 = 0 THEN 'title' WHEN d.doc_id % 13 = 0 THEN 'full' ELSE 'abstract' END AS text_source,
         CASE WHEN d.doc_id % 20 IN (0, 6, 8) THEN 'book' WHEN d.doc_id % 20 IN (1, 2, 3, 9) THEN 'book-chapter'
              WHEN d.doc_id % 20 = 4 THEN 'other' ELSE 'article' END AS work_type,
         coalesce(l.quality = 0, FALSE) AS is_review,
         CAST((d.doc_id * 37) % 101 AS BIGINT) AS citations, d.doc_id % 50 = 0 AS is_seed, CAST(d.doc_id % 4 AS INT) AS hop
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) t
""",
    ),
    "relevance": (
        ("works",),
        """
SELECT key, CAST(1 + (ord * 7 + year) % 5 AS INT) AS score,
       CASE WHEN (ord * 7 + year) % 5 = 0 THEN 'failed keyword pre-filter' ELSE concat('scored ', venue) END AS reason,
       (ord * 7 + year) % 5 = 0 AS deferred
FROM {works} WHERE ord % 17 <> 3
""",
    ),
    "issues": (
        (),
        """
SELECT * FROM (VALUES ('A1', 'the', 1.5e0, TRUE, 0), ('A2', 'tion', 1.5e0, TRUE, 1), ('A3', 'on', 1e0, TRUE, 2),
  ('A4', 'er', 1e0, TRUE, 3), ('A5', 'an', 0.5e0, TRUE, 4), ('B1', 'que', 1e0, FALSE, 5)) AS t(issue_id, stem, weight, core, ord)
""",
    ),
    "depths": (
        ("documents", "works", "issues"),
        """
SELECT w.key, x.issue_id, x.depth
FROM (SELECT d.doc_id, i.issue_id, CAST(least(3, floor((length(d.t) - length(replace(d.t, i.stem, ''))) * 30.0 / greatest(1, d.n))) AS INT) AS depth
      FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, length(coalesce(text, '')) AS n FROM {documents}) d CROSS JOIN {issues} i) x
JOIN {works} w ON w.ord = x.doc_id
""",
    ),
    "edges": (
        ("lineitem", "documents", "works"),
        """
SELECT s.key AS src, t.key AS dst, e.hop, e.ord
FROM (
  SELECT l_orderkey % n AS a, CAST(floor((l_partkey % n) * ((l_suppkey * 7919) % n) / (n * 1.0)) AS BIGINT) AS b,
         CAST(1 + l_orderkey % 2 AS INT) AS hop,
         ((l_orderkey * 8 + l_linenumber) * 4000037 + l_partkey) * 4001 + l_suppkey AS ord
  FROM {lineitem} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c) e
JOIN {works} s ON s.ord = e.a JOIN {works} t ON t.ord = e.b
""",
    ),
    "counts": (
        ("works",),
        """
SELECT key, CASE WHEN ord % 8 = 0 THEN NULL ELSE citations END AS openalex,
       CASE WHEN ord % 5 = 1 THEN NULL ELSE CAST(floor(citations * (1 + ord % 4) / 4.0) AS BIGINT) END AS crossref,
       CASE WHEN ord % 3 <> 2 THEN NULL ELSE CAST(floor(citations * (1 + ord % 3) / 6.0) AS BIGINT) END AS scopus
FROM {works}
""",
    ),
    "biblio": (
        ("benchmark",),
        """
SELECT item_id, concat('list', CAST(item_id % 4 AS STRING)) AS bib, substr(text, 1, 60) AS title,
       regexp_replace(split_part(lower(substr(text, 1, 60)), ' ', 1), '[^a-z]', '', 'g') AS surname
FROM {benchmark}
""",
    ),
    "letters": (
        ("works",),
        """
SELECT ord, key, year, surname, CAST(year AS STRING) AS ys, CAST(ord AS STRING) AS os,
       trim(regexp_replace(title, '[^A-Za-z]+', ' ', 'g')) AS t, trim(regexp_replace(abstract, '[^A-Za-z]+', ' ', 'g')) AS a, coalesce(doi, '') AS d
FROM {works}
""",
    ),
    "cited": (
        ("letters",),
        """
SELECT CASE WHEN ord % 9 = 4 THEN concat('Justification ', os) ELSE concat('text', os) END AS stem, ord, concat('--- Page 1 ---\n', a,
  '\nIt was held in Smith Sons v. Xa', surname, ' Towing, ', os, ' F.2d 169 (2d Cir. 1947); and [19', CAST(10 + ord % 80 AS STRING), '] AC 562 or 375 U.S. ', os, '\nDownloaded from https://x.org/', os, ' by someone\n',
  CAST(1 + ord % 30 AS STRING), ' See ', t, ' and others (', ys, ')\nas ', surname, ' wrote it\n\n', CAST(2 + ord % 30 AS STRING), '  Id. at 1', CAST(ord % 10 AS STRING), ' with some further words\nmore words\n--- Page 2 ---\n   ',
  CAST(1 + ord % 30 AS STRING), ' See ', surname, ' on blame and risk, page 4\nshort line\n  7 Ibid. a second note of this page, 2001\nits end\nNotes\n1.\nFirst, ', t, '\n2.\n', surname, '\n3. no note\n') AS text
FROM {letters}
""",
    ),
    "saved": (
        ("letters",),
        """
SELECT ord, CASE WHEN ord % 5 = 2 THEN concat('p', os, '.pdf') ELSE concat('p', os, '.html') END AS name,
  CASE ord % 5
  WHEN 0 THEN concat('<ol class="entryList"><li class="entry"><span class="articleTitle recTitle">', t, '</span> <span class="name">', surname, '</span><span class="pubYear">', ys,
    '</span><div class="abstract"><p>', a, '</p></div><a href="go.pl?u=https%3A%2F%2Fdx.doi.org%2F', replace(replace(d, '/', '%2F'), ':', '%3A'),
    '">x</a></li><li class="entry"><span class="articleTitle recTitle">Second ', t, '</span></li></ol>')
  WHEN 1 THEN concat('<span class="Z3988" title="rft.atitle=', replace(t, ' ', '+'), '&amp;rft.au=', surname, '&amp;rft.au=Second+One&amp;rft.date=', ys, '&amp;rft_id=http%3A%2F%2Fx%3Fhandle%3Dhein.journals%2Fj', os, '%26div%3D', ys,
    '"></span><span data-id="hein.journals/j', os, '.', ys, '" class=" d-none full_summary_text"><strong>Thesis</strong> ', a, '</span>')
  WHEN 2 THEN concat('Law Journal Library\n--- Page 1 ---\n1.\n', replace(t, ' ', '\n'), ' [article]\n4 J. L. 9 (', ys, ')\nX', surname, ' (Cited 1,0', CAST(ord % 7 AS STRING), ' times)\nDOI: https://doi.org/', d, '.\nAI Summary\n', a,
    '\n--- Page 2 ---\nend Read More\n2. Second ', t, ' [notes]\n12. 3\n')
  WHEN 3 THEN concat('<meta name="citation_title" content="', t, '"><meta name="citation_author" content="', surname, '"><meta name="citation_doi" content="doi:', d, '"><meta name="description" content="', a, '">')
  ELSE concat('<title> ', t, ' </title><script type="application/ld+json">[1, {{"abstract": "", "description": "', a, '"}}]</script><a href="https://doi.org/', d, '">') END AS html
FROM {letters}
""",
    ),
}


def _needed(names) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in VIEWS:
            out += [x for x in _needed(VIEWS[name][0]) if x not in out]
            out += [name] if name not in out else []
    return out


def view(spark: SparkSession, sf_dir: str, name: str, read=None) -> DataFrame:
    """A view, or the table of that name. `read` gives the views that it needs; they are made anew without it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, text = VIEWS[name]
    read = read or (lambda x: view(spark, sf_dir, x))
    # Spark's regexp_replace replaces all matches and knows no flags.
    return spark.sql(text.replace(", 'g')", ")"), **{x: read(x) for x in inputs})


def with_views(query: str, *names: str) -> str:
    """The query for DuckDB, with the views it names (and those they need) before it."""
    parts = []
    for name in _needed(names):
        inputs, text = VIEWS[name]
        body = text.format(**{x: x for x in inputs}).replace("AS STRING", "AS VARCHAR")
        parts.append(f"{name} AS ({body})")
    query = query.strip()
    if query[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + query[5:]
    return "WITH " + ",\n".join(parts) + "\n" + query
