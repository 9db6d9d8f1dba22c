"""Boolean and classifying column functions over works, references and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.normalize import _c

# The three arms of the relevance gate, as lists of stems and phrases.
THEORY_TERMS = (
    "moral|ethics|ethical|culpab|blame|blameworthi|responsib|intention|reckless|negligent|negligence|excuse|justif|volunt|involunt|mens.rea|"
    "fault|wrongdo|harm|corrective.justice|punishment|retribut|philosophy|philosophical|virtue|character|capacit|omission|"
    "attributab|answerab|accountab|reactive.attitude|resentment|reasons.responsiv|free.will|ignorance|epistemic|agent|agency"
)
LAW_TERMS = (
    "law|legal|tort|criminal|liability|defendant|plaintiff|court|statute|doctrine|standard|reasonable.person|strict.liability|"
    "common.law|penal|civil|jury|judge|verdict|objectively"
)
ACTION_TERMS = (
    "attributab|answerab|accountab|reactive.attitude|resentment|reasons.responsiv|free.will|blameworthi|culpab|negligence|"
    "ignorance.*moral|moral.*ignorance|moral.responsib"
)
# Marks of reviews, chapters and kinds of books.
REVIEW_DOI = r"10\.5860/choice|10\.1353/"
REVIEW_TEXT = r"(?i)\bthis (?:book )?review\b|\bbook review\b|\breviewed by\b|\bis a review of\b|\breview essay\b|\bin this review\b"
REVIEW_TITLE = r"(?i)\breview of\b|\bbook review\b|:\s*a review\b|^review[:\s]"
REVIEW_OPENING = r"(?i)\bthis book review\b|\bin this book review\b|\bbooks? under review\b|\breviewed by\b"
REVIEW_VENUES = ("10.5860/choice.", "/choice.", "ndpr")
SHORT_PAGES = 2
CHAPTER_DOI = ("9780", "9781", "acprof:oso", "acprof:osobl", "oso/97", "oxfordhb", "med/97", "wbiee", "cbo97", "/9781", "/9780")
CHAPTER_TYPES = ("book", "book-chapter", "chapter", "other")
TEXTBOOK = ("criminal law: theory and doctrine", "textbook", "casebook", "principles of", "law: text", "criminal law (")
COLLECTION = ("selected essays", "and other essays", "collected", "essays in the philosophy")
EDITED = ("handbook", "companion", "oxford studies", "oxford essays", "essays in", "edited", "(eds", "eds)", "reconsidered", "new essays", "perspectives on", "modern histories")
SYNOPSIS = r"(?i)\bbook synopsis\b|\bsynopsis:\b|\bpublisher'?s? (?:description|blurb)\b|\bfrom the (?:back )?cover\b|\babout this book\b"
CASE_PATTERNS = (
    r"\bv\.\s+[A-Z]",
    r"\d+\s+(?:U\.S\.|F\.\d[a-z]*|S\.\s*Ct\.|L\.Ed\.|Eng\.\s*Rep\.)",
    r"\[\d{4}\]\s+\d*\s*[A-Z]{1,5}\s+\d+",
    r"\d+\s+[A-Z]\.E\.\d[a-z]*\s+\d+",
    r"\d+\s+[A-Z]\.[A-Z]\.\d*\s+\d+",
)


def any_part(x: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def keyword_gate(title, abstract=None, theory: str = THEORY_TERMS, law: str = LAW_TERMS, action: str = ACTION_TERMS, inflected: bool = False) -> Column:
    """(theory and law) or action, as whole words in title and abstract. inflected: a stem may go on."""
    text = F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(abstract), F.lit("")) if abstract is not None else F.lit(""))
    end = "" if inflected else r"\b"
    hit = lambda arm: text.rlike(rf"(?i)\b({arm}){end}")
    return (hit(theory) & hit(law)) | hit(action)


def has_text(x) -> Column:
    return F.coalesce(F.trim(_c(x)) != "", F.lit(False))


def good_abstract(x, least: int = 60) -> Column:
    return F.coalesce(F.length(F.trim(_c(x))) >= least, F.lit(False))


def merge_review(is_review, doi, abstract) -> Column:
    """Flag, review venue, or a review's wording in the abstract's first 400 characters: must not be merged into the work."""
    return (
        F.coalesce(_c(is_review), F.lit(False))
        | F.coalesce(_c(doi).rlike(REVIEW_DOI), F.lit(False))
        | F.coalesce(F.substring(_c(abstract), 1, 400).rlike(REVIEW_TEXT), F.lit(False))
    )


def strong_review(title, doi, abstract) -> Column:
    d = F.regexp_replace(F.lower(F.coalesce(_c(doi), F.lit(""))), "^doi:", "")
    return F.coalesce(_c(title), F.lit("")).rlike(REVIEW_TITLE) | any_part(d, REVIEW_VENUES) | F.substring(F.coalesce(_c(abstract), F.lit("")), 1, 400).rlike(REVIEW_OPENING)


def tagged_review(title, doi, abstract, pages) -> Column:
    """A strong cue, or a title that ends in a full stop with a DOI and at most two pages."""
    weak = F.coalesce(_c(title), F.lit("")).rlike(r"\.\s*$") & F.coalesce(_c(doi) != "", F.lit(False)) & F.coalesce(_c(pages) <= SHORT_PAGES, F.lit(False))
    return strong_review(title, doi, abstract) | weak


def normal_type(t) -> Column:
    low = F.lower(_c(t))
    return (
        F.when(low.isin("book", "monograph"), "book")
        .when(low.isin("book-chapter", "book-part", "reference-entry"), "book-chapter")
        .when(low.isin("article", "journal-article", "posted-content", "preprint"), "article")
        .when(low != "", low)
    )


def guessed_type(doi, venue) -> Column:
    d, v = F.lower(F.coalesce(_c(doi), F.lit(""))), F.lower(F.coalesce(_c(venue), F.lit("")))
    return (
        F.when(d.rlike(r"\.001\.0001$"), "book")
        .when(any_part(d, ("acprof:oso", "/oso/")), F.when(F.contains(d, F.lit(".003.")), "book-chapter").otherwise("book"))
        .when(any_part(v, ("handbook", "companion", "(ed", "eds)", "edited")), "book-chapter")
    )


def chapter_like(doi, work_type) -> Column:
    return F.coalesce(_c(work_type).isin(*CHAPTER_TYPES), F.lit(False)) | any_part(F.lower(F.coalesce(_c(doi), F.lit(""))), CHAPTER_DOI)


def book_kind(title, editors=None, authors=None) -> Column:
    """Title cues, then numbers of editors and authors, then monograph."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    kind = F.when(any_part(t, TEXTBOOK), "textbook").when(any_part(t, COLLECTION), "essay-collection").when(any_part(t, EDITED), "edited")
    if editors is not None:
        kind = F.coalesce(kind, F.when((_c(editors) > 0) & (_c(editors) >= _c(authors)), "edited"))
    return F.coalesce(kind, F.lit("monograph"))


def case_citation(x) -> Column:
    out = F.lit(False)
    for p in CASE_PATTERNS:
        out = out | _c(x).rlike(p)
    return out


def link_of(doi, oa_id, s2_id) -> Column:
    real = lambda x: F.when((F.trim(_c(x)) != "") & ~F.lower(F.trim(_c(x))).isin("none"), F.trim(_c(x)))
    return F.coalesce(
        F.concat(F.lit("https://doi.org/"), real(doi)), F.concat(F.lit("https://openalex.org/"), real(oa_id)), F.concat(F.lit("https://www.semanticscholar.org/paper/"), real(s2_id)), F.lit("")
    )


def reconciled_citedness(openalex, crossref, scopus) -> Column:
    """Struct of chosen count, its source, and whether the sources diverge.

    The broad count diverges from 3 times the smallest other (at least 1) and 8 more than it on;
    then the smaller other is taken. Otherwise scopus, crossref, openalex in this order.
    """
    oa, cr, sc = _c(openalex), _c(crossref), _c(scopus)
    low = F.least(cr, sc)
    diverged = F.coalesce(low.isNotNull() & (oa >= F.greatest(F.lit(3) * F.greatest(low, F.lit(1)), low + 8)), F.lit(False))
    chosen = F.when(diverged, low).otherwise(F.coalesce(sc, cr, oa))
    source = F.when(diverged, F.when(sc.isNotNull() & (sc == low), "scopus").otherwise("crossref")).when(sc.isNotNull(), "scopus").when(cr.isNotNull(), "crossref").when(oa.isNotNull(), "openalex")
    return F.struct(chosen.alias("citedness"), source.alias("citedness_source"), diverged.alias("cite_diverged"))


def reliable_citedness(chosen, diverged, chapter, year, this_year: int = 2026, recent: int = 4) -> Column:
    return _c(chosen).isNotNull() & ~_c(chapter) & ~_c(diverged) & ~F.coalesce(F.lit(this_year) - _c(year) < recent, F.lit(False))
