"""Column functions: identifiers, titles, names, numbers. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a tidied title leaves small.
SMALL_WORDS = "a an and as at but by for from in into nor of on onto or over per the to up via vs vs. with but is so".split()
# Words that a title's opening is compared without.
LEAD_STOP = ["the", "a", "an", "on", "of", "in", "to", "for", "and", "or", "is", "are", "some", "what", "how", "why", "does", "do", "as", "from", "with", "two", "no", "not", "this", "that"]
# Words without weight when a title is looked for in an abstract.
SIGNIFICANT_STOP = "the a an of on in to and or for is its with without by as at from essay selected essays edition vol volume part introduction".split()
#: Latin letters with marks, the letters they are without them, and the marks themselves, which go: by Unicode's own decomposition.
_LATIN = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFKD", c)[0] != c and all(map(unicodedata.combining, unicodedata.normalize("NFKD", c)[1:]))]
MARKED = "".join(_LATIN) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _LATIN)

RESOLVER = r"^https?://(dx\.)?doi\.org/"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(x) -> Column:
    return F.when(F.trim(_c(x)) != "", _c(x))


def coalesce_nonempty(*xs) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[empty_to_null(x) for x in xs])


# ── DOI forms (the parts of the reference differ; each keeps its own) ────────
def doi_lower_trimmed(x) -> Column:
    """Lower case, and every leading character of 'https://doi.org/' stripped as a set."""
    return F.ltrim(F.lower(F.trim(_c(x))), F.lit("https://doi.org/"))


def doi_bare(x) -> Column:
    """Without a resolver prefix, case kept."""
    return F.regexp_replace(F.trim(_c(x)), "(?i)" + RESOLVER, "")


def doi_unprefixed(x) -> Column:
    """Without a resolver prefix and then without 'doi:', case kept."""
    return F.regexp_replace(doi_bare(x), "(?i)^doi:", "")


def doi_lower(x) -> Column:
    """Lower case, without 'doi:' and then without a resolver; null if nothing is left."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "^doi:", ""), RESOLVER, "")
    return F.when(d != "", d)


def doi_everywhere(x) -> Column:
    """Every 'doi:' removed, then the resolver."""
    return F.regexp_replace(F.replace(_c(x), F.lit("doi:"), F.lit("")), "(?i)" + RESOLVER, "")


def doi_of_key(key, doi) -> Column:
    """The DOI in a key, or the work's own."""
    return F.when(_c(key).startswith("doi:"), F.substring(_c(key), 5, 2_000)).otherwise(doi_unprefixed(doi))


# ── Titles ───────────────────────────────────────────────────────────────────
def deaccent(x) -> Column:
    return F.translate(_c(x), MARKED, PLAIN)


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def title_spaced(x) -> Column:
    """Lower case, other than a-z, 0-9 and space to a space, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def title_plain(x) -> Column:
    """As title_spaced, marks taken off first."""
    return title_spaced(deaccent(F.lower(_c(x))))


def title_runs(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", " "))


def title_stripped(x) -> Column:
    """Lower case, other than a-z, 0-9 and space removed, not squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9 ]", ""))


def title_joined(x) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]", "")


def title_words(x) -> Column:
    """Punctuation to spaces, letters of any script kept."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[^\w\s]", " "))


def title_stub(x, n: int = 60) -> Column:
    """Punctuation removed, letters of any script kept, squeezed, cut."""
    return F.substring(squeeze(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[^\w\s]", "")), 1, n)


def tokens(title: Column, least: int) -> Column:
    return F.filter(F.split(title, " "), lambda w: F.length(w) >= least)


def title_tokens(x, least: int = 4) -> Column:
    return F.array_distinct(tokens(title_plain(x), least))


def title_sequence(x, least: int = 3) -> Column:
    stop = F.array(*[F.lit(w) for w in LEAD_STOP])
    return F.filter(F.split(title_plain(x), " "), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def head_overlap(a: Column, b: Column, head: int = 3) -> Column:
    """Share of a's first `head` words that stand among b's first head + 1."""
    first, among = F.slice(a, 1, head), F.slice(b, 1, head + 1)
    return F.when(F.size(first) == 0, F.lit(0.0)).otherwise(F.size(F.filter(first, lambda w: F.array_contains(among, w))) / F.size(first))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's words that b has too."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def significant_tokens(x) -> Column:
    stop = F.array(*[F.lit(w) for w in SIGNIFICANT_STOP])
    spaced = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9 ]", " ")
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def tidy_title(x) -> Column:
    """A title in capitals becomes a title in title case; short words stay small but at the ends, vowel-less acronyms stay."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    upper, lower = F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")), F.regexp_count(t, F.lit("[a-zà-öø-ÿ]"))
    shouting = (upper + lower >= 4) & (lower / F.greatest(upper + lower, F.lit(1)) <= 0.10)
    words = F.split(t, " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])

    def cased(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, r"[^\wÀ-ÿ]", "")
        acronym = core.rlike("^[A-ZÀ-ÖØ-Þ]{2,4}$") & ~core.rlike("[AEIOUYaeiouy]")
        low = F.lower(w)
        lead = F.regexp_extract(low, r"^[^a-zà-öø-ÿ]*", 0)
        first = F.length(lead) + 1
        titled = F.concat(lead, F.upper(low.substr(first, F.lit(1))), low.substr(first + 1, F.length(low)))
        inner = (i > 0) & (i < F.size(words) - 1)
        return F.when(acronym, w).when(inner & F.array_contains(small, F.regexp_replace(low, r"[^\wÀ-ÿ]", "")), low).otherwise(titled)

    return F.when(~shouting, t).otherwise(F.array_join(F.transform(words, cased), " "))


# ── Names ────────────────────────────────────────────────────────────────────
def _family(name: Column) -> Column:
    """Before a comma, or else the last word."""
    return F.when(F.contains(name, F.lit(",")), F.split_part(name, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def surname_letters(author) -> Column:
    """Family name as a-z letters, null if none is left."""
    s = F.regexp_replace(F.lower(_family(_c(author))), "[^a-z]", "")
    return F.when(s != "", s)


def surname_plain(author) -> Column:
    return surname_letters(deaccent(author))


def surname_shown(author) -> Column:
    """Family name as shown: case kept, trailing years dropped."""
    a = F.trim(F.coalesce(_c(author), F.lit("")))
    kept = F.filter(F.split(a, r"\s+"), lambda w: ~w.rlike(r"^\d{3,4}[-–]?$"))
    last = F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(a)
    return F.when(a == "", F.lit("")).when(F.contains(a, F.lit(",")), F.trim(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(last)


def author_short(authors) -> Column:
    """One name, two with '&', or the first with 'et al.'; a dash for none."""
    s = F.filter(F.transform(F.coalesce(_c(authors), F.array().cast("array<string>")), surname_shown), lambda x: x != "")
    n = F.size(s)
    return F.when(n == 0, F.lit("—")).when(n == 1, F.get(s, F.lit(0))).when(n == 2, F.concat(F.get(s, F.lit(0)), F.lit(" & "), F.get(s, F.lit(1)))).otherwise(F.concat(F.get(s, F.lit(0)), F.lit(" et al.")))


# ── Keys ─────────────────────────────────────────────────────────────────────
def node_key(doi, oa_id, s2_id, title) -> Column:
    return F.coalesce(
        F.when(_c(doi) != "", F.concat(F.lit("doi:"), _c(doi))),
        F.when(_c(oa_id) != "", F.concat(F.lit("oa:"), _c(oa_id))),
        F.when(_c(s2_id) != "", F.concat(F.lit("s2:"), _c(s2_id))),
        F.concat(F.lit("title:"), title_stub(title)),
    )


def identity(doi, oa_id, s2_id, title) -> Column:
    """One name for a work under any of its keys. The words None and none count as absent."""
    d = F.lower(F.trim(_c(doi)))
    oa, s2 = F.trim(_c(oa_id)), F.trim(_c(s2_id))
    return F.coalesce(
        F.when((d != "") & (d != "none"), F.concat(F.lit("doi:"), F.regexp_replace(d, RESOLVER, ""))),
        F.when((oa != "") & (oa != "None"), F.concat(F.lit("oa:"), oa)),
        F.when((s2 != "") & (s2 != "None"), F.concat(F.lit("s2:"), s2)),
        F.concat(F.lit("title:"), F.lower(F.trim(F.coalesce(_c(title), F.lit(""))))),
    )


def reference_identity(doi, title, year) -> Column:
    t = F.substring(title_words(title), 1, 60)
    return F.coalesce(F.concat(F.lit("doi:"), doi_lower(doi)), F.concat(F.lit("t:"), t, F.lit("|"), F.coalesce(_c(year).cast("string"), F.lit(""))))


def key_rank(key) -> Column:
    return F.when(_c(key).startswith("doi:"), 3).when(_c(key).startswith("oa:"), 2).when(_c(key).startswith("s2:"), 1).otherwise(0)


def type_rank(work_type) -> Column:
    return F.when(_c(work_type) == "book", 3).when(_c(work_type).isin("book-chapter", "dissertation"), 2).when(_c(work_type) == "article", 1).otherwise(0)


def source_rank(text_source) -> Column:
    return F.when(_c(text_source) == "full", 2).when(_c(text_source) == "abstract", 1).otherwise(0)


#: Endings of DOIs of whole books and of chapters, in order of precedence.
STEMS = r"^(?:(.*?)\.001\.0001|(.*?)\.00[13]\.\d{4}|(.*cbo\d+)\.\d+|(.*cbo\d+))$"


def doi_stem(key) -> Column:
    """Stem that a book and its chapters share."""
    d = F.when(_c(key).startswith("doi:"), F.lower(F.substring(_c(key), 5, 2_000)))
    return F.when(d.rlike(STEMS), F.regexp_replace(d, STEMS, "$1$2$3$4"))


def doi_role(key) -> Column:
    d = F.when(_c(key).startswith("doi:"), F.lower(F.substring(_c(key), 5, 2_000)))
    return F.when(d.rlike(r"\.001\.0001$"), "book").when(d.rlike(r"\.00[13]\.\d{4}$"), "chapter").when(d.rlike(r"cbo\d+\.\d+$"), "chapter").when(d.rlike(r"cbo\d+$"), "book")


# ── Numbers and other values ─────────────────────────────────────────────────
def safe_int(x) -> Column:
    return _c(x).try_cast("int")


def page_span(raw) -> Column:
    """Pages of 'first-last', 1 for a single page, null for anything else or more than 2000."""
    parts = F.split(F.trim(_c(raw)), "[-–]")
    numbers = F.filter(parts, lambda p: p.rlike(r"^\d{1,5}$"))
    span = F.get(numbers, F.lit(1)).try_cast("int") - F.get(numbers, F.lit(0)).try_cast("int") + 1
    return F.when(F.size(parts) <= 2, F.when(F.size(numbers) == 1, F.lit(1)).when((F.size(numbers) == 2) & span.between(1, 2000), span))


def cites_per_year(cites, year, this_year: int = 2026) -> Column:
    """One decimal; null without a count or a year."""
    return F.when((_c(year) != 0) & _c(cites).isNotNull(), F.round(_c(cites) / F.greatest(F.lit(1), F.lit(this_year) - _c(year)), 1))


def citer_weight(leverage) -> Column:
    """3 from leverage 15 on, 2 from 9 on, else 1."""
    return F.when(_c(leverage) >= 15, 3.0).when(_c(leverage) >= 9, 2.0).otherwise(1.0)


def inverted_index_text(index, keep_gaps: bool = True) -> Column:
    """Text of a map from words to places. A later word wins a place; gaps give empty words, or none."""
    pairs = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    by_place = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["at"])), lambda at: F.struct(at, F.element_at(F.filter(pairs, lambda p: p["at"] == at), -1)["word"])))
    last = F.array_max(F.transform(pairs, lambda p: p["at"]))
    whole = F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda i: F.element_at(by_place, i))
    words = F.transform(whole, lambda w: F.coalesce(w, F.lit(""))) if keep_gaps else F.filter(whole, lambda w: w.isNotNull())
    return F.when(F.size(_c(index)) > 0, F.trim(F.array_join(words, " "))).otherwise("")


def json_block(x) -> Column:
    """Text between the marks of a fenced block, or the text itself, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def first_object(x) -> Column:
    """From the first opening brace of a text to the one that closes it, by a count of depth over its braces; null without."""
    t = _c(x)
    begin = F.instr(t, "{")
    marks = F.filter(F.transform(F.split(t, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("at"))), lambda m: (m["c"] == "{") | (m["c"] == "}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("end"))
    step = lambda s, m: F.when((s["end"] > 0) | (m["at"] < begin), s).otherwise(F.struct((s["depth"] + F.when(m["c"] == "{", 1).otherwise(-1)).alias("depth"), F.when((s["depth"] == 1) & (m["c"] == "}"), m["at"]).otherwise(0).alias("end")))
    end = F.aggregate(marks, start, step)["end"]
    return F.when((begin > 0) & (end > 0), F.substring(t, begin, end - begin + 1))


def json_object(x) -> Column:
    """The object of an answer: the fenced text itself if it is one, else the first balanced object in it."""
    block = json_block(x)
    whole = F.try_parse_json(block)
    return F.when(whole.isNotNull(), block).otherwise(first_object(block))


def safe_filename(x, n: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9 _.-]", ""), r"\s+", "_"), 1, n)


def html_escape(x) -> Column:
    out = F.replace(_c(x), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_tags(x) -> Column:
    return squeeze(F.regexp_replace(_c(x), "<[^>]+>", " "))


def title_search_url(base: str, title) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.substring(_c(title), 1, 120)))
