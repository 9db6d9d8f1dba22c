"""Notes and case citations of texts: endnotes, footnotes in two forms, citation-like blocks, cases in two forms.

A text is cut into pages; what belongs to a note is found in the arrays of its page's
lines, so no line is shuffled. Only the choice of a number's longest body groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.extract import PAGE, REPORTER, UK_CASE, references_section
from quillgraph.functions.normalize import _c

# Lines that publishers print into a text, and those of another press around its chapters.
NOISE = (
    r"Downloaded from https?://\S+ by [^\n]+", r"Electronic copy available at: https?://\S+", r"https://doi\.org/\S+\s+Published online by Cambridge University Press",
    r"Online ISBN:[^\n]+", r"Print ISBN:[^\n]+", r"Published online:[^\n]+", r"Published in print:[^\n]+",
)
# Openings of notes, as the rules of the parser, of the report and of endnotes have them.
OPENING = r"""^\s{0,6}(\d{1,3})[\s\x{2002}\x07]{1,6}((?:See|Id\.|Ibid\.|[A-Z][a-zA-Z"]).{15,})"""
BLOCK = r"(\d{1,3})\s+((?:See|Id\.|Ibid|[A-Z][a-z]+).{20,})"
NOTES_HEADING, ENDNOTE = r"(?im)^\s*Notes\s*$", r"(?m)^\d{1,3}\.\s*\n"
# A case by its parties and, if given, its reporter. NAME holds no digit, so a name ends where its run of such characters does.
NAME, NAME_REPORT = r"A-Za-z\s&.,", r"A-Za-z\s&.,'"
CASE = rf"[A-Z][{NAME}]+\bv\.\s+[A-Z][{NAME}]+(?:,\s*\d+\s+[A-Z][A-Za-z.]+(?:\s+\d+[a-z]*)?\s+\d+(?:\s*\([^)]+\))?)?"
CASE_REPORT = rf"[A-Z][{NAME_REPORT}]+\s+v\.?\s+[A-Z][{NAME_REPORT}]+(?:,\s*\d+\s+[A-Z][A-Za-z.]+(?:\s+\d+[a-z]*)?(?:\s+\d+)?)?"


def clean_noise(text) -> Column:
    t = _c(text)
    for pattern in NOISE:
        t = F.regexp_replace(t, pattern, "")
    return t


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def endnotes(text) -> Column:
    """Array of (number, body) after the first heading 'Notes': a number and a point alone on a line open one."""
    parts = F.split(clean_noise(text), NOTES_HEADING, 2)
    section = F.get(parts, F.lit(1))
    numbers = F.regexp_extract_all(section, F.lit(r"(?m)^(\d{1,3})\.\s*\n"), F.lit(1))
    bodies = F.split(section, ENDNOTE)
    rows = F.arrays_zip(numbers.alias("number"), F.transform(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), _squeezed).alias("body"))
    return F.when(section.isNotNull(), F.filter(rows, lambda r: r["body"] != "")).otherwise(F.array().cast("array<struct<number:string,body:string>>"))


def _page_notes(page: DataFrame, skipped: str, lines: int) -> DataFrame:
    """Rows with a page's `lines`: n, number, body. A note goes on over the next lines that are neither blank nor skipped, `lines` at most, up to an opening among them."""
    rows = page.withColumn("kept", F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.alias("text"), r.rlike(OPENING).alias("opens"), (~r.rlike(r"^\s*$") & ~r.rlike(skipped)).alias("goes"))))
    rows = rows.withColumns({"opened": F.filter("kept", lambda r: r["opens"]), "more": F.filter("kept", lambda r: r["goes"])})

    def note(o: Column) -> Column:
        after = F.slice(F.filter(F.col("more"), lambda r: r["i"] > o["i"]), 1, lines)
        stop = F.array_position(F.transform(after, lambda r: r["opens"]), F.lit(True)).cast("int")
        taken = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
        first = F.regexp_extract(o["text"], OPENING, 2)
        whole = F.array_join(F.concat(F.array(F.trim(first)), F.transform(taken, lambda r: F.trim(r["text"]))), " ")
        return F.struct(o["i"].alias("n"), F.regexp_extract(o["text"], OPENING, 1).alias("number"), F.trim(first).alias("first"), _squeezed(whole).alias("body"))

    return rows.withColumn("notes", F.transform("opened", note))


def footnotes(texts: DataFrame, form: str = "parser", endnote_stems: str | None = "justification") -> DataFrame:
    """texts (stem, text): (stem, number, body), the longest body of each number (the first of equals).

    parser: over 25 characters, 7 more lines at most, lines that begin with a number are skipped; a text
    whose stem holds `endnote_stems` and that has a heading 'Notes' gives its endnotes instead, all of them.
    inline: first line of 20 characters, 9 more lines, only numbers with two blanks after them are skipped.
    """
    parser = form == "parser"
    rows = texts.select("stem", F.coalesce("text", F.lit("")).alias("text"))
    ended = F.lit(False)
    if parser and endnote_stems:
        ended = F.contains(F.lower("stem"), F.lit(endnote_stems)) & clean_noise("text").rlike(NOTES_HEADING)
    rows = rows.withColumn("ended", F.coalesce(ended, F.lit(False)))
    pages = rows.where("NOT ended").select("stem", F.posexplode(F.split(clean_noise("text"), PAGE)).alias("page", "body"))
    found = _page_notes(pages.select("stem", "page", F.split("body", "\n").alias("rows")), r"^\d{1,3}[\s\x{2002}\x07]" if parser else r"^\d{1,3}[ \t]{2,}", 7 if parser else 9)
    flat = found.select("stem", "page", F.explode("notes").alias("e")).select("stem", "page", "e.*")
    flat = flat.where(F.length("body") > 25) if parser else flat.where(F.length("first") >= 20)
    number = F.col("number") if parser else F.col("number").cast("int").cast("string")
    best = flat.groupBy("stem", number.alias("number")).agg(F.max_by("body", F.struct(F.length("body").alias("a"), (-F.col("page")).alias("b"), (-F.col("n")).alias("c"))).alias("body"))
    listed = rows.where("ended").select("stem", F.explode(endnotes("text")).alias("e")).select("stem", "e.*").where(F.length("body") > 20)
    return best.unionByName(listed)


# A numbered entry, an entry that begins with an author, a dash for the author before, a year, and how many numbers make a numbered list.
NUMBERED = r"(?m)^[ \t\x07]*(\d{1,3})[ \t\x07]+(?=[A-ZÀ-Þ])"
AUTHOR = r"^(?:[A-ZÀ-Þ][\p{L}\p{N}_’'-]+,\s+[A-ZÀ-Þ]|[A-ZÀ-Þ][\p{L}\p{N}_’'-]+\s{1,4}[A-ZÀ-Þ]{1,3},)"
AGAIN, DATED = r"^[—–-]{2,}\s+", r"\b(?:19|20)\d\d\b"
LEAST_NUMBERS, IN_SEQUENCE = 3, 0.6


def reference_entries(texts: DataFrame, whole: bool = False) -> DataFrame:
    """texts (stem, text): (stem, n, entry), entries with a year of a text's reference list, or of the text itself if `whole`.

    Numbers that begin at 1 or 2 and mostly rise by one cut the list. Else an author or a dash opens an entry, other lines go
    on with it, and a dash stands for the last author named above it.
    """
    refs = F.regexp_replace(F.coalesce("text", F.lit("")) if whole else references_section("text"), "-\n", "")
    rows = texts.select("stem", refs.alias("refs")).where("refs IS NOT NULL")
    rows = rows.withColumn("numbers", F.transform(F.regexp_extract_all("refs", F.lit(NUMBERED), F.lit(1)), lambda x: x.cast("int")))
    steps = F.size(F.filter(F.transform("numbers", lambda x, i: F.get("numbers", i + 1) - x), lambda d: d == 1))
    runs = (F.size("numbers") >= LEAST_NUMBERS) & (F.get("numbers", F.lit(0)) <= 2) & (steps >= IN_SEQUENCE * F.size("numbers"))
    rows = rows.withColumn("runs", F.coalesce(runs, F.lit(False)))
    parts = F.split("refs", NUMBERED)
    numbered = rows.where("runs").select("stem", F.posexplode(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _squeezed)).alias("n", "entry"))
    # Lines, the author named last above each, and the entry each belongs to.
    lines = rows.where("NOT runs").select("stem", F.posexplode(F.transform(F.split("refs", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")))).alias("at", "line")).where("line <> ''")
    again = F.col("line").rlike(AGAIN)
    named = F.when(F.col("line").rlike(AUTHOR) & ~again, F.trim(F.get(F.split("line", ",|  "), F.lit(0))))
    before, to_here = Window.partitionBy("stem").orderBy("at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("stem").orderBy("at")
    lines = lines.withColumn("author", F.last(named, ignorenulls=True).over(before)).withColumn("opens", again | F.col("line").rlike(AUTHOR) | (F.row_number().over(to_here) == 1))
    text = F.when(again & (F.coalesce("author", F.lit("")) != ""), F.concat("author", F.lit(", "), F.regexp_replace("line", AGAIN, ""))).otherwise(F.col("line"))
    lines = lines.withColumn("text", text).withColumn("n", F.sum(F.col("opens").cast("int")).over(to_here.rowsBetween(Window.unboundedPreceding, 0)))
    dated = lines.groupBy("stem", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("entry"))
    found = numbered.unionByName(dated.select("stem", (F.col("n") - 1).cast("int").alias("n"), "entry"))
    return found.where((F.col("entry") != "") & F.col("entry").rlike(DATED))


def citation_blocks(texts: DataFrame) -> DataFrame:
    """texts (stem, text): (stem, n, block) of the report: '[number] body' of over 30 characters with a year's four digits, one of those that begin alike."""
    pages = texts.select("stem", F.posexplode(F.split(F.coalesce("text", F.lit("")), PAGE)).alias("page", "body"))
    zipped = F.arrays_zip(F.regexp_extract_all("body", F.lit(r"(?<!\d)" + BLOCK), F.lit(1)).alias("a"), F.regexp_extract_all("body", F.lit(r"(?<!\d)" + BLOCK), F.lit(2)).alias("b"))
    rows = pages.select("stem", "page", F.posexplode(zipped).alias("n", "e")).select("stem", "page", "n", "e.a", F.trim("e.b").alias("b"))
    rows = rows.where((F.length("b") > 30) & F.col("b").rlike(r"\d{4}")).select("stem", "page", "n", F.format_string("[%s] %s", "a", "b").alias("block"))
    # Fixed value: characters by which two blocks are alike.
    first = rows.groupBy("stem", F.substring("block", 1, 80).alias("head")).agg(F.min(F.struct("page", "n", "block")).alias("r"))
    return first.select("stem", F.col("r.page").alias("page"), F.col("r.n").alias("n"), F.col("r.block").alias("block"))


def _whole(pattern: str, name: str, lead: str) -> str:
    """The pattern from the first capital of a run of name characters on: where that fails, no later capital of the run can match, so a run is read once."""
    return rf"(?<![{name}]){lead}({pattern})"


def standalone_cases(text) -> Column:
    """Sorted distinct cases of a text: parties with 15 to 150 characters and three letters on both sides of 'v.', or a bracketed year and reporter."""
    t = clean_noise(F.coalesce(_c(text), F.lit("")))
    us = F.transform(F.regexp_extract_all(t, F.lit(_whole(CASE, NAME, r"[a-z\s&.,]*+")), F.lit(1)), lambda x: F.rtrim(F.btrim(x, F.lit(" \t\r\n")), F.lit(",. ")))
    us = F.filter(us, lambda x: F.contains(x, F.lit(" v.")) & (F.length(x) > 15) & (F.length(x) < 150))
    us = F.filter(F.transform(us, lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: x.rlike(r"\w{3,}\s+v\.\s+\w{3,}") | x.rlike(r"\[\d{4}\]"))
    return F.array_sort(F.array_distinct(F.concat(us, F.regexp_extract_all(t, F.lit(f"({UK_CASE})"), F.lit(1)))))


def report_cases(text) -> Column:
    """Sorted distinct cases of the report: parties of 10 to 120 characters around 'v' or 'v.', bracketed years, and reporters with volume and page."""
    t = F.coalesce(_c(text), F.lit(""))
    us = F.transform(F.regexp_extract_all(t, F.lit(_whole(CASE_REPORT, NAME_REPORT, r"[a-z\s&.,']*+")), F.lit(1)), lambda x: F.rtrim(F.btrim(x, F.lit(" \t\r\n")), F.lit(",. ")))
    us = F.filter(us, lambda x: (F.contains(x, F.lit(" v.")) | F.contains(x, F.lit(" v "))) & (F.length(x) > 10) & (F.length(x) < 120))
    return F.array_sort(F.array_distinct(F.concat(us, F.regexp_extract_all(t, F.lit(f"({UK_CASE})"), F.lit(1)), F.regexp_extract_all(t, F.lit(f"({REPORTER})"), F.lit(1)))))


def chunks(text, most: int = 12_000) -> Column:
    """A long text in parts: up to the last point and blank within `most` characters, else `most` + 1 characters; blanks between parts go."""
    piece = rf"(?s)(.{{1,{most}}}\z|.{{0,{most - 2}}}\.(?= )|.{{{most + 1}}})\s*"
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(piece), F.lit(1))


# Link labels and page numbers of a press's reference lists, and running heads of journals.
LABELS = r"(?im)^\s*(Google Scholar|Google Preview|WorldCat|COPAC|PubMed|Crossref|Find at .*|p\.\s*\d+)\s*$"
FURNITURE = r"(?im)^\s*(?:Page\s+\d+(?:\s+of\s+\d+)?\b.*|.{0,40}\bet al\.?\s+.{0,60}\(\d{4}\)\s*\d+\s*:\s*\d+\s*)$"


def strip_furniture(text) -> Column:
    """A reference list without link labels, page numbers, running heads and private-use characters."""
    t = F.regexp_replace(_c(text), r"[\x{E000}-\x{F8FF}]", " ")
    return F.regexp_replace(F.regexp_replace(t, LABELS, ""), FURNITURE, "")
