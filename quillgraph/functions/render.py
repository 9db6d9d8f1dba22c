"""Columns of rendered text and of the small rules that reports use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
CITING_SUBJECTS = (
    "negligence", "culpability", "criminal law", "tort", "liability",
    "moral responsibility", "recklessness", "blameworthiness", "mens rea",
    "excuse", "justification", "intentional", "wrongdoing", "harm",
    "punishment", "legal", "philosophy", "ethics", "fault",
    "corrective justice", "strict liability", "criminal", "penal",
    "wrongful", "omission", "causation", "volition",
)
REPORT_SUBJECTS = (
    "negligence", "culpability", "criminal law", "tort", "liability", "moral responsibility",
    "recklessness", "blameworthiness", "mens rea", "excuse", "justification", "intentional",
    "wrongdoing", "harm", "punishment", "legal", "philosophy", "ethics", "fault",
    "corrective justice", "strict liability",
)
LIGATURES = (
    ("specibc", "specific"), ("bnancial", "financial"), ("debn", "defin"),
    ("akrm", "affirm"), ("sukce", "suffice"), ("fawed", "flawed"),
    ("infuence", "influence"), ("benebt", "benefit"), ("frst", "first"),
    ("brst", "first"), ("artibcial", "artificial"), ("refect", "reflect"),
    ("signibcant", "significant"), ("deb ", "defi"), ("conf ict", "conflict"),
)
TIERS = ("MOST FREQUENT (large in the cloud)", "MODERATELY FREQUENT (medium)", "LESS FREQUENT (small)")


def _text(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def holds_any(words: tuple[str, ...], *texts) -> Column:
    """Whether the lower-cased texts, joined by spaces, hold one of the words, within longer words too. Null counts as empty."""
    joined = F.lower(F.concat_ws(" ", *[_text(t) for t in texts]))
    return reduce(lambda a, b: a | b, [F.contains(joined, F.lit(w)) for w in words])


def fix_ligatures(text) -> Column:
    """Known wrong readings of fi, fl and ffi put right, one after the other; null stays null."""
    column = F.col(text) if isinstance(text, str) else text
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, column)


def term_cloud(large, medium, small) -> Column:
    """Arrays of terms as a line for each tier that has some; empty text if none has."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (large, medium, small)]
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for c, label in zip(columns, TIERS)]
    return F.concat_ws("\n", *lines)


def wave(stem, second: tuple[str, ...]) -> Column:
    """W2 for stems of the second wave, W1 for all others, null too."""
    return F.when(F.col(stem).isin(*second), "W2").otherwise("W1")


def citation_line(title, authors, year, venue, cited, doi, indent: str = "  ") -> Column:
    """A Markdown line: title, the first four authors, year, and what is known of venue, citations and DOI.

    authors: an array; a null name is a question mark. An empty title, a missing year or 0 have stand-ins.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    names = F.array_join(F.transform(F.slice(F.coalesce(c(authors), F.array().cast("array<string>")), 1, 4), lambda n: F.when(n != "", n).otherwise("?")), ", ")
    shown = F.when(_text(title) == "", "(no title)").otherwise(c(title))
    when = F.when(F.coalesce(c(year), F.lit(0)) == 0, "?").otherwise(c(year).cast("string"))
    part = lambda test, *pieces: F.when(test, F.concat(*pieces)).otherwise("")
    return F.concat(
        F.lit(f"{indent}- **"), shown, F.lit("** — "), names, F.lit(" ("), when, F.lit(")"),
        part(_text(venue) != "", F.lit(", *"), c(venue), F.lit("*")),
        part(F.coalesce(c(cited), F.lit(0)) != 0, F.lit(" [cited by "), c(cited).cast("string"), F.lit("]")),
        part(_text(doi) != "", F.lit(f"  \n{indent}  DOI: "), c(doi)),
    )
