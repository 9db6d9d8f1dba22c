"""Fielded search over the reading table as column expressions.

A term becomes a Column that looks for lower-case text in one field or in all; terms are
combined with &, | and ~ like any other Columns, so Spark plans the search as a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"au": ("author", "authors_full"), "ti": ("title",), "ab": ("abstract",), "yr": ("year",)}


def field_text(field: str | None) -> Column:
    """Text of a field, or of all in order: short and full authors, title, abstract, year."""
    columns = FIELDS[field.lower()] if field and field.lower() != "all" else ("author", "authors_full", "title", "abstract", "year")
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def term(text: str, field: str | None = None) -> Column:
    """Whether a field, or any, holds the text; an empty term holds everywhere."""
    wanted = text.strip().lower()
    return F.contains(field_text(field), F.lit(wanted)) if wanted else F.lit(True)


def shown(table: DataFrame, query: Column | None = None, show_all: bool = False, stars_only: bool = False, issue: Column | None = None) -> DataFrame:
    """Rows that the filters leave: a query reveals hidden rows too; issue is a depth that must be 2 or more."""
    rows = table if query is not None or show_all else table.where("visible")
    if query is not None:
        rows = rows.where(query)
    if stars_only:
        rows = rows.where("star")
    return rows.where(issue >= 2) if issue is not None else rows


def column_order(table: DataFrame, column: str, descending: bool = False) -> Column:
    """Missing values last in both directions; text without regard to case."""
    c = F.lower(column) if table.schema[column].dataType.simpleString() == "string" else F.col(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()
