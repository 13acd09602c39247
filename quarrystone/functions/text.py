"""Text expressions: tokens, headers, digests, tables as text, predicates on headings and stubs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that make a short section a pointer to another one.
CROSS_REFERENCES = (
    r"incorporated\s+(herein\s+)?by\s+reference",
    r"information\s+required\s+by\s+this\s+item",
    r"proxy\s+statement",
    r"see\s+(the\s+)?(consolidated\s+)?financial\s+statements",
    r"reference\s+is\s+made\s+to",
    r"set\s+forth\s+under",
)
#: Navigation left in the text of a section.
FURNITURE = (r"^Table of Contents$", "^[_\\-—\\s]{3,}$", r"\bForm 10-[KQ]\s*\|\s*\d{1,4}$")
PAGE_NUMBER = r"^\d{1,4}$"
#: Lengths below which a section is empty, and below which a cross-reference is a stub.
EMPTY_LIMIT, STUB_LIMIT = 200, 500
HEADING_LIMIT, HEADING_BODY = 120, 200
CLOSING = ".:;!?)”\"'"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def without_common(words: Column, common: Column) -> Column:
    """Keeps repeats; words that are all common are kept as they are."""
    kept = F.filter(words, lambda w: ~F.array_contains(common, w))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def context_header(company: Column, ticker: Column, fiscal_year: Column, form: Column, item: Column, title: Column) -> Column:
    """One line that says where a passage is from; nulls become empty."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(s(company), F.lit(" ("), s(ticker), F.lit(") | FY"), s(fiscal_year), F.lit(" | "), s(form), F.lit(" | Item "), s(item), F.lit(": "), s(title))


def digest(key: Column, content: Column) -> Column:
    """sha-256 of key, a zero character and the content."""
    return F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\u0000"), F.coalesce(content, F.lit(""))), 256)


def figures(text: Column) -> Column:
    """Distinct runs of a digit and three or more digits or commas."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,]{3,})"), F.lit(1)))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def clean_cell(text: Column) -> Column:
    """White space collapsed, pipes escaped."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, clean_cell), " | "), F.lit(" |"))


def render_table(headers: Column, rows: Column) -> Column:
    """Pipe table: header, rule, one line per row; null without headers."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.concat(F.array(pipe_row(headers), rule), F.transform(rows, pipe_row))
    return F.when(F.size(headers) > 0, F.array_join(lines, "\n"))


def row_width(rows: Column) -> Column:
    """Characters of the widest pipe row: its cells, three per cell and one."""
    width = lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + F.length(F.coalesce(c, F.lit("")))) + 3 * F.size(r) + 1
    return F.array_max(F.transform(rows, width))


def is_cross_reference(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(CROSS_REFERENCES))


def is_stub(text: Column) -> Column:
    """Shorter than 200 characters, or shorter than 500 and only a pointer elsewhere."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return (n < EMPTY_LIMIT) | ((n < STUB_LIMIT) & is_cross_reference(text))


def is_furniture(block: Column, has_tables: Column) -> Column:
    """Navigation; bare page numbers count only where the section has no tables."""
    return block.rlike("(?i)" + "|".join(f"(?:{p})" for p in FURNITURE)) | (~has_tables & block.rlike(PAGE_NUMBER))


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"\n[ \t]*\n")
    return F.filter(F.transform(parts, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def fiscal_year(period: Column) -> Column:
    """Year of a date string, null where it does not begin with four digits."""
    return F.regexp_extract(F.coalesce(period, F.lit("")), r"^(\d{4})", 1).try_cast("int")


def filing_date(text: Column) -> Column:
    """Dates written as 2021-02-03, 2021/02/03, 02/03/2021 or 20210203; null where it is none of them."""
    t = F.trim(F.coalesce(text, F.lit("")))
    iso = F.substring(t, 1, 10).try_cast("date")
    us = F.try_to_timestamp(t, F.lit("MM/dd/yyyy")).cast("date")
    packed = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))
    slashed = F.try_to_timestamp(t, F.lit("yyyy/MM/dd")).cast("date")
    return F.coalesce(packed, iso, slashed, us)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_-]", "-")


def is_run_id(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


def fact_label(label: Column) -> Column:
    """Collapsed, without dots and spaces at the ends, 'figure' where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "), r"^[. ]+|[. ]+$", "")
    return F.when(t == "", F.lit("figure")).otherwise(t)
