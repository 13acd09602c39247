"""Tables as grids: headers, years, wide tables, titles of statements, and paragraphs that are only a table's wreckage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import numeric

#: A figure, and the shares that make a block debris.
FIGURE = re.compile(r"\d[\d,]{3,}")
DENSE, FAINT, LEFT_OVER = 0.3, 0.15, 0.2
#: The statements a filer names, what a heading of one may look like, and a company's name before it.
STATEMENT_NAMES = r"operations|comprehensive\s+income|comprehensive\s+loss|income|earnings|cash\s+flows?|shareholders.{0,3}\s*equity|stockholders.{0,3}\s*equity|equity|financial\s+position"
STATEMENT = (
    rf"(?i)^(?:consolidated\s+|combined\s+|condensed\s+)?(?:statements?\s+of\s+(?:{STATEMENT_NAMES})(?:\s*\(loss\))?(?:\s+and\s+(?:{STATEMENT_NAMES})(?:\s*\(loss\))?)*"
    rf"|(?:{STATEMENT_NAMES})\s+statements?|balance\s+sheets?)(?:\s*[(\[].*)?(?:\s+(?:as\s+of|for\s+the)\s.*)?[.:]?$"
)
COMPANY_BEFORE = r"(?i)^.{0,60}?\b(?:inc|corp|corporation|company|co|plc|ltd|limited|holdings|group|n\.v|s\.a|ag|se)\b\.?,?\s+"
TITLE_WORDS = tuple("consolidated combined condensed statement statements of cash flow flows balance sheet sheets income loss comprehensive operations earnings stockholders shareholders equity financial position".split())
MARKDOWN_NOISE = r"[*\\#]"
#: Written lines between a heading and its table, the share of labels that must agree, and lines that may part a wrapped row.
TITLE_LINES, TITLE_OVERLAP, TITLE_GAP = 8, 0.5, 3
#: The heading with its spacing left out, for letters that arrive spaced out.
_SQUEEZED = STATEMENT.replace(r"\s+", "").replace(r"\s*", "").replace(r"\s.*", ".*")


def is_label(cell: Column) -> Column:
    """Three letters in a row, or a year."""
    return cell.rlike(r"[A-Za-z]{3}") | cell.rlike(r"^(?:19|20)\d{2}$")


def promoted(headers: Column, rows: Column) -> Column:
    """struct<headers, rows>: the first row as headers where the columns are only numbered and that row is labels."""
    first = F.transform(rows[0], lambda c: F.trim(F.coalesce(c, F.lit(""))))
    filled = F.filter(first, lambda c: c != "")
    numbered = F.forall(headers, lambda h: F.trim(F.coalesce(h, F.lit(""))).rlike(r"^\d+$"))
    move = (F.size(rows) > 0) & numbered & (F.size(filled) >= 2) & F.forall(filled, is_label)
    return F.when(F.coalesce(move, F.lit(False)), F.struct(first.alias("headers"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"))).otherwise(
        F.struct(headers.alias("headers"), rows.alias("rows"))
    )


def years_without_commas(rows: Column) -> Column:
    """Rows in which a column of three or more consecutive years written as amounts is written as years."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    amounts = lambda j: F.filter(F.transform(rows, lambda r: F.regexp_replace(F.regexp_extract(F.coalesce(F.get(r, j), F.lit("")), r"^\s*(\d,\d{3})\s*$", 1), ",", "").try_cast("int")), lambda v: v.isNotNull())

    def is_run(j: Column) -> Column:
        a = amounts(j)
        n = F.size(a)
        steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(a, i) - F.get(a, i - 1))
        return (n >= 3) & F.forall(a, lambda v: (v >= 1990) & (v <= 2100)) & F.forall(steps, lambda s: F.coalesce(s == 1, F.lit(False)))

    flags = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), is_run)).otherwise(F.array().cast("array<boolean>"))
    fix = lambda c, j: F.when(F.coalesce(F.get(flags, j), F.lit(False)) & c.rlike(r"^\s*\d,\d{3}\s*$"), F.regexp_replace(F.trim(c), ",", "")).otherwise(c)
    return F.transform(rows, lambda r: F.transform(r, fix))


def joined_levels(levels: Column) -> Column:
    """Header levels of a column as one label; blanks and repeats of the one before are left out."""
    kept = F.filter(F.transform(levels, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1))), " ")


def column_groups(widths: list[list[int]], budget: int) -> list[list[int]]:
    """Columns of each piece of a table whose rows are wider than the budget: the label column, then as many others as fit, one at least."""
    n = len(widths[0]) if widths else 0

    def width(columns: list[int]) -> int:
        return max(sum(r[c] for c in columns) for r in widths) + 3 * len(columns) + 1

    if n < 3 or width(list(range(n))) <= budget:
        return [list(range(n))]
    groups = [[0, 1]]
    for c in range(2, n):
        if width([*groups[-1], c]) <= budget:
            groups[-1].append(c)
        else:
            groups.append([0, c])
    return groups


def row_slices(widths: list[int], head: int, most_rows: int, budget: int) -> list[tuple[int, int]]:
    """[from, to) of the rows of each piece: at most ``most_rows`` and within the budget with the repeated header; one row at least."""
    out, start, size = [], 0, head
    for i, w in enumerate(widths):
        if i > start and (i - start >= most_rows or size + w + 1 > budget):
            out.append((start, i))
            start, size = i, head
        size += w + 1
    return [*out, (start, len(widths))] if widths else []


_PIECE = "key long, table_index int, part int, headers array<string>, rows array<array<string>>, n_chars int"


def table_parts(sections: DataFrame, key: str, budget: int = 720, most_rows: int = 30) -> DataFrame:
    """(key, table_index, part, headers, rows, n_chars): every table cut by columns and then by rows so that its pipe form fits the budget where one row can."""
    t = sections.select(F.col(key).alias("key"), F.explode("tables").alias("t")).where("size(t.headers) > 0 and size(t.rows) > 0").select(
        "key", F.col("t.table_index").alias("table_index"), F.col("t.headers").alias("headers"), years_without_commas(F.col("t.rows")).alias("rows")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, index, headers, rows in zip(pdf["key"], pdf["table_index"], pdf["headers"], pdf["rows"]):
                n = len(headers)
                full = [[c or "" for c in list(r)[:n]] + [""] * (n - len(r)) for r in [headers, *rows]]
                part = 0
                for columns in column_groups([[len(c) for c in r] for r in full], budget):
                    cut = [[r[c] for c in columns] for r in full]
                    wide = [sum(map(len, r)) + 3 * len(r) + 1 for r in cut]
                    head = wide[0] + 1 + 6 * len(columns) + 1
                    for a, b in row_slices(wide[1:], head, most_rows, budget):
                        body = cut[1 + a : 1 + b]
                        out.append((k, index, part, cut[0], body, head + sum(w + 1 for w in wide[1 + a : 1 + b])))
                        part += 1
            if out:
                yield pd.DataFrame(out, columns=["key", "table_index", "part", "headers", "rows", "n_chars"])

    return t.mapInPandas(run, _PIECE).withColumnRenamed("key", key)


def covered_by(block: str, cells: list[str]) -> list[int]:
    """For each character of a block the number of the cell copy that covers it, 0 for none: long cells take their place first, equal lengths by text, later before earlier."""
    free, owner, n = block, [0] * len(block), 0
    for cell in sorted({c for c in cells if len(c) >= 3 and c in block}, key=lambda c: (len(c), c), reverse=True):
        at = free.find(cell)
        while at >= 0:
            n += 1
            owner[at : at + len(cell)] = [n] * len(cell)
            free = free[:at] + "\0" * len(cell) + free[at + len(cell) :]
            at = free.find(cell, at + len(cell))
    return owner


def open_figures(block: str, owner: list[int]) -> list[str]:
    """Figures of which a digit is in no cell, or a comma is not in one cell with the digits on both sides."""
    out = []
    for m in FIGURE.finditer(block):
        for i in range(m.start(), m.end()):
            inner_comma = block[i] == "," and i + 1 < len(block) and block[i + 1].isdigit()
            if (block[i].isdigit() and not owner[i]) or (inner_comma and not (owner[i] and owner[i - 1] == owner[i] == owner[i + 1])):
                out.append(m.group())
                break
    return out


def is_debris(block: str, cells: list[str]) -> bool:
    """A block that is a table's text run together: no sentence, and its figures and most of its letters stand in the cells."""
    visible = [c for c in block if not c.isspace()]
    if not visible or block[-1] in ".:;!?":
        return False
    dense = sum(c.isdigit() or c in "$%()," for c in block) / len(visible)
    found = set(FIGURE.findall(block))
    if dense >= DENSE and found and found <= {f for c in cells for f in FIGURE.findall(c)}:
        return True
    if dense < FAINT:
        return False
    flat = " ".join(block.split())
    owner = covered_by(flat, cells)
    if open_figures(flat, owner):
        return False
    rest = sum(c.isalnum() and not o for c, o in zip(flat, owner))
    return rest <= LEFT_OVER * sum(c.isalnum() for c in block)


def marked_debris(sections: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """blocks(key, position, block) with ``debris``, by the cells of the tables of their section that become passages."""
    cells = F.flatten(F.transform(F.filter("tables", lambda t: (F.size(t["headers"]) > 0) & (F.size(t["rows"]) > 0)), lambda t: F.concat(t["headers"], F.flatten(t["rows"]))))
    have = sections.select(F.col(key), F.array_distinct(F.filter(cells, lambda c: c.isNotNull())).alias("cells")).where("size(cells) > 0")

    @F.pandas_udf("boolean")
    def debris(block: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([is_debris(b, list(c)) for b, c in zip(block, cells)])

    met = blocks.join(have, key, "left")
    judged = met.where("cells is not null").withColumn("debris", debris("block", "cells"))
    return judged.drop("cells").unionByName(met.where("cells is null").drop("cells").withColumn("debris", F.lit(False)))


def markdown_text(line: Column) -> Column:
    """A markdown line as its words: emphasis, escapes, bullets before it and repeated spaces removed."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), MARKDOWN_NOISE, ""), r"\s+", " "))
    return F.regexp_replace(plain, r"^[^0-9A-Za-z(]+", "")


def is_bulleted(line: Column) -> Column:
    """Opens with a bullet sign; a row of a table does not."""
    plain = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), MARKDOWN_NOISE, ""))
    return plain.rlike(r"^[^\p{L}\p{N}(|]")


def statement_tail(text: Column) -> Column:
    """The heading of a statement that a text is, with a company's name before it left out and letters spaced out allowed; null where it is none."""
    written = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    bare = F.regexp_replace(written, COMPANY_BEFORE, "")
    is_one = lambda c: (c != "") & (c.rlike(STATEMENT) | F.replace(c, F.lit(" "), F.lit("")).rlike(_SQUEEZED))
    return F.when(is_one(written), written).when(is_one(bare), bare)


def title_candidate(line: Column) -> Column:
    """The heading a line could hold: the line itself, the one written cell of a row, or the one cell of several that names a statement."""
    plain = markdown_text(line)
    cells = F.filter(F.transform(F.split(F.regexp_replace(plain, r"^\|+|\|+$", ""), r"\|"), F.trim), lambda c: c != "")
    named = F.filter(cells, lambda c: statement_tail(c).isNotNull())
    return F.when(~F.contains(plain, F.lit("|")), plain).when(F.size(cells) == 1, cells[0]).when(F.size(named) == 1, named[0]).otherwise(plain)


def names_statement(line: Column) -> Column:
    return statement_tail(markdown_text(line)).isNotNull()


_SPACED = re.compile(r"(?<![A-Za-z])(?:" + "|".join(" ?".join(w) for w in sorted(TITLE_WORDS, key=len, reverse=True)) + r")(?![A-Za-z])", re.I)


def clean_title(text: Column) -> Column:
    """A heading without cells beside it, a stop at its end and spaces inside its words."""

    @F.pandas_udf("string")
    def joined(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: None if t is None else _SPACED.sub(lambda m: m.group().replace(" ", ""), t))

    first = F.regexp_replace(F.trim(F.element_at(F.split(F.coalesce(statement_tail(text), text), r"\|"), 1)), r"[.:]+$", "")
    return joined(F.trim(first))


def statement_titles(lines: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """(key, table_index, title): the statement heading above the run of pipe lines whose first cells overlap most with a table's.

    lines(key, position, line) of the section's text, tables(key, table_index, labels array<string>) with the first cell of each row. Pipe lines parted by up to three written lines without a heading are one run; a run takes
    the nearest heading within eight written lines above it, or in its rows; a heading that is one bullet of several is an entry of an index and none. A table takes the first of the runs with the largest overlap of
    labels, by half at least of the smaller side.
    """
    w = W.partitionBy(key).orderBy("position")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    written = lines.where("trim(line) <> ''")
    marked = written.select(key, "position", "line", F.col("line").rlike(r"^\s*\|").alias("row"), is_bulleted(F.col("line")).alias("bullet"), statement_tail(title_candidate(F.col("line"))).alias("named"), F.row_number().over(w).alias("n"))
    listed = F.col("bullet") & (F.coalesce(F.lag("bullet").over(w), F.lit(False)) | F.coalesce(F.lead("bullet").over(w), F.lit(False)))
    marked = marked.withColumn("title", F.when(F.col("named").isNotNull() & ~listed, F.struct("n", "named")))
    above = F.last("title", ignorenulls=True).over(w)
    last_row = F.last(F.when(F.col("row"), F.col("n")), ignorenulls=True).over(before)
    placed = marked.withColumn("above", above).withColumn("last_row", last_row)
    starts = F.col("row") & (F.col("last_row").isNull() | (F.col("n") - F.col("last_row") - 1 > TITLE_GAP) | ((F.col("above.n") > F.col("last_row")) & (F.col("above.n") < F.col("n"))))
    runs = placed.withColumn("run", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w)).where("row")
    first = F.lower(F.trim(F.element_at(F.split("line", r"\|"), 2)))
    # a heading inside the rows counts where none stands above
    blocks = runs.groupBy(key, "run").agg(F.min(F.struct("n", "above")).alias("top"), F.min("title").alias("inside"), F.collect_set(first).alias("names"))
    near = F.coalesce(F.when(F.col("top.n") - F.col("top.above.n") <= TITLE_LINES, F.col("top.above.named")), F.col("inside.named"))
    blocks = blocks.select(key, "run", near.alias("title"), F.filter("names", lambda x: ~x.rlike(r"^[-\s]*$")).alias("names"))
    t = tables.select(key, "table_index", F.array_distinct(F.filter(F.transform("labels", lambda x: F.lower(F.trim(x))), lambda x: ~x.rlike(r"^[-\s]*$"))).alias("labels"))
    both = F.size(F.array_intersect("labels", "names")) / F.least(F.size("labels"), F.size("names"))
    met = t.join(blocks, key).withColumn("overlap", both).where(F.col("overlap") >= TITLE_OVERLAP)
    best = W.partitionBy(key, "table_index").orderBy(F.desc("overlap"), "run")
    kept = met.withColumn("__place", F.row_number().over(best)).where("__place = 1 and title is not null")
    return kept.select(key, "table_index", clean_title(F.col("title")).alias("title"))


def without_repeated_columns(headers: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """A grid without columns that say what the column before says: a cell that spans several columns is read into each. A column goes if its heading and every cell equal those before it, or are blank."""
    keep = [0] if headers else []
    for c in range(1, len(headers)):
        last = keep[-1]
        pairs = [(headers[last], headers[c]), *((r[last], r[c]) for r in rows)]
        if not all(b in ("", a) for a, b in pairs):
            keep.append(c)
    return [headers[c] for c in keep], [[r[c] for c in keep] for r in rows]


_VALUE = r"\(?[$€£]?\s?\d[\d,.]*\)?%?"


def split_values(cell: str) -> list[str]:
    """Figures that were run together in one cell, apart; any other cell stays whole."""
    found = re.findall(_VALUE, cell)
    return [f.strip() for f in found] if len(found) > 1 and not re.sub(_VALUE, "", cell).strip(" |") else [cell]
