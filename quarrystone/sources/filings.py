"""A data source of filings with filters pushed into it, and the reading of a filing's HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Titles of the items of an annual report.
ITEM_TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures", "4A": "Executive Officers of the Registrant",
    "5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities", "6": "Reserved",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements With Accountants on Accounting and Financial Disclosure", "9A": "Controls and Procedures",
    "9B": "Other Information", "9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections", "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation", "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "13": "Certain Relationships and Related Transactions, and Director Independence", "14": "Principal Accountant Fees and Services",
    "15": "Exhibits, Financial Statement Schedules", "16": "Form 10-K Summary",
}
KEY_ITEMS = ("1", "1A", "7", "7A", "8")
#: Where a short item points to.
FALLBACKS = {"8": "15"}


class FilingSource(DataSource):
    """``spark.read.format("filings").option("path", ...)``: rows of filing lists (parquet), one partition per file, with ticker and form filters applied while reading."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return "ticker string, cik bigint, company string, form string, filing_date string, accession_no string, url string, path string, period_of_report string"

    def reader(self, schema) -> DataSourceReader:
        return _FilingReader(self.options, schema.fieldNames())


class _FilingReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names, self.wanted = options["path"], names, {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("ticker", "form"):
                self.wanted.setdefault(f.attribute[0], []).append([f.value])
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in ("ticker", "form"):
                self.wanted.setdefault(f.attribute[0], []).append(list(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        files = sorted(glob.glob(os.path.join(self.path, "*.parquet"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        import pyarrow.dataset as ds

        condition = None
        for column, sets in self.wanted.items():
            for values in sets:
                one = ds.field(column).isin(values)
                condition = one if condition is None else condition & one
        for batch in ds.dataset(partition.value).scanner(columns=self.names, filter=condition).to_batches():
            if batch.num_rows:
                yield batch


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilingSource)


class _Blocks(HTMLParser):
    """Paragraphs and tables of a page in order: ('text', str) or ('table', rows)."""

    BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr section article hr body".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, object]] = []
        self._text: list[str] = []
        self._rows: list[list[str]] | None = None
        self._cell: list[str] | None = None
        self._depth = self._skip = 0

    def _flush(self) -> None:
        line = re.sub(r"\s+", " ", "".join(self._text)).strip()
        self._text = []
        if line:
            self.out.append(("text", line))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self._skip += 1
        elif tag == "table":
            self._depth += 1
            if self._depth == 1:
                self._flush()
                self._rows = []
        elif self._rows is not None and tag == "tr" and self._depth == 1:
            self._rows.append([])
        elif self._rows is not None and tag in ("td", "th") and self._depth == 1:
            self._cell = []
            self._span = int(dict(attrs).get("colspan") or 1) if (dict(attrs).get("colspan") or "1").isdigit() else 1
        elif tag in self.BLOCK and self._rows is None:
            self._flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self._skip = max(0, self._skip - 1)
        elif tag == "table" and self._depth:
            self._depth -= 1
            if self._depth == 0:
                self.out.append(("table", [r for r in self._rows or [] if any(r)]))
                self._rows = self._cell = None
        elif self._cell is not None and tag in ("td", "th") and self._depth == 1:
            value = re.sub(r"\s+", " ", "".join(self._cell)).strip()
            (self._rows or [[]])[-1 if self._rows else 0].append(value)
            self._rows[-1].extend([""] * (self._span - 1))
            self._cell = None
        elif tag in self.BLOCK and self._rows is None:
            self._flush()

    def handle_data(self, data):
        if self._skip:
            return
        if self._cell is not None:
            self._cell.append(data)
        elif self._rows is None:
            self._text.append(data)

    def close(self):
        super().close()
        self._flush()


def merge_fragments(row: list[str]) -> list[str]:
    """Joins a currency sign, a number and a closing bracket or percent sign that stand in cells of their own."""
    out: list[str] = []
    for cell in row:
        if out and re.fullmatch(r"[$€£(]+", out[-1]) and cell:
            out[-1] += cell
        elif out and re.fullmatch(r"[)%]+", cell) and out[-1]:
            out[-1] += cell
        else:
            out.append(cell)
    return out


def grid(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Headers and rows: leading rows without figures other than years are headers, joined column by column; empty columns go."""
    rows = [merge_fragments(r) for r in rows]
    width = max((len(r) for r in rows), default=0)
    full = [r + [""] * (width - len(r)) for r in rows]
    keep = [i for i in range(width) if any(r[i] for r in full)]
    full = [[r[i] for i in keep] for r in full]
    n = 0
    while n < len(full) - 1 and all(not re.search(r"\d", c) or re.fullmatch(r"\D*(?:19|20)\d{2}\D*", c) for c in full[n]):
        n += 1
    head: list[str] = []
    for col in zip(*full[:n]) if n else []:
        parts: list[str] = []
        for label in col:
            if label and (not parts or parts[-1] != label):
                parts.append(label)
        head.append(" ".join(parts))
    return head, full[n:]


_ITEM = re.compile(r"^item\s+(\d{1,2}[a-c]?)\s*[.:—–-]?\s*(.*)$", re.I)


def read_html(html: str) -> list[dict]:
    """Sections of a filing: items by their headings, text between blank lines, tables as grids. The last heading of an item with a body counts, so a table of contents does not."""
    if not html or not re.search(r"<\s*(?:html|body|div|p|table)\b", html, re.I):
        raise ValueError("no HTML")
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    found: list[dict] = []
    now: dict | None = None
    for kind, value in parser.out:
        m = _ITEM.match(value) if kind == "text" else None
        # a sentence that begins with an item is no heading, however short, and a heading may be long
        if m and (m.group(2)[:1].islower() or re.search(r"[.!?]\s+\S", m.group(2))):
            m = None
        if m:
            now = {"item": m.group(1).upper(), "title": m.group(2).strip(" .") or ITEM_TITLES.get(m.group(1).upper(), ""), "blocks": [], "tables": []}
            found.append(now)
        elif now is not None and kind == "text":
            now["blocks"].append(value)
        elif now is not None and value:
            head, rows = grid(value)
            if head and rows:
                now["tables"].append({"headers": head, "rows": rows, "caption": now["blocks"][-1][:200] if now["blocks"] else ""})
            now["blocks"].extend(" ".join(c for c in r if c) for r in value)
    best: dict[str, dict] = {}
    for s in found:
        old = best.get(s["item"])
        if old is None or sum(map(len, s["blocks"])) >= sum(map(len, old["blocks"])):
            best[s["item"]] = s
    return [best[k] for k in dict.fromkeys(s["item"] for s in found)]


_PARSED = (
    "key string, item string, title string, text string, n_chars int, n_tables int, n_data_tables int, is_key_section boolean, "
    "tables array<struct<table_index:int,caption:string,headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int>>, problem string"
)


def parse_filings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Sections of every page; a page that cannot be read is one row with its problem and nothing else."""
    kinds = pa.schema(
        [("key", pa.string()), ("item", pa.string()), ("title", pa.string()), ("text", pa.string()), ("n_chars", pa.int32()), ("n_tables", pa.int32()), ("n_data_tables", pa.int32()), ("is_key_section", pa.bool_()),
         ("tables", pa.list_(pa.struct([("table_index", pa.int32()), ("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("n_rows", pa.int32()), ("n_cols", pa.int32())]))), ("problem", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for s in read_html(page or ""):
                        text = "\n\n".join(s["blocks"])
                        tables = [{"table_index": i, "caption": t["caption"], "headers": t["headers"], "rows": t["rows"], "n_rows": len(t["rows"]), "n_cols": len(t["headers"])} for i, t in enumerate(s["tables"])]
                        data = sum(any(re.search(r"\d", c) for r in t["rows"] for c in r) for t in tables)
                        rows.append({"key": k, "item": s["item"], "title": s["title"], "text": text, "n_chars": len(text), "n_tables": len(tables), "n_data_tables": data, "is_key_section": s["item"] in KEY_ITEMS, "tables": tables, "problem": None})
                except Exception as e:  # one page must not end the others
                    rows.append(dict.fromkeys(kinds.names) | {"key": k, "problem": f"{type(e).__name__}: {e}"[:200]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return pages.select(F.col(key).cast("string"), F.col(html)).mapInArrow(run, _PARSED)


def resolve_stubs(sections: DataFrame, key: str) -> DataFrame:
    """Adds resolved_from: the item a stub points to, if that item of the same filing is no stub itself."""
    from quarrystone.functions.text import is_stub

    marked = sections.withColumn("is_stub", is_stub(F.col("text")))
    target = F.coalesce(*[F.when(F.col("item") == k, F.lit(v)) for k, v in FALLBACKS.items()], F.lit(None).cast("string"))
    full = marked.where("not is_stub").select(key, F.col("item").alias("__target")).distinct().withColumn("__has", F.lit(True))
    met = marked.withColumn("__target", F.when(F.col("is_stub"), target)).join(full, [key, "__target"], "left")
    return met.withColumn("resolved_from", F.when(F.col("__has"), F.col("__target"))).drop("__target", "__has")
