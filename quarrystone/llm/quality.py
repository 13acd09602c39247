"""Text statistics per document and a learned verdict: prose, list, table or junk."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.barrier import computed_once
from quarrystone.llm.rules import RuleList, induce
from quarrystone.storage import spread

#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a about all and any are as at be been but by can for from had has have if in into is it its may not of on one or "
    "our over some such than that the their there these they this those to under up was we were what which will with "
    "als am an auf aus bei bis da das dass dem den der des die durch ein eine einen einer für gegen hat im ist mit nach "
    "nicht noch sich sie sind sodass um und von vor war weil wir wurde zu zum zur "
    "au aux avec car ce ces chez dans de depuis des du elle en est et il la le les leur mais n'est nous ou par pas pour "
    "que qui sa se ses son sont sur un une "
    "al como con del donde el ella en entre es esta este la las lo los más no nos nuestra para pero por porque "
    "que se sin sobre su sus una unas unos y ya"
)
_COMMON = sorted(set(COMMON_WORDS.split()))

_FIGURE = r"[\(\-–−]?[$€£]?\d[\d.,]*\)?%?"
#: Kinds of line, first match decides: patterns, each with signs of which one must stand in the line before it is tried ('' for any character that is not ASCII).
LINE_KINDS: tuple[tuple[str, tuple[tuple[str, tuple[str, ...]], ...]], ...] = (
    ("blank", ((r"^[\s]*$", ()),)),
    ("rule", ((r"^[^\p{L}\p{N}|]*[^\p{L}\p{N}\s|().,;:—–\-]{4}[^\p{L}]*$|^\s*(?:\.{6,}|(?:-\+){3,}|(?:\|/){3,}|-{8,})[^\p{L}]*$", ()),)),
    ("furniture", ((r"(?i)^\s*(?:page|index|table of contents|back to top|continued|page \d+(?: of \d+)?)\s*$", ()),)),
    ("markup", ((r"[{}]|^\S*ctx_|Axis:|xmlns", ("{", "}", "ctx_", "Axis:", "xmlns")), (r"</?[a-z]+[^>]*>|&[a-z]+;", ("<", "&")))),
    ("unbroken", ((r"\S{45}", ()),)),
    ("noise", ((r"(?:[�€ƒ™¢©¿ÃÂœ½ï][^�€ƒ™¢©¿ÃÂœ½ï]{0,6}){6}", ("",)), (r"(?:%%|[~#])(?:[^~#%]{0,40}(?:%%|[~#])){3}", ("%%", "~", "#")))),
    ("grid", ((r"^\s*\|", ("|",)), (r"(?:[\t;]|[ ]{2,})(?:" + _FIGURE + r"|[—–-])\s*(?:[\t;]|[ ]{2,})(?:" + _FIGURE + r"|[—–-])", ("\t", ";", "  ")))),
    ("figure", ((r"^\s*(?:" + _FIGURE + r"|[—–-])\s*$", ()),)),
    ("entry", ((r"(?i)^\s*(?:[-•▪◦●·*–—]\s|\(?[a-z]{1,2}\)\s|\(?\d{1,3}[.)]\s|\(?[ivx]{1,5}[.)]\s|exhibit\s+\d)", ()),)),
    ("short", ((r"^\s*\p{Lu}(?:[^.,;:!?]{0,78}[^\s.,;:!?])?\s*$", ()),)),
)

JUNK_KINDS = ("rule", "furniture", "markup", "unbroken", "noise", "repeat")


#: What ends a line besides a new line, and spaces that do not break.
LINE_ENDS, NO_BREAKS = "\r\u0085\u2028\u2029\u000b\u000c", "\u00a0\u2007\u202f\u3000"


def _holds(text: Column, signs: tuple[str, ...] | str) -> Column:
    return reduce(or_, [F.octet_length(text) != F.length(text) if c == "" else F.contains(text, F.lit(c)) for c in signs])


def _tidy(text: Column) -> Column:
    """Line ends as one new line, no-break spaces as spaces; texts without any are not rewritten."""
    lines = F.when(_holds(text, LINE_ENDS), F.regexp_replace(text, "\r\n?|[\u0085\u2028\u2029\u000b\u000c]", "\n")).otherwise(text)
    return F.when(_holds(text, NO_BREAKS), F.regexp_replace(lines, f"[{NO_BREAKS}]", " ")).otherwise(lines)


def _line_kind(line: Column) -> Column:
    # the same few words over and over: twelve characters from the middle come back at least every hundred
    low, n = F.lower(line), F.length(line)
    again = (n - F.length(F.replace(low, F.substring(low, F.floor(n / 2).cast("int"), F.lit(12))))) / 12
    out = F.when((n > 120) & (again >= 4) & (again * 100 >= n), "repeat")
    found: Column | None = None
    for name, patterns in LINE_KINDS:
        hit = reduce(or_, [_holds(line, signs) & line.rlike(p) if signs else line.rlike(p) for p, signs in patterns])
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.coalesce(out, found.otherwise("plain"))


def text_statistics(docs: DataFrame, id_col: str, text_col: str, only: set[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: counts and shares that describe the words, symbols and lines of the text.

    Shares are of the characters in lines, 0.0 where there are none. Null and empty texts give zeros, never nulls.
    Everything is a built-in expression over the row; nothing is shuffled, unless the scan has fewer partitions than half the cores. Extra columns are left out but for those of
    ``keep``. ``only`` names the statistics wanted, all by default.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.transform(F.split("__t", "\n"), lambda l: F.struct(F.length(l).alias("n"), _line_kind(l).alias("k")))
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    kept = lambda pattern: F.length(F.regexp_replace("__t", pattern, "")).cast("long")
    tokens = F.filter(F.split(F.lower("__t"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = spread(docs, *dict.fromkeys([id_col, text_col, *keep])).select(F.col(id_col), *keep, text.alias("__raw"), _tidy(text).alias("__t")).select(
        id_col, *keep, "__t", F.length("__raw").cast("long").alias("__n"), kinds.alias("__k")
    )
    chars = lambda *names: F.aggregate(
        F.filter("__k", lambda x: x["k"].isin(*names)), F.lit(0), lambda acc, x: acc + x["n"]
    )
    lines = lambda *names: F.size(F.filter("__k", lambda x: x["k"].isin(*names))).cast("long")
    counts = {
        "n_chars": F.col("__n"),
        "n_words": F.size("__w").cast("long"),
        "n_lines": F.size(F.filter("__k", lambda x: x["k"] != "blank")).cast("long"),
        "alpha_words": count(r"\p{L}+"),
        "letters": kept(r"[^\p{L}]+"),
        "digits": kept(r"[^\p{Nd}]+"),
        "symbols": kept(r"[\p{L}\p{N}\s]+"),
        "seen": F.col("__n") - kept(r"[^\s]+"),
        "common": F.size(F.filter("__w", lambda w: w.isin(*_COMMON))).cast("long"),
        "ended": count(r"(?m)[.!?:;][\"'”»)\]]*[ \t]*$"),
        "sum": F.aggregate("__k", F.lit(0), lambda acc, x: acc + x["n"]),
        **{name: chars(name) for name in ("grid", "figure", "entry", "short", "plain")},
        "junk": chars(*JUNK_KINDS),
        "figure_lines": lines("figure"),
        "furniture_lines": lines("furniture", "rule"),
    }
    ratios = {
        "mean_word_chars": ("letters", "alpha_words"),
        "symbol_share": ("symbols", "seen"),
        "digit_share": ("digits", "seen"),
        "letter_share": ("letters", "seen"),
        "common_share": ("common", "alpha_words"),
        "ended_lines_share": ("ended", "n_lines"),
        "grid_share": ("grid", "sum"),
        "figure_share": ("figure", "sum"),
        "figure_lines_share": ("figure_lines", "n_lines"),
        "furniture_lines_share": ("furniture_lines", "n_lines"),
        "entry_share": ("entry", "sum"),
        "short_share": ("short", "sum"),
        "plain_share": ("plain", "sum"),
        "junk_share": ("junk", "sum"),
        "mean_line_chars": ("sum", "n_lines"),
    }
    wanted = [n for n in ratios if only is None or n in only]
    whole = [n for n in ("n_chars", "n_words", "n_lines") if only is None or n in only]
    needed = {*whole, *(x for n in wanted for x in ratios[n])}
    if needed & {"n_words", "common"}:
        base = computed_once(base, [id_col, *keep, "__t", "__n", "__k"], {"__w": tokens})
    counted = computed_once(base, [id_col, *keep], {f"__{n}": c for n, c in counts.items() if n in needed})
    share = lambda a, b: F.when(F.col(f"__{b}") > 0, F.round(F.col(f"__{a}") / F.col(f"__{b}"), 6)).otherwise(F.lit(0.0))
    return counted.select(id_col, *keep, *[F.col(f"__{n}").alias(n) for n in whole], *[share(*ratios[n]).alias(n) for n in wanted])


FEATURES = (
    "mean_word_chars", "symbol_share", "digit_share", "letter_share", "common_share", "ended_lines_share", "grid_share",
    "figure_share", "figure_lines_share", "furniture_lines_share", "entry_share", "short_share", "plain_share", "junk_share", "mean_line_chars",
)


def label_of(text: str) -> str:
    """What most of the characters of a text belong to; labels the sample from which the rules are learned.

    Goes block by block with the neighbourhood of each line, which the features do not see: a label above figures is
    table, a run of short entries is list, a short line within prose is prose.
    """
    lines = [l for l in re.split(r"\r\n?|[\n\u0085\u2028\u2029\u000b\u000c]", text) if l.strip()]
    kinds: list[str] = []
    for line in lines:
        s = line.strip()
        words = re.findall(r"\w+", s.lower())
        letters = sum(ch.isalpha() for ch in s)
        odd = len(re.findall(r"[�€ƒ™¢©¿ÃÂœ½ï]", s))
        if re.fullmatch(r"[\W_]*[\d,.()%\s]*[\W_]*", s) and re.search(r"\d|—|–|^-$", s) and not re.search(r"[_#=*~+|/]|\.{4,}|-{4,}", s):
            kinds.append("figure")
        elif not letters or re.fullmatch(r"(?i)(page|index|table of contents|back to top)(\s+\d+)?", s):
            kinds.append("pipe" if s.startswith("|") and not re.match(r"(\|/)+", s) else "junk")
        elif re.search(r"\S{45}", s) or re.search(r"[{}]|</?\w+[ >]|Axis:|\bctx_", s) or (odd >= 6 and odd > 0.12 * len(s)):
            kinds.append("junk")
        elif len(re.findall(r"%%|[~#]", s)) >= 4 and len(re.findall(r"%%|[~#]", s)) > len(words) / 4:
            kinds.append("junk")
        elif len(words) > 18 and len(set(words)) < len(words) / 6:
            kinds.append("junk")
        elif s.startswith("|") or len(re.findall(r"(?:[\t;|]|[ ]{2,})\s*\(?[\d—–-][\d,.]*\)?%?(?=\s|;|\||$)", line)) >= 2:
            kinds.append("table")
        elif re.match(r"(?i)([-•▪◦●·*–—]\s|\(?[a-z]{1,2}\)\s|\(?\d{1,3}[.)]\s|exhibit\s+\d)", s):
            kinds.append("entry")
        elif len(s) <= 80 and s[0].isupper() and not re.search(r"[.,;:!?]", s):
            kinds.append("short")
        else:
            kinds.append("prose")
    size = {"table": 0, "list": 0, "junk": 0, "prose": 0}
    # page furniture mixes words, numbers and rules: bare numbers beside it belong to it
    n_junk = kinds.count("junk")
    for i, (kind, line) in enumerate(zip(kinds, lines)):
        n = len(line.strip())
        near = kinds[max(0, i - 2) : i + 3]
        if kind in ("table", "pipe"):
            size["table"] += n
        elif kind == "figure":
            size["junk" if near.count("junk") >= 2 and n_junk > len(kinds) / 4 else "table"] += n
        elif kind == "short":
            if i + 1 < len(kinds) and kinds[i + 1] == "figure":
                size["table"] += n
            elif near.count("short") + near.count("entry") >= 3:
                size["list"] += n
            else:
                size["prose"] += n
        else:
            size["list" if kind == "entry" else kind] += n
    return max(size, key=lambda k: (size[k], k == "prose")) if lines else "junk"


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, sample_rows: int = 3000, least_chars: int = 200) -> DataFrame:
    """(id, text, label): about ``sample_rows`` rows (never more than twice as many), chosen by the hash of their id, that are long enough, labelled by ``label_of``.

    The bound is on what rules are learned from only. Fewer rows than that are all used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    total = rows.count()
    part = 1_000_000 if total <= sample_rows else int(1_000_000 * sample_rows / total)
    sample = rows.where((place < part) & (F.length("text") >= least_chars)).orderBy(place, F.xxhash64("text")).limit(2 * sample_rows)
    return sample.withColumn("label", F.pandas_udf(lambda texts: texts.map(label_of), "string")("text"))


def learn_rules(labelled: DataFrame, default: str = "prose", **bounds: int) -> RuleList:
    """Rules for labelled(id, text, label), a bounded table of documents; ``bounds`` are those of ``rules.induce``."""
    rows = text_statistics(labelled, "id", "text", set(FEATURES), ("text", "label")).toPandas()
    rows = rows.sort_values(["id", "text"], kind="stable")
    return induce({f: rows[f].to_numpy(dtype=float) for f in FEATURES}, rows["label"].to_numpy(dtype=object), default, **bounds)


def text_verdicts(docs: DataFrame, id_col: str, text_col: str, rules: RuleList | None = None, statistics: bool = True, labelled: DataFrame | None = None) -> DataFrame:
    """text_statistics with ``verdict``: prose, list, table or junk by the learned rules; null where the text is null or blank.

    Rules are learned from ``labelled`` (id, text, label), or from a bounded sample of docs that ``label_of`` labels. Without ``statistics`` only n_chars, n_lines and what the rules use are computed.
    """
    rules = rules or learn_rules(labelled if labelled is not None else labelled_sample(docs, id_col, text_col))
    used = {c.feature for r in rules.rules for c in r.conditions} | {"n_chars", "n_lines"}
    stats = text_statistics(docs, id_col, text_col, None if statistics else used)
    return stats.withColumn("verdict", F.when(F.col("n_lines") > 0, F.expr(rules.sql())))
