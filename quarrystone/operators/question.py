"""Reading a question: companies, fiscal years, type and search text, as expressions over a table of questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.barrier import computed_once

#: Whole phrases that speak for a type of question.
COMPARATIVE = (
    "compare", "comparison", "compared", "versus", "vs", "vs.", "relative to", "difference between", "differ", "higher than", "lower than",
    "more than", "less than", "outperform", "which company", "which of", "among", "between",
)
TEMPORAL = (
    "change", "changed", "changes", "changing", "trend", "trends", "over time", "grow", "grew", "grown", "growing", "growth", "increase",
    "increased", "decrease", "decreased", "decline", "declined", "rise", "risen", "rose", "fall", "fell", "fallen", "shrink", "shrunk",
    "year over year", "year-over-year", "yoy", "since", "evolve", "evolved", "from year to year", "each year", "annually", "historically",
)
NUMERIC = (
    "how much", "how many", "what percentage", "what percent", "what was the total", "revenue", "revenues", "net income", "net loss",
    "operating income", "gross margin", "operating margin", "profit margin", "margin", "margins", "earnings", "eps", "earnings per share",
    "cash flow", "free cash flow", "capital expenditure", "capex", "r&d", "research and development", "operating expenses",
    "cost of revenue", "cost of sales", "total assets", "total liabilities", "debt", "long-term debt", "shares outstanding", "headcount",
    "employees", "dividend", "dividends", "buyback", "repurchase", "tax rate", "effective tax", "deferred revenue", "remaining performance",
    "backlog", "goodwill", "impairment", "amount", "figure", "in dollars", "in billions", "in millions",
)
ADVICE = ("should i buy", "should i invest", "should i sell", "should i hold", "good investment", "worth buying", "worth investing", "do you recommend", "would you recommend")
BEYOND_FILING = ("stock price", "share price", "price target", "market cap", "market capitalisation", "market capitalization", "current price", "today's price")
FUTURE = ("next year", "next quarter", "next fiscal year", "going forward", "in the future", "in the coming year", "in the coming years")
PREDICT = ("predict", "forecast", "project", "estimate", "extrapolate", "guess")
SUFFIXES = ("inc", "corp", "co", "ltd")
OWNING = (
    "have", "has", "had", "report", "earn", "make", "made", "generate", "spend", "spent", "pay", "paid", "employ", "post", "record", "own", "hold", "held", "owe", "invest",
    "book", "recogni", "incur", "lose", "lost",
)
RELATIONS = ("customer", "customers", "supplier", "suppliers", "competitor", "competitors", "partner", "partners", "vendor", "vendors")
REPORTING = (
    "disclose", "disclosed", "discloses", "disclosure", "disclosures", "report", "reported", "reports", "say", "said", "says", "state", "stated", "states", "mention", "mentioned", "mentions",
    "describe", "described", "describes", "discuss", "discussed", "discusses", "note", "noted", "notes", "warn", "warned", "warns", "expect", "expected", "expects", "anticipate", "anticipated",
    "anticipates", "guidance", "outlook", "according to", "in the filing", "in its 10-k", "in the 10-k",
)
DESCRIBING = ("expected", "anticipated")
#: What stands beside a number that is no year.
CURRENCIES = ("$", "us$", "usd", "€", "eur", "£", "gbp", "s$", "sgd", "¥", "jpy")
MAGNITUDES = ("million", "millions", "billion", "billions", "trillion", "thousand", "mn", "bn", "percent", "per cent", "%")
COUNTED = (
    "employees", "people", "staff", "workers", "headcount", "shares", "units", "customers", "stores", "patents", "locations", "countries", "subscribers", "users", "cases", "transactions",
)
QUANTIFIERS = ("more than", "fewer than", "less than", "at least", "at most", "approximately", "roughly", "nearly", "almost", "exceed", "exceeds", "exceeded", "exceeding")
#: Words of a question that narrow no line item, line items that need a request for a figure, names of parts of a company.
SCAFFOLDING = tuple(
    "what which was were is are be been how much many did do does report reported reports say says earn earned generate generated the a an this that its their there total in for during at on of to "
    "fy fye fiscal year years ended ending end period periods company companies group inc corp corporation plc ltd value dollars dollar usd".split()
)
FIGURE_SCAFFOLDING = SCAFFOLDING + tuple("compare and between from through over since change changed will next last as".split())
LINE_ITEMS = (
    "income before income taxes", "income tax expense", "provision for income taxes", "sales and marketing expense", "sales and marketing expenses", "stock-based compensation",
    "share-based compensation", "accounts receivable", "property and equipment", "property, plant and equipment", "intangible assets", "capital expenditures",
    "purchases of property and equipment", "interest paid",
)
ASKED_FOR = ("accounts_payable", "inventory")
SEGMENTS = ("aws", "amazon web services")
#: Scopes and qualifiers under which a whole company's annual figure answers nothing.
OTHER_SCOPE = (
    r"(?i)\b(?:segment|iphone|ipad|aws|azure|google cloud|product revenue|services revenue|quarter|quarterly|q[1-4]|combined|sum|average|difference|ratio|margin|(?:increased?|decreased?|grew|fell) by)\b"
)
QUALIFIER = r"(?i)\b(?:cost of|deferred|unearned|non-?operating|per (?:diluted|basic) share|purchase obligations?|reserves?|write[-\s]?downs?|percent(?:age)?)\b"
PER_SHARE = r"\s+per\s+(?:(?:basic|diluted|common|ordinary)\s+)*share\b"
#: Line items, what a question calls them and how filers tag them.
METRICS = {
    "revenue": (("total revenue", "revenues", "revenue", "net sales"), ("Revenues", "Revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"), "USD"),
    "net_income": (("net income", "net earnings", "net loss"), ("NetIncomeLoss", "ProfitLoss"), "USD"),
    "operating_income": (("operating income", "operating loss", "income from operations", "operating profit"), ("OperatingIncomeLoss",), "USD"),
    "assets": (("total assets",), ("Assets",), "USD"),
    "liabilities": (("total liabilities",), ("Liabilities",), "USD"),
    "accounts_payable": (("accounts payable", "trade payables"), ("AccountsPayableCurrent",), "USD"),
    "inventory": (("inventories",), ("InventoryNet",), "USD"),
    "cash": (("cash and cash equivalents", "cash and equivalents"), ("CashAndCashEquivalentsAtCarryingValue",), "USD"),
    "diluted_eps": (("diluted earnings per share", "diluted eps", "diluted net income per share"), ("EarningsPerShareDiluted",), "USD/shares"),
    "basic_eps": (("basic earnings per share", "basic eps", "basic net income per share"), ("EarningsPerShareBasic",), "USD/shares"),
    "operating_cash": (
        ("cash from operations", "operating cash flow", "net cash from operations", "net cash provided by operating activities",
         "net cash provided by (used in) operating activities", "cash provided by operating activities", "cash generated by operating activities",
         "cash flow provided by operating activities", "cash flows from operating activities"),
        ("NetCashProvidedByUsedInOperatingActivities",), "USD"),
}


def phrase(words: tuple[str, ...]) -> str:
    """Pattern of whole phrases, the longest first."""
    return r"(?<![\w])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + r")(?![\w])"


def has(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(phrase(words))


def either(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


def year_pattern(four: str = r"(?:19|20)\d{2}", two: str = r"\d{2}", any4: str = r"\d{4}") -> str:
    """A year as a question writes it: FY2024, FY24, fiscal year 2024, '24, or a bare number that nothing beside it makes an amount, a count or the date of a law."""
    bare = (
        # the first look ahead spares the others where no digit stands
        rf"(?=\d)(?<![\d.,])(?<!{either(CURRENCIES)}\s{{0,3}})(?<!\bact\s{{1,3}}of\s{{1,3}})\b{four}\b(?![.,]\d)(?!\s*{either(MAGNITUDES)}(?!\w))"
        # a count, unless an owner before it makes the number the date of the count
        rf"(?:(?<=(?:['’]s|\b(?:its|their|the))\s{{1,3}}\d{{4}})|(?!\s*{either(COUNTED)}(?!\w)))"
        rf"(?!(?<=\b{either(QUANTIFIERS).replace(r'\s+', ' ')}\s{{1,3}}\d{{4}})\s+[a-z]+s\b)"
    )
    return rf"(?:\bfye?\s?(?:{any4}|{two})\b|\bfiscal(?:\s+year)?\s+(?:{any4}|{two})\b|['’]{two}(?![\w'’]|-[a-z])|{bare})"


_YEAR = year_pattern()
_JOIN = r"(?:-|–|—|to\b|through\b|thru\b|until\b|till\b)"


def _spelled(text: Column) -> Column:
    """FY22-24 as FY22 - FY24."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(fye?\s?)(\d{4}|\d{2})\s*(-|–|—|to|through)\s*(\d{2})\b", "$1$2 $3 $1$4")


def _year_value(mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    return F.when(F.length(digits) == 4, digits.try_cast("int")).otherwise(digits.try_cast("int") + 2000)


def year_mentions(text: Column) -> Column:
    """Years as the question writes them, in order."""
    return F.regexp_extract_all(_spelled(text), F.lit(f"(?i)({_YEAR})"), F.lit(1))


def years_in(text: Column, low: int, high: int, most: int = 10) -> Column:
    """Sorted fiscal years that a question names, those inside a range of at most ``most`` years included; numbers that are amounts or counts are not years."""
    t = _spelled(text)
    spans = []
    for pattern in (rf"(?i)({_YEAR})\s*{_JOIN}\s*(?=({_YEAR}))", rf"(?i)\bbetween\s+({_YEAR})\s+and\s+(?=({_YEAR}))"):
        ends = [F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(i)), _year_value) for i in (1, 2)]
        pairs = F.arrays_zip(ends[0].alias("a"), ends[1].alias("b"))
        lo, hi = lambda r: F.least(r["a"], r["b"]), lambda r: F.greatest(r["a"], r["b"])
        spans.append(F.flatten(F.transform(pairs, lambda r: F.when(hi(r) - lo(r) <= most, F.sequence(lo(r), hi(r))).otherwise(F.array(r["a"], r["b"])))))
    named = F.concat(F.transform(year_mentions(text), _year_value), *spans)
    return F.array_sort(F.array_distinct(F.filter(named, lambda y: (y >= low) & (y <= high))))


def years_outside(text: Column, low: int, high: int) -> Column:
    """Mentions of years outside the bounds, as written."""
    return F.array_distinct(F.filter(year_mentions(text), lambda m: ~_year_value(m).between(low, high)))


def companies_in(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, tickers, names): companies whose alias (alias, ticker) stands in the question as a whole phrase, or whose ticker does in capitals, in order of first mention, and those aliases.

    Aliases and questions meet on the first word of the alias, so no question is held against all aliases. An alias without a ticker is that of a company outside the corpus; it is in
    neither list but in ``outside``.
    """
    by_alias = aliases.select("alias", "ticker", F.lower("alias").alias("form"), F.lit(False).alias("exact"))
    by_ticker = aliases.where("ticker is not null").select(F.col("ticker").alias("alias"), "ticker", F.col("ticker").alias("form"), F.lit(True).alias("exact")).distinct()
    a = by_alias.union(by_ticker).withColumn("head", F.regexp_extract(F.lower("form"), r"([\p{L}\p{N}]+)", 1)).where("head <> ''")
    q = questions.select("qid", F.coalesce("text", F.lit("")).alias("t"))
    heads = q.select("qid", "t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("head"))
    words = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    padded = F.concat(F.lit(" "), words(F.when(F.col("exact"), F.col("t")).otherwise(F.lower("t"))), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.trim(words(F.col("form"))), F.lit(" "))
    met = heads.join(a, "head").withColumn("at", F.position(wanted, padded)).where("at > 0")
    one = met.groupBy("qid", F.coalesce("ticker", F.concat(F.lit(" "), F.lower("alias"))).alias("who"), "ticker").agg(F.min("at").alias("at"), F.collect_set("alias").alias("aliases"))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "who")))), lambda x: F.trim(x["who"]))
    found = one.groupBy("qid").agg(
        order(F.col("ticker").isNotNull()).alias("tickers"), order(F.col("ticker").isNull()).alias("outside"),
        # the longest first, so that a name inside another one is taken out with it
        F.transform(
            F.sort_array(F.transform(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ticker").isNotNull(), F.col("aliases"))))), lambda n: F.struct(F.length(n).alias("k"), n.alias("n"))), asc=False), lambda x: x["n"]
        ).alias("names"),
    )
    empty = F.array().cast("array<string>")
    return questions.select("qid").join(found, "qid", "left").select("qid", *[F.coalesce(c, empty).alias(c) for c in ("tickers", "names", "outside")])


_ALIAS_OF = {alias: key for key, (names, _, _) in METRICS.items() for alias in names}
_SHARE = tuple(a for a, k in _ALIAS_OF.items() if METRICS[k][2] == "USD/shares")
_PLAIN = tuple(a for a, k in _ALIAS_OF.items() if METRICS[k][2] != "USD/shares")
#: One alternation, the longest name first, so that a name inside a longer one is part of it; a name with "per share" after it is no line item.
_NAMES = r"(?i)\b(" + "|".join(
    re.escape(n).replace(r"\ ", r"\s+") + (r"(?!\w)" if n in _SHARE else rf"(?!\w)(?!{PER_SHARE})") for n in sorted(_ALIAS_OF, key=len, reverse=True)
) + ")"


def metrics_in(text: Column) -> Column:
    """Line items that a text names."""
    keys = F.create_map(*[F.lit(x) for pair in _ALIAS_OF.items() for x in pair])
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_NAMES), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.element_at(keys, F.regexp_replace(n, r"\s+", " "))))


def metric_in(text: Column) -> Column:
    """The one line item that a text names; null where it names none or several."""
    found = metrics_in(text)
    return F.when(F.size(found) == 1, found[0])


def names_per_share_amount(text: Column) -> Column:
    """Names a line item per share without saying which earnings per share it means."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b{either(_PLAIN)}{PER_SHARE}")


def asked_metric(bare: Column) -> Column:
    """The line item that a question without its companies asks for and nothing narrower; null where a scope, a qualifier or any other word is left."""
    t = F.coalesce(bare, F.lit(""))
    rest = F.regexp_extract_all(F.lower(F.regexp_replace(t, _NAMES, " ")), F.lit(r"([a-z0-9']+)"), F.lit(1))
    frame = lambda w: F.regexp_replace(w, "'s$", "").isin("", *SCAFFOLDING) | w.rlike(r"^(?:(?:fye?|fiscal)?'?\d{2,4}|'s?)$")
    return F.when(~t.rlike(OTHER_SCOPE) & ~t.rlike(QUALIFIER) & F.forall(rest, frame), metric_in(t))


def has_cue(text: Column) -> Column:
    """Holds a phrase that asks for a figure."""
    extra = tuple(a for key, (names, _, _) in METRICS.items() if key not in ASKED_FOR for a in names)
    return has(text, NUMERIC + extra)


def asks_for_label(bare: Column, labels: tuple[str, ...]) -> Column:
    """A whole line item and beside it only the frame of a question for a figure."""
    pattern = r"\b" + either(tuple({" ".join(re.findall(r"\w+", x.lower())) for x in labels})) + r"\b"
    t = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(bare, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")
    rest = F.filter(F.split(F.regexp_replace(t, pattern, " "), r"\s+"), lambda w: w != "")
    return t.rlike(pattern) & F.forall(rest, lambda w: w.isin(*FIGURE_SCAFFOLDING))


def wants_figures(text: Column, bare: Column | None = None) -> Column:
    """Asks for a figure: by a phrase, by "what was the total", or for nothing but a line item; ``bare`` is the question without its companies and years."""
    b = F.coalesce(text if bare is None else bare, F.lit(""))
    total = b.rlike(r"(?i)\bwhat\s+(?:was|were|is|are)\s+(?:(?:the|its|their)\s+)?total\b")
    labels = tuple(a for key in ASKED_FOR for a in METRICS[key][0]) + LINE_ITEMS
    return has_cue(text) | total | asks_for_label(b, labels)


_REQUEST = (
    r"(?i)(?:^\s*|" + "".join(rf"(?<!\b{x})" for x in SUFFIXES) + r"[,;:.?!]\s*|\b(?:can|could|would|will)\s+you\s+(?:please\s+)?|\bplease\s+)" + either(PREDICT) + r"\b(?!\s+of\b)"
)
_WORD = r"(?:[\w'’.-]{1,30}\s{1,3})?"
_NOT_LATER = rf"(?<!(?:\b(?:will|would|shall|going\s{{1,3}}to)|['’]ll)\s{{1,3}}{_WORD}{_WORD}{_WORD})"
_REPORTS = (
    rf"(?i)(?<!\byou\s)(?<!\w){_NOT_LATER}(?:{either(tuple(v for v in REPORTING if v not in DESCRIBING))}|"
    rf"(?<!(?:['’]s|\b(?:is|are|be|been|its|their|the|an?))\s{{1,3}}){either(DESCRIBING)})(?!\w)"
)


def is_request(text: Column) -> Column:
    """Asks for advice or for a prediction of the engine's own."""
    return has(text, ADVICE) | F.coalesce(text, F.lit("")).rlike(_REQUEST)


def reports_on_filing(text: Column) -> Column:
    """A verb of reporting that is the filing's: not the reader's, not in the future, not describing the thing asked for."""
    return F.coalesce(text, F.lit("")).rlike(_REPORTS)


def is_unanswerable(text: Column) -> Column:
    """Asks for advice, for a prediction, or for a price or the future itself rather than for what the filing says of them."""
    return F.coalesce(is_request(text) | (~reports_on_filing(text) & (has(text, BEYOND_FILING) | has(text, FUTURE))), F.lit(False))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\b\Q"), F.regexp_replace(name, r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E(?!\w)"))


def names_whose_figure(text: Column, names: Column) -> Column:
    """One of the names is that of the company whose figure is asked for: as a possessive, as the subject of a verb that makes the figure its own, or after "of"."""
    t = F.coalesce(text, F.lit(""))

    def one(n: Column) -> Column:
        q = _quoted(n)
        owner = F.concat(F.lit("(?i)"), q, F.lit(r"(?:['’]s\b|['’](?!\w))"))
        subject = F.concat(F.lit(r"(?i)\b(?:did|does|do|has|have|had|will|would|can|could)\s+"), q, F.lit(r"\s+" + either(OWNING)))
        of = F.concat(F.lit(rf"(?i)\b(?!{either(RELATIONS)}\b)\w+\s+of\s+"), q, F.lit(r"\s*(?:$|[?,.;:]|\s(?:in|for|during|as|at|over|across)\b|\s(?:FY)?\d)"))
        return F.rlike(t, owner) | F.rlike(t, subject) | F.rlike(t, of)

    return F.exists(names, one)


def without(text: Column, names: Column, continued: bool = True) -> Column:
    """The text without the names and their possessives; without ``continued``, names that go on as a product's or a segment's are kept."""
    keep = F.lit(r"(?:['’]s\b|['’](?!\w))?" if continued else r"(?:['’]s\b|['’](?!\w)|(?!\s+(?:[A-Z]|\d(?!\d{3}\b))))")
    return F.aggregate(names, F.coalesce(text, F.lit("")), lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?i:"), _quoted(n), F.lit(")"), keep), F.lit(" ")))


def without_years(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """The text without its years and what leads up to them; with bounds, only those within, and not in dates."""
    if low is None:
        return F.regexp_replace(_spelled(text), f"(?i){_YEAR}", " ")
    four = "(?:" + "|".join(str(y) for y in range(low, high + 1)) + ")"
    two = "(?:" + "|".join(f"{y % 100:02d}" for y in range(max(low, 2000), min(high, 2099) + 1)) + ")"
    lead = r"(?:(?:\b(?:in|for|during|from|to|through|between|and|of)|[-–—])\s*)?"
    date = r"(?=[\d'’f])(?<!\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,9}\.?\s{1,3}\d{1,2},?\s{0,3})"
    return F.regexp_replace(_spelled(text), f"(?i){lead}{date}{year_pattern(four, two, four)}", " ")


def search_text(text: Column, names: Column, low: int, high: int) -> Column:
    """The question without the companies and years that filters apply; names of segments and products stay, and so does the question where no word would be left."""
    t = F.coalesce(text, F.lit(""))
    kept = without_years(without(t, F.filter(names, lambda n: ~F.lower(n).isin(*SEGMENTS)), continued=False), low, high)
    tidy = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(kept, r"\s+", " ")), r"\s+([,.;:?!])", "$1"), r"([,;:])(?:\s*[,;:])+", "$1")
    return F.when(tidy.rlike(r"\w"), tidy).otherwise(t)


def question_type(text: Column, n_tickers: Column, n_years: Column, beyond: Column | None = None, figures: Column | None = None) -> Column:
    """First that holds: unanswerable, comparative by two companies, temporal by a word or two years, comparative by a word, numeric, factual.

    ``beyond`` adds what else makes it unanswerable: only companies or years that the corpus does not have.
    """
    return (
        F.when(is_unanswerable(text) | (F.lit(False) if beyond is None else beyond), "unanswerable")
        .when(n_tickers >= 2, "comparative")
        .when(has(text, TEMPORAL) | (n_years >= 2), "temporal")
        .when(has(text, COMPARATIVE), "comparative")
        .when(wants_figures(text) if figures is None else figures, "numeric")
        .otherwise("factual")
    )


def parse_questions(questions: DataFrame, aliases: DataFrame, low: int, high: int) -> DataFrame:
    """(qid, tickers, years, unresolved, question_type, because, wants_figures, metric, asked_metric, search_text, described) of questions(qid, text).

    unresolved: companies (aliases without a ticker) and years outside the bounds, as written. because: why a question is unanswerable: 'request' (advice, a prediction), 'company' (the figure of
    a company outside the corpus), 'topic' (a price, the future, a company outside), 'year' (only years outside). metric: the line item named; asked_metric: the one asked for and nothing narrower.
    Null and blank questions are factual with empty lists.
    """
    scope = companies_in(questions, aliases)
    t = F.coalesce("text", F.lit(""))
    met = questions.select("qid", F.trim(t).alias("text")).join(scope, "qid")
    bare = without(F.col("text"), F.concat("names", "outside"))
    first = computed_once(
        met, ["qid", "text", "tickers", "names", "outside"],
        {"years": years_in(F.col("text"), low, high), "bad_years": years_outside(F.col("text"), low, high), "bare": bare, "figure_text": without_years(bare)},
    )
    second = computed_once(
        first, ["qid", "text", "tickers", "outside", "years", "bad_years"],
        {
            "figures": wants_figures(F.col("text"), F.col("figure_text")), "metric": metric_in(F.col("text")), "asked_metric": asked_metric(F.col("bare")), "request": is_request(F.col("text")),
            "search_text": search_text(F.col("text"), F.col("names"), low, high), "beyond": is_unanswerable(F.col("text")),
        },
    )
    only_outside = (F.size("outside") > 0) & (F.size("tickers") == 0)
    only_bad = (F.size("bad_years") > 0) & (F.size("years") == 0)
    kind = question_type(F.col("text"), F.size("tickers"), F.size("years"), only_outside | only_bad, F.col("figures"))
    because = F.when(
        F.col("question_type") == "unanswerable",
        F.when(F.col("request"), "request")
        .when(only_outside & F.col("figures") & names_whose_figure(F.col("text"), F.col("outside")), "company")
        .when(only_outside | F.col("beyond"), "topic")
        .otherwise("year"),
    )
    out = second.withColumn("question_type", kind).withColumn("because", because).withColumn("unresolved", F.concat("outside", "bad_years"))
    return out.select("qid", "tickers", "years", "unresolved", "question_type", "because", F.col("figures").alias("wants_figures"), "metric", "asked_metric", "search_text", described().alias("described"))


def refused(because: Column, tickers: Column) -> Column:
    """Why a question is not searched: requests never are, an outside company's figure is only where a company to search is named."""
    return F.when((because == "request") | ((because == "company") & (F.size(tickers) == 0)), because)


def described() -> Column:
    """One line per thing that was read, for a person; uses the columns of parse_questions."""
    searched = F.when(F.col("because").isNotNull() & refused(F.col("because"), F.col("tickers")).isNull(), ", searched in case a filing answers it").otherwise("")
    listed = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    none = F.when((F.size("tickers") == 0) & (F.size("years") == 0), "Filters: none, searching every company and year")
    return F.array_compact(
        F.array(
            F.concat(F.lit("Question type: "), F.col("question_type"), searched), listed("Companies: ", F.col("tickers")),
            listed("Fiscal years: ", F.transform("years", lambda y: F.concat(F.lit("FY"), y.cast("string")))), none, listed("Not in the corpus: ", F.col("unresolved")),
        )
    )


def scoped(parsed: DataFrame, tickers: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """Parsed questions in the companies (qid, tickers) and years (qid, years) that were chosen by hand, where any were."""
    out = parsed
    for name, chosen in (("tickers", tickers), ("years", years)):
        if chosen is not None:
            out = out.join(chosen.select("qid", F.col(name).alias("__c")), "qid", "left").withColumn(name, F.coalesce("__c", name)).drop("__c")
    return out


def refusal(parsed: DataFrame) -> DataFrame:
    """(qid, reason): why a parsed question is refused without a search; null otherwise."""
    return parsed.select("qid", refused(F.col("because"), F.col("tickers")).alias("reason"))
