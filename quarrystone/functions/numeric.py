"""Number expressions: boosts, budgets in characters, densities and printed forms of a figure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token of prose and of dense text, and the densities between which the one becomes the other.
PROSE_PER_TOKEN, TABLE_PER_TOKEN = 4.0, 1.6
DENSE_FROM, DENSE_AT = 0.15, 0.35
BUDGET, OVERLAP, MINIMUM = 1800, 300, 200
#: Days of an annual period.
YEAR_DAYS = (350, 380)


def boosted(score: Column, boost: Column) -> Column:
    """Raises a score whatever its sign."""
    return F.when(score >= 0, score * boost).otherwise(score / boost)


def table_budget(budget: Column) -> Column:
    return F.bround(budget * TABLE_PER_TOKEN / PROSE_PER_TOKEN).cast("int")


def overlap_budget(budget: Column) -> Column:
    return F.bround(budget * OVERLAP / BUDGET).cast("int")


def density(text: Column) -> Column:
    """Share of visible characters that are no letters; 0 without any."""
    visible = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))
    return F.when(visible > 0, (visible - letters) / visible).otherwise(0.0)


def chars_per_token(text: Column) -> Column:
    progress = F.least(F.greatest((density(text) - DENSE_FROM) / (DENSE_AT - DENSE_FROM), F.lit(0.0)), F.lit(1.0))
    return PROSE_PER_TOKEN - progress * (PROSE_PER_TOKEN - TABLE_PER_TOKEN)


def block_cost(text: Column) -> Column:
    """What a paragraph costs of a prose budget: its length, more where it is dense with figures."""
    return F.bround(F.length(F.coalesce(text, F.lit(""))) * PROSE_PER_TOKEN / chars_per_token(text)).cast("int")


def exact(raw: Column, fallback: Column | None = None) -> Column:
    """The printed value as an exact decimal: accounting parentheses are minus, thousands separators go; null where it is no number."""
    t = F.regexp_replace(F.trim(raw), r"[$€£,\s ]", "")
    negative = t.rlike(r"^\(.*\)$")
    plain = F.regexp_replace(t, r"[()]", "").try_cast("decimal(38,10)")
    value = F.when(negative, -plain).otherwise(plain)
    return value if fallback is None else F.coalesce(value, fallback.try_cast("decimal(38,10)"))


def printed_forms(value: Column) -> Column:
    """Distinct ways in which filings print an amount: whole at scales 1, 1e3, 1e6 and 1e9, with and without separators, and in tenths
    of a million; forms of fewer than three digits (four characters for tenths) say too little and are left out."""
    v = F.abs(value)
    forms = []
    for scale in (1, 1_000, 1_000_000, 1_000_000_000):
        at = v / F.lit(scale)
        is_whole = at == F.floor(at)
        text = at.cast("decimal(38,0)").cast("string")
        grouped = F.format_number(at.cast("decimal(38,0)"), 0)
        keep = is_whole & (F.length(text) >= 3)
        forms += [F.when(keep, text), F.when(keep, grouped)]
    tenth = F.format_number(F.round(v / F.lit(1_000_000), 1), 1)
    forms.append(F.when((v >= 1_000_000) & (F.length(tenth) >= 4), tenth))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*forms))))


def format_amount(value: Column, unit: Column) -> Column:
    """Sign outside the currency sign; per share, ratio or the unit after the number."""
    number = F.format_number(F.abs(value), 2)
    number = F.regexp_replace(number, r"\.00$", "")
    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when(unit == "USD", F.concat(sign, F.lit("$"), number))
        .when(unit == "USD/shares", F.concat(sign, F.lit("$"), F.format_number(F.abs(value), 2), F.lit(" per share")))
        .when(unit.isin("pure", "ratio"), F.concat(sign, number))
        .otherwise(F.concat(sign, number, F.lit(" "), F.coalesce(unit, F.lit(""))))
    )


def matches_at_precision(claim: Column, value: Column, quantum: Column) -> Column:
    """Equal once the value is rounded half up to the precision in which the claim is written."""
    return F.round(value / quantum) * quantum == claim
