"""How a text ends: columns that tell whole endings from ones that stop inside a word or a sentence."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without width, and what may stand for a space.
INVISIBLE = "[\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufe0f\\ufeff]"
OTHER_SPACES = "\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\t\\n\\u000b\\f\\r"
#: White space that is more than one plain space; text without any is left as it is.
SPACES = f" *[{OTHER_SPACES}]+[ {OTHER_SPACES}]*| {{2,}}"

#: Words that mark an abbreviation when a text stops after their full stop.
ABBREVIATIONS = "Inc Corp Co Ltd approx No Nos St Mr Mrs Ms Dr Mio Mrd Nr bzw ca vs resp incl excl Art fig al"
#: Capitalised words that start sentences or stand in titles and are no names by themselves.
STARTERS = (
    "A According Across Additionally After All Although An And Annual Any As At Because Before Both But By Certain Consequently "
    "Contrary Currently Despite Due During Each Even Excluding Following For From Further Given Historically However If In It Its "
    "Most Net No Note Of On Once Other Our Outside Over Question See Several Since So Some Such That The Their There These They "
    "This Those To Under Unless Until We What When Where Whereas While With "
    "Aufgrund Außerdem Bei Da Damit Das Der Die Ein Eine Im In Laut Nach Ohne Seit Trotz Unter Vor Während Wegen Wie Zum Zur Zusätzlich "
    "Au Aucun Aux Ce Ces Cette Comme Compte Dans De Depuis Des Du Elle En Hors Il La Le Les Leur Lors Malgré Par Pour Quel Quels Sans Selon Sur Un Une À "
    "Además Al Ante Antes Aunque Como Con Cual Desde Durante El Ella Entre Esta Este La Las Los Para Pese Por Según Si Sin Sobre Tras Un Una"
)


#: What ends a sentence, what may close after it, and marks put where something was cut.
STOPS, CLOSERS = (".", "!", "?", "。", "！", "？"), "\"'”’»)]"
CUT_MARKS = ("[…]", "[...]", "[truncated]", "[cut]", "[continued]", "<truncated>")


def clean(text: Column) -> Column:
    """Without invisible characters, with single spaces, trimmed; null becomes empty. Plain texts are not rewritten."""
    t = F.coalesce(text, F.lit(""))
    odd = F.octet_length(t) != F.length(t)
    for c in ("\n", "\t", "\r", "  ", "\u000b", "\f"):
        odd = odd | F.contains(t, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), SPACES, " ")).otherwise(t))


def without_citations(text: Column) -> Column:
    """Without whole citation markers such as [3] or [1, 4] at the end."""
    return F.trim(F.when(F.endswith(F.rtrim(text), F.lit("]")), F.regexp_replace(text, r"(?:\s*\[\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\])+\s*$", "")).otherwise(text))


_UNIT = r"(?i:%|percent|per cent|million|millions|billion|billions|thousand|bn|m|mn|k|mio|mrd|millionen|milliarden|millones|mil|milliards|usd|eur|euro|euros|dollars|bps|x|years?|days?|shares?|d'euros|de euros|of)"
_FIGURE = r"[(+\-–−~]?\s?(?:[A-Z]{0,3}[$€£¥])?\s?[(\-–−]?\d[\d.,' ]*\d?\)?\s?(?:[$€£¥]\s?)?(?:" + _UNIT + r"\.?\s?){0,3}\)?"


def is_figure(text: Column) -> Column:
    """Nothing but figures with units, as many as there are, however they are joined; a joiner at the end is no whole figure."""
    return text.rlike("^" + _FIGURE + r"(?:\s?(?:/|,|;|and|und|et|y|to|bis|à|a|–|-|vs\.?)\s?" + _FIGURE + r")*\.?$")


def is_name(text: Column) -> Column:
    """Nothing but capitalised names, joined by commas or a conjunction."""
    word = r"\p{Lu}[\p{L}\p{M}\d.&'’-]*"
    name = word + r"(?:\s" + word + r")*"
    plain = text.rlike("^" + name + r"(?:\s?[,;/]\s?(?:and\s|und\s|et\s|y\s)?" + name + r"|\s(?:and|und|et|y|&)\s" + name + r")*\.?$")
    return plain & ~text.rlike(r"^(?:" + "|".join(STARTERS.split()) + r")(?=$|[\s,.;])")


def ends_whole(text: Column) -> Column:
    """A sentence end, a bare figure or names. ``text`` is clean and without citations at its end; empty texts are whole."""
    # what only concerns the last characters looks at them alone
    last = lambda n: F.right(text, F.lit(n))
    ends = lambda *signs: reduce(or_, [F.endswith(text, F.lit(x)) for x in signs])
    stop = F.right(F.rtrim(text, F.lit(CLOSERS)), F.lit(1)).isin(*STOPS)
    ellipsis = ends("..", "…", *CUT_MARKS)
    abbreviated = ends(".") & last(16).rlike(r"(?:^|[\s(])(?:" + "|".join(ABBREVIATIONS.split()) + r"|\p{Lu}(?:\.\p{Lu})?)\.$")
    # a decimal part or the rest of a thousands group is missing: amounts below ten thousand are never written out in full
    split_number = ends(".") & last(8).rlike(r"[$€£]\d{1,3}\.$|[$€£]\d,\d{3}\.$") & ~is_figure(text)
    # an opening sign after which neither its closing sign nor the end of a sentence before another one comes
    opened = reduce(or_, [F.contains(text, F.lit(c)) for c in "(“«"])
    unclosed = opened & text.rlike(r"\((?:[^()]|\([^()]*\))*$|“[^”]*$|«[^»]*$") & ~text.rlike(r"[(“«](?:[^)”»]*)[.!?]\s+[\p{Lu}(“«¿¡][^(“«]*$")
    sentence = stop & ~ellipsis & ~abbreviated & ~split_number & ~unclosed
    return (text == "") | sentence | (~ellipsis & (is_figure(text) | (is_name(text) & ~unfinished_name(text))))


def unfinished_name(text: Column) -> Column:
    """Names that stop at a joiner or after one letter."""
    return text.rlike(r"(?:[,;/&-]|\s(?:and|und|et|y)|(?:^|[\s,;/])\p{Lu})$")
