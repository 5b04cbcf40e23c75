"""Sentence normalisation as column expressions, applied in a fixed order.

Everything runs in the JVM but the unescaping of HTML entities, which has no built-in; it
is an Arrow function that only rows with an ampersand reach.
"""

from __future__ import annotations

import html
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L
from .literals import array_of, map_of

BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DIGIT = r"\p{Nd}"
BEFORE_WORD, AFTER_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_FRACTION = rf"{DIGIT}*#{DIGIT}+\${DIGIT}+"
_AMOUNT = rf"[{DIGIT}.]+|{_FRACTION}"
_SPLIT_UNITS = "|".join(dict.fromkeys([*L.UNIT_WORDS, "x", *L.LENGTH_UNITS]))
_WORDS = "|".join(L.NUMBER_WORDS)
_DUPLICATE_UNITS = rf"(?i)(({_AMOUNT}){BLANK}([a-zA-Z]+){BLANK}*(?:-|to|or){BLANK}*({_AMOUNT}){BLANK}([a-zA-Z]+))"
_NUMBER = rf"[1-9][{DIGIT}.]*?|{_FRACTION}"
FRACTION_TOKEN = rf"^{_FRACTION}(?:-{_FRACTION})?$"


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


_PRICE = rf"\({BLANK}*(?:\$|£|€|¥|₹){BLANK}*[0-9.,]+\**{BLANK}*\)"


def remove_prices(c: Column) -> Column:
    return F.regexp_replace(c, _PRICE, "")


def replace_dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit(" - "))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_html(c: Column, only: tuple[str, ...] = ()) -> Column:
    """All references as HTML5 has them, those without a semicolon too; with ``only``, names, these alone, with their semicolons, and all else stays."""
    unescape = _unescape
    if only:
        some = re.compile(f"&(?:{'|'.join(map(re.escape, only))});")

        @F.pandas_udf(StringType())
        def unescape(s: pd.Series) -> pd.Series:
            return s.map(lambda text: some.sub(lambda m: html.unescape(m[0]), text), na_action="ignore")

    return F.when(F.contains(c, F.lit("&")), unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def replace_fraction_characters(c: Column) -> Column:
    """Spelled out with a blank before, but not behind a hyphen, where that would break a range."""
    for lead, out in (("-", "-"), ("", " ")):
        for character, spelled in L.FRACTION_CHARACTERS.items():
            c = F.replace(c, F.lit(lead + character), F.lit(out + spelled))
    return c


_BY_AND = rf"({DIGIT}+){BLANK}and{BLANK}({DIGIT})/({DIGIT}+)"


def join_quantities_by_and(c: Column) -> Column:
    return F.regexp_replace(c, _BY_AND, r"$1#$2\$$3")


_PLAIN_FRACTION = rf"({DIGIT}*{BLANK}*{DIGIT}/{DIGIT}+)"


def mark_fractions(c: Column) -> Column:
    """``1 1/2`` becomes ``1#1$2``: the longest first, each wherever it stands; ratios such as 80/20 stay."""
    c = F.replace(c, F.lit("⁄"), F.lit("/"))
    found = F.transform(F.regexp_extract_all(c, F.lit(_PLAIN_FRACTION), F.lit(1)), lambda m: strip_blank(m))
    ordered = F.array_sort(F.transform(found, lambda m, i: F.struct((-F.length(m)).alias("size"), i.alias("place"), m.alias("text"))))

    def mark(text: Column, m: Column) -> Column:
        m = m["text"]
        parts = F.split(m, "/")
        ratio = ~F.contains(m, F.lit(" ")) & (parts[0].try_cast("bigint") + parts[1].try_cast("bigint") == 100)
        marked = F.replace(m, F.lit("/"), F.lit("$"))
        marked = F.when(F.contains(m, F.lit(" ")), F.regexp_replace(marked, f"{BLANK}+", "#")).otherwise(F.concat(F.lit("#"), marked))
        return F.when(F.coalesce(ratio, F.lit(False)), text).otherwise(F.replace(text, m, marked))

    return F.when(F.contains(c, F.lit("/")), F.aggregate(ordered, c, mark)).otherwise(c)


#: Patterns that part quantities from units, with what stands between their two groups then.
_PARTED = (
    (rf"({DIGIT})-?({_SPLIT_UNITS})(?![a-wyzA-WYZ])", " "),
    (rf"({_SPLIT_UNITS})({DIGIT})", " "),
    (rf"({_SPLIT_UNITS})-({DIGIT})", " - "),
    (rf"(?i){BEFORE_WORD}({_WORDS})-({_SPLIT_UNITS}){AFTER_WORD}", " "),
)


def split_quantities_and_units(c: Column) -> Column:
    for pattern, between in _PARTED:
        c = F.regexp_replace(c, pattern, f"$1{between}$2")
    return c


_DOTTED = ["tsp.", "tsps.", "tbsp.", "tbsps.", "tbs.", "tb.", "lb.", "lbs.", "oz."]  # fixed values
_DOTTED += [L.capitalise(u) for u in _DOTTED]


def drop_unit_periods(c: Column) -> Column:
    for unit in _DOTTED:
        c = F.replace(c, F.lit(unit), F.lit(unit[:-1]))
    return c


_STRING_RANGE = rf"(0\.[0-9]|{_NUMBER}){BLANK}*(-)?{BLANK}*(to|or){BLANK}*(-)*{BLANK}*((0\.[0-9]+|{_NUMBER})(-)?)"


def replace_string_ranges(c: Column) -> Column:
    return F.regexp_replace(c, _STRING_RANGE, "$1-$5")


def merge_duplicate_units(c: Column) -> Column:
    """``227 g - 283.5 g`` becomes ``227-283.5 g`` where both units are the same known unit."""
    plural, group = map_of(L.UNITS), map_of(L.SYNONYM_GROUP)
    known, lengths = array_of(L.UNIT_WORDS), array_of(L.LENGTH_UNITS)

    def of(unit: Column) -> Column:
        return F.when(F.array_contains(known, unit), F.try_element_at(group, F.coalesce(F.try_element_at(plural, unit), unit)))

    def merge(text: Column, whole: Column) -> Column:
        q1, u1, q2, u2 = (F.regexp_extract(whole, _DUPLICATE_UNITS, n) for n in (2, 3, 4, 5))
        same = (u1 == u2) | F.coalesce(of(u1) == of(u2), F.lit(False))
        use = same & (F.array_contains(known, u1) | F.array_contains(lengths, u1))
        return F.when(use, F.replace(text, whole, F.concat(q1, F.lit("-"), q2, F.lit(" "), u1))).otherwise(text)

    found = F.regexp_extract_all(c, F.lit(_DUPLICATE_UNITS), F.lit(1))
    return F.when(c.rlike(_DUPLICATE_UNITS), F.aggregate(found, c, merge)).otherwise(c)


_MULTIPLIER = rf"({_AMOUNT}){BLANK}[xX]{BLANK}*"
_SPACED_RANGE = rf"({DIGIT}){BLANK}*-{BLANK}*([{DIGIT}#])"


def merge_multipliers(c: Column) -> Column:
    return F.regexp_replace(c, _MULTIPLIER, "$1x ")


def collapse_ranges(c: Column) -> Column:
    return F.regexp_replace(c, _SPACED_RANGE, "$1-$2")


#: The rules by name, in the order in which they apply.
RULES = {
    "remove_prices": remove_prices,
    "replace_dashes": replace_dashes,
    "unescape_html": unescape_html,
    "replace_fraction_characters": replace_fraction_characters,
    "join_quantities_by_and": join_quantities_by_and,
    "mark_fractions": mark_fractions,
    "split_quantities_and_units": split_quantities_and_units,
    "drop_unit_periods": drop_unit_periods,
    "replace_string_ranges": replace_string_ranges,
    "merge_duplicate_units": merge_duplicate_units,
    "merge_multipliers": merge_multipliers,
    "collapse_ranges": collapse_ranges,
}


def add_normalised(df, sentence: str = "sentence", out: str = "normalised"):
    """``df`` with the normalised sentence; a rule per projection keeps each expression small."""
    df = df.withColumn(out, F.col(sentence).cast("string"))
    for rule in RULES.values():
        df = df.withColumn(out, rule(F.col(out)))
    return df.withColumn(out, strip_blank(F.col(out)))


@cache
def _in_python(pattern: str) -> re.Pattern:
    """The same pattern for Python's engine, whose blanks are others and whose digits are all decimal ones."""
    blank = BLANK.replace(r"\s", r" \t\n\r\f").replace(r"\x0B", r"\x0b")
    blank = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", blank)
    return re.compile(pattern.replace(BLANK, blank).replace(DIGIT, r"\d"))


def _stripped(text: str) -> str:
    return _in_python(rf"^{BLANK}+|{BLANK}+\Z").sub("", text)


def normalise_text(text: str) -> str:
    """The rules for one sentence in Python, for SQL functions that are given sentences; equal to the column form."""
    text = _in_python(_PRICE).sub("", text).replace("–", "-").replace("—", " - ")
    text = html.unescape(text) if "&" in text else text
    for lead, out in (("-", "-"), ("", " ")):
        for character, spelled in L.FRACTION_CHARACTERS.items():
            text = text.replace(lead + character, out + spelled)
    text = _in_python(_BY_AND).sub(r"\1#\2$\3", text).replace("⁄", "/")
    for found in sorted((_stripped(m) for m in _in_python(_PLAIN_FRACTION).findall(text)), key=lambda m: -len(m)):
        top, bottom = found.split("/")[:2]
        if " " in found:
            text = text.replace(found, _in_python(f"{BLANK}+").sub("#", found.replace("/", "$")))
        elif not (top.isdecimal() and bottom.isdecimal() and int(top) + int(bottom) == 100):
            text = text.replace(found, "#" + found.replace("/", "$"))
    for pattern, between in _PARTED:
        text = _in_python(pattern).sub(rf"\1{between}\2", text)
    for unit in _DOTTED:
        text = text.replace(unit, unit[:-1])
    text = _in_python(_STRING_RANGE).sub(r"\1-\5", text)
    known = set(L.UNIT_WORDS)
    group = lambda u: L.SYNONYM_GROUP.get(L.UNITS.get(u, u)) if u in known else None
    for whole, low, first, high, second in _in_python(_DUPLICATE_UNITS).findall(text):
        if (first in known or first in L.LENGTH_UNITS) and (first == second or (group(first) is not None and group(first) == group(second))):
            text = text.replace(whole, f"{low}-{high} {first}")
    text = _in_python(_MULTIPLIER).sub(r"\1x ", text)
    return _stripped(_in_python(_SPACED_RANGE).sub(r"\1-\2", text))
