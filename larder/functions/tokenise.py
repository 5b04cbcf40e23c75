"""Tokeniser and token scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .literals import array_of, map_of
from .normalise import BLANK, FRACTION_TOKEN

_FULL_STOP = r"(?<!\.[\p{L}\p{N}_])\.$"
FLOAT = r"^[+-]?(\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)([eE][+-]?\p{Nd}+)?$|^(?i)[+-]?(inf(inity)?|nan)$"
RANGE = r"^[\p{Nd}#$]+\s*-[\p{Nd}#$]+$"


def tokens(c: Column) -> Column:
    """Words with punctuation split off; and / or together again; a last full stop apart unless it ends an abbreviation."""
    padded = F.regexp_replace(c, r"([()\[\]{},/:;?!*~])", " $1 ")
    single = F.regexp_replace(F.regexp_replace(padded, f"{BLANK}+", " "), "^ | $", "")
    joined = F.regexp_replace(single, r"(?<=^|\s)and / or(?=\s|$)", "and/or")
    parts = F.transform(
        F.split(joined, " "),
        lambda t: F.when(t.rlike(_FULL_STOP), F.array(F.regexp_replace(t, r"\.$", ""), F.lit("."))).otherwise(F.array(t)),
    )
    return F.filter(F.flatten(parts), lambda t: t != "")


def is_float(c: Column) -> Column:
    return c.rlike(FLOAT)


def is_range(c: Column) -> Column:
    return c.rlike(RANGE)


def _is_simple_number(c: Column) -> Column:
    words = array_of(L.NUMBER_WORDS)
    plain = c.rlike(FRACTION_TOKEN) | F.array_contains(words, F.lower(c)) | (c == "dozen")
    number = F.when(F.endswith(c, F.lit("x")), is_float(F.regexp_replace(c, "x$", ""))).otherwise(is_float(c))
    return (c != "00") & (plain | number)


def is_numeric(c: Column) -> Column:
    """Fraction tokens, number words, dozens, multipliers, floats, and hyphened runs of these."""
    parts = F.forall(F.split(c, "-"), _is_simple_number)
    return F.when(F.contains(c, F.lit("-")) & ~c.rlike(FRACTION_TOKEN) & ~F.lower(c).isin(*L.NUMBER_WORDS), parts).otherwise(_is_simple_number(c))


def feature_text(c: Column, singular: Column | None = None) -> Column:
    return F.coalesce(singular, F.when(is_numeric(c), "!num").otherwise(c)) if singular is not None else F.when(is_numeric(c), "!num").otherwise(c)


def singular_unit(c: Column, custom: dict[str, str] | None = None) -> Column:
    """The singular of a known unit, null for other words."""
    units = L.UNITS | L.with_custom_units(custom)
    return F.try_element_at(map_of(units), c)


def is_unit(c: Column) -> Column:
    units = sorted({s for s in L.UNITS.values()} - set(L.LENGTH_UNITS))
    return F.array_contains(array_of(units), F.lower(c))


def is_punctuation(c: Column) -> Column:
    """Whether the text is a stretch of ASCII punctuation as listed, or a double hyphen."""
    return F.contains(F.lit(L.PUNCTUATION), c) | (c == "--")


def is_capitalised(c: Column) -> Column:
    return c.rlike("^[A-Z]")


def is_ambiguous_unit(c: Column) -> Column:
    return c.isin(*L.AMBIGUOUS_UNITS)


def is_dimension(c: Column) -> Column:
    return F.lower(c).isin(*L.DIMENSIONS)


_ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿÇçÑñŠšŽžĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻż"


def _plain(letters: str) -> str:
    import unicodedata

    return "".join(unicodedata.normalize("NFD", c)[0] for c in letters)


def word_shape(c: Column) -> Column:
    """Letters as x or X, digits as d, accents dropped (those of Latin-1 and Latin Extended-A)."""
    plain = F.regexp_replace(F.translate(c, _ACCENTED, _plain(_ACCENTED)), r"\p{Mn}", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[a-z]", "x"), "[A-Z]", "X"), "[0-9]", "d")


def length_bucket(n: Column) -> Column:
    """The largest bucket bound that a sentence of ``n`` tokens reaches, else 1."""
    out = F.lit(1)
    for bound in L.LENGTH_BUCKETS:
        out = F.when(n >= bound, bound).otherwise(out)
    return out


def inside_parentheses(texts: Column, index: Column) -> Column:
    """The k-th opening bracket is paired with the k-th closing one; brackets themselves are inside."""
    places = F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    opens = F.transform(F.filter(places, lambda p: p["t"].isin("(", "[")), lambda p: p["i"])
    closes = F.transform(F.filter(places, lambda p: p["t"].isin(")", "]")), lambda p: p["i"])
    inside = F.exists(F.arrays_zip(opens.alias("o"), closes.alias("c")), lambda z: (z["o"] < index) & (index < z["c"]))
    return F.get(texts, index).isin("(", ")", "[", "]") | F.coalesce(inside, F.lit(False))


def follows(texts: Column, index: Column, word: str) -> Column:
    """Whether an earlier token is the given word."""
    return F.array_contains(F.slice(texts, 1, index), word)


def affixes(c: Column) -> Column:
    """Prefixes and suffixes of three to five characters, of words longer than those."""
    n = F.length(c)
    rows = [F.when((n > k) & (c != "!num"), F.struct(F.lit(k).alias("size"), F.left(c, F.lit(k)).alias("prefix"), F.right(c, F.lit(k)).alias("suffix"))) for k in (3, 4, 5)]
    return F.array_compact(F.array(*rows))
