"""Tokens of a sentence and their features for sequence labelling, as they are after normalising and tokenising."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from . import chunk
from . import lexicon as L
from .stem import stem

FRACTION_TOKEN = re.compile(r"\d*#\d+\$\d+(?:-\d*#\d+\$\d+)?")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf(?:inity)?|nan)")
_RANGE = re.compile(r"[\d#$]+\s*-[\d#$]+")
_SHAPE = (("[a-z]", "x"), ("[A-Z]", "X"), ("[0-9]", "d"))


def is_float(text: str) -> bool:
    return _FLOAT.fullmatch(text.strip().replace("_", "") if text.strip() else text) is not None


def is_range(text: str) -> bool:
    return _RANGE.fullmatch(text) is not None


@lru_cache(maxsize=65536)
def is_numeric(text: str) -> bool:
    if text == "00":
        return False
    if FRACTION_TOKEN.fullmatch(text) or text.lower() in L.NUMBER_WORDS:
        return True
    if "-" in text:
        return all(map(is_numeric, text.split("-")))
    if text == "dozen":
        return True
    return is_float(text[:-1] if text.endswith("x") else text)


@lru_cache(maxsize=65536)
def word_shape(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    for pattern, to in _SHAPE:
        plain = re.sub(pattern, to, plain)
    return plain


class Token(NamedTuple):
    index: int
    text: str
    feat_text: str
    pos_tag: str
    stem: str
    shape: str
    is_capitalised: bool
    is_unit: bool
    is_punc: bool
    is_ambiguous_unit: bool


class Sentence:
    """A tokenised sentence with tags, unit singulars, phrases and features."""

    def __init__(self, words: list[str], tagger, custom_units: dict[str, str] | None = None, tagdict: dict[str, str] | None = None):
        units = L.UNITS | L.with_custom_units(custom_units) if custom_units else L.UNITS
        singulars = set(units.values()) if custom_units else _SINGULARS
        self.tokens: list[Token] = []
        self.singularised: list[int] = []
        for i, (word, tag) in enumerate(zip(words, tagger.tag(words, tagdict))):
            if word in units:
                self.singularised.append(i)
                word = feature = units[word]
            else:
                feature = "!num" if is_numeric(word) else word
            tag = self._own_tag(word, tag)
            low = feature.lower()
            self.tokens.append(
                Token(
                    i,
                    word,
                    feature,
                    tag,
                    stem(feature),
                    word_shape(feature),
                    "A" <= feature[:1] <= "Z",
                    low in singulars and low not in L.LENGTH_UNITS,
                    feature in L.PUNCTUATION or feature == "--",
                    feature in L.AMBIGUOUS_UNITS,
                )
            )
        texts, features, tags = ([getattr(t, k) for t in self.tokens] for k in ("text", "feat_text", "pos_tag"))
        self.multiple = chunk.multiple_ingredients(texts, tags)
        self.splits = chunk.sentence_splits(texts, features, tags)
        self.examples = chunk.examples(texts, tags)
        self.dimensional = chunk.dimensional(texts, tags)

    def _own_tag(self, word: str, tag: str) -> str:
        low = word.lower()
        if is_numeric(word):
            return "CD"
        if low in ("c", "g"):
            return "NN"
        if low in ("and/or", "or", "and"):
            return "CC"
        if low == "e.g.":
            return "IN"
        if low == "/":
            return "SYM"
        if word == "in" and self.tokens and self.tokens[-1].feat_text == "!num":
            return "NN"
        return tag

    def is_length_unit(self, i: int) -> bool:
        word = self.tokens[i].feat_text
        if word == "in":
            return i > 0 and self.tokens[i - 1].feat_text == "!num"
        return word.lower() in L.LENGTH_UNITS

    def _inside(self) -> list[bool]:
        words = [t.feat_text for t in self.tokens]
        opens = [i for i, w in enumerate(words) if w in ("(", "[")]
        closes = [i for i, w in enumerate(words) if w in (")", "]")]
        pairs = list(zip(opens, closes))
        return [w in ("(", ")", "[", "]") or any(a < i < b for a, b in pairs) for i, w in enumerate(words)]

    def features(self) -> list[dict[str, str | bool]]:
        """For each token a dictionary of features: strings, or flags."""
        n = len(self.tokens)
        inside = self._inside()
        words = [t.feat_text for t in self.tokens]
        comma = next((i for i, w in enumerate(words) if w == ","), n)
        plus = next((i for i, w in enumerate(words) if w == "plus"), n)
        bucket = str(max([1, *(b for b in L.LENGTH_BUCKETS if b <= n)]))
        common = [self._common(i, inside[i], i > comma, i > plus) | self._structure(i) for i in range(n)]
        tags = [t.pos_tag for t in self.tokens]
        out = []
        for i, t in enumerate(self.tokens):
            f: dict[str, str | bool] = {"bias": "", "sentence_length": bucket, "pos": t.pos_tag, "stem": t.stem}
            if t.feat_text != t.stem:
                f["token"] = t.feat_text
            f |= common[i]
            for k in (3, 4, 5):
                if t.feat_text != "!num" and len(t.feat_text) > k:
                    f[f"prefix_{k}"], f[f"suffix_{k}"] = t.feat_text[:k], t.feat_text[-k:]
            for k in (-1, -2, -3, 1, 2, 3):
                j = i + k
                if not 0 <= j < n:
                    continue
                side = ("prev" if k < 0 else "next") + (str(abs(k)) if abs(k) > 1 else "") + "_"
                f[side + "stem"] = self.tokens[j].stem
                f[side + "pos_ngram"] = "+".join(tags[min(i, j) : max(i, j) + 1])
                f[side + "pos"] = tags[j]
                f |= {side + key: value for key, value in common[j].items()}
            out.append(f)
        return out

    def _common(self, i: int, inside: bool, after_comma: bool, after_plus: bool) -> dict[str, str | bool]:
        t = self.tokens[i]
        return {
            "is_capitalised": t.is_capitalised,
            "is_unit": t.is_unit,
            "is_punc": t.is_punc,
            "is_ambiguous": t.is_ambiguous_unit,
            "is_in_parens": inside,
            "is_after_comma": after_comma,
            "is_after_plus": after_plus,
            "word_shape": t.shape,
            "is_length_unit": self.is_length_unit(i),
            "is_dimension": t.feat_text.lower() in L.DIMENSIONS,
        }

    def _structure(self, i: int) -> dict[str, bool]:
        out = {
            "mip_start": any(p[0] == i for p in self.multiple),
            "mip_end": any(p[-1] == i for p in self.multiple),
            "after_sentence_split": any(i >= s for s in self.splits),
            "example_phrase": any(i in p for p in self.examples),
        }
        return out | {"dimensional_phrase": True} if any(i in p for p in self.dimensional) else out


_SINGULARS = set(L.UNITS.values())


def attributes(features: dict[str, str | bool]) -> set[str]:
    """Features as model attributes: ``key:value`` for strings, ``key`` for flags that hold."""
    return {f"{k}:{v}" if isinstance(v, str) else k for k, v in features.items() if v is not False}
