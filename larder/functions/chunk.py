"""Phrases by patterns over tag sequences.

Tags are written one behind the other as ``<TAG>``; a stage's pattern finds stretches of them, left to right, and each
becomes one chunk whose label the next stage sees as a tag.
"""

from __future__ import annotations

import re
from functools import cache

from . import lexicon as L

# The grammars, stage by stage.
MULTIPLE = (
    ("EMIP", "<NN.*|JJ.*>+<,><NN.*|JJ.*>+<,>?<CC><DT|NN.*|JJ.*>*<NN.*>"),
    ("MIP", "<NN.*|JJ.*>+<CC><DT|NN.*|JJ.*>*<NN.*>"),
)
COMPOUND = (
    ("CS_WU", "<CC><RB>?<CD|DT>+<RB>?<UNIT|SIZE>+"),
    ("CS_NU", "<CC><CD|DT>+<NN.*|JJ.*>"),
    ("CS_HALF", "<CC><HALF>"),
)
EXAMPLE = (
    ("NP", "(<NN.*|JJ.*>+<,>?)*<CC|DT>?<NN.*|JJ.*>*<NN.*>"),
    ("EX", "<JJ.*>?<IN><NP>"),
)
DIMENSIONAL = (
    ("LENGTH", "<CD><LEN>"),
    ("PLENGTH", r"<\(><LENGTH><\)>"),
    ("SLENGTH", "<SYM><LENGTH>"),
    ("DP", "<LENGTH><SLENGTH|PLENGTH>?<IN>?<DIM>*"),
)

_UNITS = frozenset(L.UNIT_WORDS)
_UNITS_AND_SIZES = _UNITS | set(L.SIZES)


@cache
def _compiled(pattern: str) -> re.Pattern:
    inner = re.sub(r"<((?:\\.|[^<>\\])*)>", lambda m: "(?:<(?:" + re.sub(r"(?<!\\)\.", "[^<>]", m[1]) + ")>)", pattern)
    return re.compile(inner)


def chunks(tags: list[str], grammar: tuple[tuple[str, str], ...]) -> list[tuple[str, range]]:
    """Top-level chunks of the last form of the sentence: label and token numbers."""
    parts: list[tuple[str, range, bool]] = [(t, range(i, i + 1), False) for i, t in enumerate(tags)]
    for label, pattern in grammar:
        text = "".join(f"<{t}>" for t, _, _ in parts)
        starts, at = {}, 0
        for n, (t, _, _) in enumerate(parts):
            starts[at] = n
            at += len(t) + 2
        starts[at] = len(parts)
        made, done = [], 0
        for m in _compiled(pattern).finditer(text):
            if m.start() == m.end():
                continue
            a, b = starts[m.start()], starts[m.end()]
            made += parts[done:a]
            made.append((label, range(parts[a][1].start, parts[b - 1][1].stop), True))
            done = b
        parts = made + parts[done:]
    return [(t, r) for t, r, chunk in parts if chunk]


def _not_or(texts: list[str], tags: list[str], r: range) -> bool:
    return next((texts[i].lower() != "or" for i in r if tags[i] == "CC"), False)


def multiple_ingredients(texts: list[str], tags: list[str]) -> list[list[int]]:
    """Phrases such as ``butter or olive oil``, without leading units and sizes."""
    out = []
    for _, r in chunks(tags, MULTIPLE):
        if _not_or(texts, tags, r):
            continue
        phrase = list(r)
        while phrase and texts[phrase[0]].lower() in _UNITS_AND_SIZES:
            phrase.pop(0)
        if phrase and tags[phrase[0]] != "CC":
            out.append(phrase)
    return out


def sentence_splits(texts: list[str], feature_texts: list[str], tags: list[str]) -> list[int]:
    """Where another ingredient begins within the sentence."""

    def own(text: str, tag: str) -> str:
        low = text.lower()
        return "UNIT" if low in _UNITS else "SIZE" if low in L.SIZES else "HALF" if low == "half" else tag

    tags = [own(t, g) for t, g in zip(texts, tags)]
    return [r.start for label, r in chunks(tags, COMPOUND) if label.startswith("CS_") and not _not_or(feature_texts, tags, r)]


def examples(texts: list[str], tags: list[str]) -> list[list[int]]:
    """Phrases that begin with ``such as``, ``as``, ``like`` or ``e.g.``"""
    out = []
    for label, r in chunks(tags, EXAMPLE):
        if label != "EX":
            continue
        words = [(texts[i].upper(), tags[i]) for i in r]
        opens = lambda w: w[1] == "IN" and w[0] in ("AS", "LIKE", "E.G.")
        if words[:2] == [("SUCH", "JJ"), ("AS", "IN")] or opens(words[0]):
            out.append(list(r))
        elif words[0][1] == "JJ" and opens(words[1]):
            out.append(list(r)[1:])
    return out


def dimensional(texts: list[str], tags: list[str]) -> list[list[int]]:
    """Lengths, with what follows in brackets or behind a slash, and their dimensions."""

    def own(text: str, tag: str) -> str:
        low = text.lower()
        return "LEN" if low in L.LENGTH_UNITS and tag != "IN" else "DIM" if low in L.DIMENSIONS else tag

    return [list(r) for label, r in chunks([own(t, g) for t, g in zip(texts, tags)], DIMENSIONAL) if label == "DP"]
