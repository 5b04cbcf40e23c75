"""The tokeniser for texts that are in Python already, such as descriptions of a small table."""

from __future__ import annotations

import re

_PUNCTUATION = re.compile(r"([()\[\]{},/:;?!*~])")
_FULL_STOP = re.compile(r"(?<!\.\w)\.$")


def tokenise(sentence: str) -> list[str]:
    words = " ".join(_PUNCTUATION.sub(r" \1 ", sentence).split())
    words = re.sub(r"(?<!\S)and / or(?!\S)", "and/or", words)
    return [p for w in words.split() for p in ((_FULL_STOP.sub("", w), ".") if _FULL_STOP.search(w) else (w,)) if p]
