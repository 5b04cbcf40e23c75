"""English stemming by the second Porter algorithm; words of up to two letters stay."""

from __future__ import annotations

import re
from functools import lru_cache

# Words with stems of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
} | {w + e: w for w in ("inning", "outing", "canning", "herring", "earring") for e in ("", "s")} | {
    w + e: w for w in ("proceed", "exceed", "succeed") for e in ("", "s", "ed", "ing")
}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: behind the first non-vowel that follows a vowel, and so again."""
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if head:
        r1 = len(head)
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    word = word.removeprefix("'")
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    for end in ("'s'", "'s", "'"):  # possessives
        if word.endswith(end):
            word = word[: -len(end)]
            break

    if word.endswith("sses"):  # plurals
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]

    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # past and progressive forms
        if not word.endswith(end):
            continue
        base = word[: -len(end)]
        if end in ("eed", "eedly"):
            if len(base) >= r1:
                word = base + "ee"
        elif re.search("[aeiouy]", base):
            word = base
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _SHORT_END.search(word):
                word += "e"
        break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    for end, to in _STEP2:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= r1 and not (end == "ogi" and not base.endswith("l")) and not (end == "li" and (not base or base[-1] not in "cdeghkmnrt")):
                word = base + to
            break
    for end, to in _STEP3:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= (r2 if end == "ative" else r1):
                word = base + to
            break
    for end in _STEP4:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= r2 and not (end == "ion" and not base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
