"""Part-of-speech tags: an averaged perceptron for given weights, and rules where there are none."""

from __future__ import annotations

from . import lexicon as L

_BEFORE, _AFTER = ["-START-", "-START2-"], ["-END-", "-END2-"]


def normalise_word(word: str) -> str:
    if "-" in word and word[0] != "-":
        return "!HYPHEN"
    if len(word) == 4 and word.isdecimal():
        return "!YEAR"
    return "!DIGITS" if word[:1].isdecimal() else word.lower()


class PerceptronTagger:
    """Tags left to right; each word's tag is looked up or is the class of greatest weight, of equals the last by name."""

    def __init__(self, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: list[str]):
        self.weights, self.tagdict, self.classes = weights, tagdict, sorted(classes)

    def tag(self, words: list[str], more: dict[str, str] | None = None) -> list[str]:
        context = _BEFORE + [normalise_word(w) for w in words] + _AFTER
        last, last2, out = *_BEFORE, []
        for i, word in enumerate(words):
            tag = (more or {}).get(word) or self.tagdict.get(word) or self._best(self._features(context, i + 2, word, last, last2))
            out.append(tag)
            last, last2 = tag, last
        return out

    @staticmethod
    def _features(near: list[str], i: int, word: str, last: str, last2: str) -> list[str]:
        return [
            "bias",
            f"i suffix {word[-3:]}",
            f"i pref1 {word[:1]}",
            f"i-1 tag {last}",
            f"i-2 tag {last2}",
            f"i tag+i-2 tag {last} {last2}",
            f"i word {near[i]}",
            f"i-1 tag+i word {last} {near[i]}",
            f"i-1 word {near[i - 1]}",
            f"i-1 suffix {near[i - 1][-3:]}",
            f"i-2 word {near[i - 2]}",
            f"i+1 word {near[i + 1]}",
            f"i+1 suffix {near[i + 1][-3:]}",
            f"i+2 word {near[i + 2]}",
        ]

    def _best(self, features: list[str]) -> str:
        scores = dict.fromkeys(self.classes, 0.0)
        for f in features:
            for label, weight in self.weights.get(f, {}).items():
                scores[label] = scores.get(label, 0.0) + weight
        return max(self.classes, key=lambda c: (scores[c], c))


_CLOSED = {
    "DT": "a an the this that these those each every all both any some no another",
    "CC": "and or but nor plus &",
    "IN": "of in on for with without from at by into as like per about over under until if such-as e.g. than",
    "TO": "to",
    "RB": "very finely roughly coarsely thinly thickly lightly freshly well then not too also approximately about nearly just only more preferably optionally if-needed",
    "PRP": "you it they i we",
    "PRP$": "your its their our",
    "MD": "can will should may might",
    "JJ": "fresh large small medium big little dry dried raw ripe hot cold warm cool ground extra lean low-fat unsalted salted sweet sour white black red green yellow brown whole "
    "light dark thick thin long short boneless skinless plain optional frozen canned cooked soft hard heavy virgin such other additional good-quality organic baby",
    "VB": "taste serve make yield use cut taste",
    "VBN": "chopped sliced diced minced grated peeled crushed shredded beaten melted softened drained rinsed trimmed halved quartered cubed divided toasted roasted packed sifted separated "
    "cored seeded pitted deveined cut thawed torn juiced zested mashed",
}
_LEXICON = {w: tag for tag, words in _CLOSED.items() for w in words.split()}
_SUFFIXES = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBN"), ("ous", "JJ"), ("ful", "JJ"), ("less", "JJ"), ("ish", "JJ"), ("able", "JJ"), ("ss", "NN"), ("us", "NN"))


class RuleTagger:
    """Tags by a small lexicon and endings: what a sentence gets where no weights are given."""

    def tag(self, words: list[str], more: dict[str, str] | None = None) -> list[str]:
        return [(more or {}).get(w) or self._tag(w) for w in words]

    @staticmethod
    def _tag(word: str) -> str:
        low = word.lower()
        if word in (",", "(", ")", ".", ":"):
            return word
        if word in (";", "--", "-"):
            return ":"
        if word in ("[", "]", "{", "}"):
            return "(" if word in "[{" else ")"
        if low[:1].isdecimal() or low.startswith("#"):
            return "CD"
        if low in _LEXICON:
            return _LEXICON[low]
        if low in L.UNITS and L.UNITS[low] != low:
            return "NNS"
        for end, tag in _SUFFIXES:
            if low.endswith(end) and len(low) > len(end) + 2:
                return tag
        if not any(c.isalpha() for c in word):
            return "SYM"
        return "NNS" if low.endswith("s") else "NN"
