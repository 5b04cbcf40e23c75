"""Linear-chain labelling with integer-quantised weights: constrained best path and marginals."""

from __future__ import annotations

import numpy as np

NAMES = ("B_NAME_TOK", "I_NAME_TOK", "NAME_VAR", "NAME_MOD", "NAME_SEP")


class Chain:
    """Weights of a trained model: attribute by label, label by label, and the quantisation of both."""

    def __init__(self, labels: list[str], state: dict[tuple[str, str], int], transitions: dict[tuple[str, str], int], scale: float = 1.0, zero: float = 0.0):
        self.labels = labels
        self.number = {label: i for i, label in enumerate(labels)}
        self.attributes = {a: i for i, a in enumerate(dict.fromkeys(a for a, _ in state))}
        self.emission = np.zeros((len(self.attributes) + 1, len(labels)))
        for (attribute, label), weight in state.items():
            self.emission[self.attributes[attribute], self.number[label]] = weight
        self.transition = np.zeros((len(labels), len(labels)))
        for (before, after), weight in transitions.items():
            self.transition[self.number[before], self.number[after]] = weight
        self.scale, self.zero = np.float32(scale), np.float32(zero)
        self.real_transition = self._real(self.transition)

    @classmethod
    def from_json(cls, model: dict) -> Chain:
        """Keys of weights are ``attribute|label`` and ``before|after``, split at the first bar."""
        split = lambda table: {tuple(k.split("|", 1)): w for k, w in table.items()}
        return cls(list(model["labels"]), split(model["state_features"]), split(model["transitions"]), model["quantization_scale"], model["quantization_zero_offset"])

    def _real(self, scores: np.ndarray) -> np.ndarray:
        return (scores.astype(np.float32) - self.zero) / self.scale

    def scores(self, sequence: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sequence), len(self.labels)))
        for t, found in enumerate(sequence):
            rows = [self.attributes[a] for a in found if a in self.attributes]
            if rows:
                out[t] = self.emission[rows].sum(axis=0)
        return out

    def best_path(self, scores: np.ndarray, constrained: bool = True) -> list[int]:
        """The best labels; no name goes on that didn't begin since the start or the last separator. Of equals the first."""
        n, k = scores.shape
        if not n:
            return []
        begin, inside, separator = (self.number.get(x) for x in ("B_NAME_TOK", "I_NAME_TOK", "NAME_SEP"))
        constrained = constrained and None not in (begin, inside)
        lattice = scores[0].copy()
        open_name = np.zeros(k, dtype=bool)
        if constrained:
            lattice[inside] = -np.inf
            open_name[begin] = True
        back = np.zeros((n, k), dtype=np.int64)
        every = np.arange(k)
        for t in range(1, n):
            paths = lattice[:, None] + self.transition + scores[t][None, :]
            if constrained:
                paths[~open_name, inside] = -np.inf
            back[t] = paths.argmax(axis=0)
            lattice = paths[back[t], every]
            if constrained:
                open_name = open_name[back[t]]
                open_name[begin] = True
                if separator is not None:
                    open_name[separator] = False
        out = [int(lattice.argmax())]
        for t in range(n - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """P(label) at each place; sums run over labels in order, in double precision."""
        n, k = scores.shape
        if not n:
            return np.zeros((0, k))
        state = self._real(scores)
        trans = self.real_transition
        forward = np.empty((n, k))
        forward[0] = state[0]
        for t in range(1, n):
            forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + trans.astype(np.float64), axis=0) + state[t]
        backward = np.zeros((n, k))
        for t in range(n - 2, -1, -1):
            step = (trans + state[t + 1][None, :]).astype(np.float64)
            backward[t] = np.logaddexp.reduce(step + backward[t + 1][None, :], axis=1)
        return np.exp(forward + backward - np.logaddexp.reduce(forward[-1]))

    def label(self, sequence: list[set[str]], constrained: bool = True) -> tuple[list[str], list[float], np.ndarray]:
        scores = self.scores(sequence)
        path, marginals = self.best_path(scores, constrained), self.marginals(scores)
        return [self.labels[i] for i in path], [float(marginals[t, i]) for t, i in enumerate(path)], marginals


def guess_name(labels: list[str], scores: list[float], marginal, least: float = 0.2) -> tuple[list[str], list[float]]:
    """Names for sentences without one: the longest run of tokens whose likeliest name label passes ``least``.

    ``marginal(label, place)`` gives a probability.
    """
    found = {}
    for i in range(len(labels)):
        best = max(NAMES, key=lambda name: marginal(name, i))
        if marginal(best, i) > least:
            found[i] = best
    labels, scores = list(labels), list(scores)
    longest: list[int] = []
    for run in runs(list(found)):
        if len(run) > len(longest):
            longest = run
    for i in longest:
        labels[i], scores[i] = found[i], marginal(found[i], i)
    return labels, scores


def runs(places: list[int]) -> list[list[int]]:
    """Neighbouring places together."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][-1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


_PREPARED = "chop slice dice minc grate peel crush shred beat melt soften drain rins trim halv quarter cube divid toast pack sift separ core seed pit devein cut thaw torn juic zest mash fine rough coars thin".split()
_LABELS = ["QTY", "UNIT", "SIZE", "PREP", "COMMENT", "PURPOSE", "PUNC", "B_NAME_TOK", "I_NAME_TOK", "NAME_VAR", "NAME_MOD", "NAME_SEP"]


def default_chain() -> Chain:
    """A small chain of hand-set weights, for use without a trained model: quantities, units and sizes by lexicon, one
    name before the first comma or bracket, preparation by stems, and the rest comment."""
    from .lexicon import SIZES

    state: dict[tuple[str, str], int] = {("bias:", label): -200 for label in ("PURPOSE", "NAME_VAR", "NAME_MOD", "NAME_SEP")}
    state |= {
        ("bias:", "B_NAME_TOK"): 60,
        ("bias:", "I_NAME_TOK"): 60,
        ("stem:!num", "QTY"): 900,
        ("is_unit", "UNIT"): 420,
        ("is_ambiguous", "UNIT"): -150,
        ("prev_stem:!num", "UNIT"): 20,
        ("is_punc", "PUNC"): 900,
        ("is_after_comma", "COMMENT"): 120,
        ("is_after_comma", "PREP"): 90,
        ("is_after_comma", "B_NAME_TOK"): -120,
        ("is_after_comma", "I_NAME_TOK"): -120,
        ("is_in_parens", "COMMENT"): 260,
        ("is_in_parens", "UNIT"): 60,
        ("pos:VBN", "PREP"): 120,
        ("pos:RB", "PREP"): 80,
        ("pos:IN", "COMMENT"): 140,
        ("pos:TO", "COMMENT"): 140,
        ("pos:DT", "COMMENT"): 120,
        ("pos:PRP", "COMMENT"): 160,
        ("pos:CC", "COMMENT"): 60,
        ("token:for", "PURPOSE"): 420,
        ("stem:for", "PURPOSE"): 420,
        ("stem:of", "COMMENT"): 300,
        ("token:mince", "PREP"): -320,
        ("stem:about", "COMMENT"): 400,
        ("stem:approxim", "COMMENT"): 400,
        ("stem:each", "COMMENT"): 400,
        ("stem:plus", "COMMENT"): 400,
        ("stem:minus", "COMMENT"): 400,
    }
    state |= {(f"stem:{s}", "PREP"): 320 for s in _PREPARED}
    state |= {(f"stem:{s}", "SIZE"): 420 for s in SIZES}
    transitions = {
        ("B_NAME_TOK", "I_NAME_TOK"): 150,
        ("I_NAME_TOK", "I_NAME_TOK"): 150,
        ("B_NAME_TOK", "B_NAME_TOK"): -300,
        ("I_NAME_TOK", "B_NAME_TOK"): -300,
        ("COMMENT", "COMMENT"): 120,
        ("PREP", "PREP"): 150,
        ("PURPOSE", "PURPOSE"): 500,
        ("QTY", "UNIT"): 30,
    }
    return Chain(_LABELS, state, transitions, 100.0, 0.0)
