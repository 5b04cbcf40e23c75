import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions.chain import NAMES, Chain, default_chain, guess_name
from larder.functions.tagger import PerceptronTagger, normalise_word

LABELS = ["QTY", "B_NAME_TOK", "I_NAME_TOK", "NAME_SEP"]


def allowed(path):
    open_ = False
    for i, label in enumerate(path):
        if label == "I_NAME_TOK" and (i == 0 or not open_):
            return False
        open_ = label == "B_NAME_TOK" or (open_ and label != "NAME_SEP")
    return True


weights = st.lists(st.integers(-40, 40), min_size=4 * 5 + 16, max_size=4 * 5 + 16)


@settings(max_examples=40, deadline=None)
@given(weights, st.integers(1, 5))
def test_best_path_and_marginals_against_all_paths(numbers, n):
    state = {(f"w{t}", label): numbers[t * 4 + k] for t in range(5) for k, label in enumerate(LABELS)}
    trans = {(a, b): numbers[20 + i * 4 + j] for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)}
    chain = Chain(LABELS, state, trans, 10.0, 0.0)
    sequence = [{f"w{t}"} for t in range(n)]

    def total(path):
        return sum(state[f"w{t}", x] for t, x in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product(LABELS, repeat=n))
    labels, scores, marginals = chain.label(sequence)
    best = max(total(p) for p in paths if allowed(p))
    # Only one path is kept for each label and place, so a constrained path can miss the best one; it is never better.
    assert allowed(labels) and total(labels) <= best
    free, _, _ = chain.label(sequence, constrained=False)
    assert total(free) == max(map(total, paths))
    mass = np.array([np.exp(total(p) / 10) for p in paths])
    for t in range(n):
        for k, label in enumerate(LABELS):
            want = mass[[p[t] == label for p in paths]].sum() / mass.sum()
            assert marginals[t, k] == pytest.approx(want, abs=1e-4)
    assert scores == [pytest.approx(marginals[t, LABELS.index(x)]) for t, x in enumerate(labels)]


def test_json_splits_at_the_first_bar():
    model = {"labels": ["A", "B"], "state_features": {"x|A": 3, "y|B": 2}, "transitions": {"A|B": 1}, "quantization_scale": 2.0, "quantization_zero_offset": 0}
    chain = Chain.from_json(json.loads(json.dumps(model)))
    assert chain.label([{"x"}, {"y"}])[0] == ["A", "B"]


def test_empty_sequence():
    assert default_chain().label([])[:2] == ([], [])


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([[0.1] * 5, [0.1] * 5], ["COMMENT", "COMMENT"]),
        ([[0.3, 0.1, 0.1, 0.1, 0.1], [0.1, 0.5, 0, 0, 0]], ["B_NAME_TOK", "I_NAME_TOK"]),
        ([[0.3, 0.3, 0, 0, 0], [0.1] * 5], ["B_NAME_TOK", "COMMENT"]),
        ([[0.9, 0, 0, 0, 0], [0.1] * 5, [0.3, 0, 0, 0, 0], [0.3, 0, 0, 0, 0]], ["COMMENT", "COMMENT", "B_NAME_TOK", "B_NAME_TOK"]),
    ],
)
def test_guessed_names(rows, want):
    labels, _ = guess_name(["COMMENT"] * len(rows), [1.0] * len(rows), lambda name, i: rows[i][NAMES.index(name)])
    assert labels == want


def test_perceptron():
    assert [normalise_word(w) for w in ["all-purpose", "1999", "12oz", "Salt", "-x"]] == ["!HYPHEN", "!YEAR", "!DIGITS", "salt", "-x"]
    tagger = PerceptronTagger({"i word salt": {"NN": 1.0, "JJ": 1.0}, "i-1 tag NN": {"CC": 2.0}}, {"and": "CC"}, ["CC", "JJ", "NN"])
    assert tagger.tag(["salt", "x", "and"], {"x": "FW"}) == ["NN", "FW", "CC"]  # of equals the last by name
    assert tagger.tag(["salt", "salt"]) == ["NN", "CC"]
