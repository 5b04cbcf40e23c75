import pytest

from larder.functions import chunk as C
from larder.functions.stem import stem


def both(sentence):
    pairs = [p.rsplit("|", 1) for p in sentence.split()]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def test_multiple_ingredients():
    assert C.multiple_ingredients(*both("2|CD tbsp|NN olive|JJ ,|, vegetable|JJ or|CC sunflower|NN oil|NN")) == [[2, 3, 4, 5, 6, 7]]
    assert C.multiple_ingredients(*both("hot|JJ chicken|NN or|CC beef|NN stock|NN")) == [[0, 1, 2, 3, 4]]
    assert C.multiple_ingredients(*both("salt|NN and|CC pepper|NN")) == []


def test_splits():
    texts, tags = both("1|CD tin|NN or|CC 2|CD cups|NNS beans|NNS")
    assert C.sentence_splits(texts, texts, tags) == [2]
    texts, tags = both("1|CD lemon|NN or|CC half|NN the|DT lime|NN")
    assert C.sentence_splits(texts, texts, tags) == [2]


def test_examples():
    assert C.examples(*both("herbs|NNS such|JJ as|IN thyme|NN")) == [[1, 2, 3]]
    assert C.examples(*both("soft|JJ like|IN brie|NN")) == [[1, 2]]
    assert C.examples(*both("made|VBN with|IN milk|NN")) == []


def test_dimensions():
    assert C.dimensional(*both("1|CD inch|NN (|( 2|CD cm|NN )|) long|JJ piece|NN")) == [[0, 1, 2, 3, 4, 5, 6]]
    assert C.dimensional(*both("2|CD cm|NN /|SYM 1|CD inch|NN thick|JJ")) == [[0, 1, 2, 3, 4, 5]]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("tomatoes", "tomato"), ("berries", "berri"), ("chopped", "chop"), ("slicing", "slice"), ("leaves", "leav"), ("onion", "onion"), ("oz", "oz"),
        ("skies", "sky"), ("generously", "generous"), ("national", "nation"), ("happiness", "happi"), ("hoped", "hope"), ("hopping", "hop"), ("ties", "tie"),
        ("flour's", "flour"), ("baking", "bake"), ("controlling", "control"), ("relational", "relat"), ("Finely", "fine"), ("unsalted", "unsalt"), ("gas", "gas"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want
