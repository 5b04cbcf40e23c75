"""Runs over blocks, BM25 with and without order, model files from a folder that Spark reads, composite amounts."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from larder import Options, parse
from larder.operators import ranking as R
from larder.operators import sequences as S
from larder.plans.parse import combine_amounts, describe, inspect
from larder.sources.models import Models


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_runs_whatever_the_blocks(spark, block):
    rng = random.Random(2)
    numbers = [(k, rng.randrange(-40, 60)) for k in "ab" for _ in range(90)] + [(None, 5), (None, 6)]
    want = []
    for k in ("a", "b", None):
        own = sorted({n for j, n in numbers if j == k})
        start = own[0]
        for x, y in zip(own, [*own[1:], None]):
            if y != x + 1:
                want.append((k, start, x, x - start + 1))
                start = y
    df = spark.createDataFrame(numbers, "k string, n int")
    got = [tuple(r) for r in S.consecutive_runs(df, "k", "n", block).select("k", "first", "last", "n").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert S.consecutive_runs(df.limit(0), "k", "n", block).count() == 0


def test_bm25_in_either_order(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, [rng.choice(words) for _ in range(rng.randrange(1, 9))]) for i in range(60)], "doc int, tokens array<string>")
    asked = spark.createDataFrame([(q, [rng.choice(words) for _ in range(4)]) for q in range(8)] + [(9, ["none"]), (10, [])], "query int, tokens array<string>")
    rows = lambda df: sorted((r.query, r.doc, round(r.score, 6), r.first) for r in df.collect())
    plain = rows(R.bm25_scores(asked, R.bm25_index(docs), in_order=True))
    assert plain == rows(R.bm25_scores(asked, R.bm25_index(docs))) == rows(R.bm25_scores(asked, R.bm25_index(docs, asked=asked)))


def test_models_from_a_folder_that_spark_reads(spark, tmp_path):
    files = {
        "model.en.json.gz": {"labels": ["QTY", "B_NAME_TOK"], "state_features": {"stem:!num|QTY": 5, "bias:|B_NAME_TOK": 1}, "transitions": {}, "quantization_scale": 1.0, "quantization_zero_offset": 0.0},
        "averaged_perceptron_tagger_eng.json.gz": {"weights": {"bias": {"XX": 1.0}}, "tagdict": {}, "classes": ["XX"]},
        "ingredient_tagdict.json.gz": {"rye": "YY"},
    }
    for name, data in files.items():
        with gzip.open(tmp_path / name, "wt") as f:
            json.dump(data, f)
    (tmp_path / "other.json.gz").write_bytes(b"not read")
    df = spark.createDataFrame([("3 rye oats",)], "sentence string")
    for models in (Models.load(spark, str(tmp_path)), Models.from_directory(str(tmp_path))):
        (row,) = inspect(df, models=models).collect()
        assert [(t.text, t.pos_tag, t.label) for t in row.labelled] == [("3", "CD", "QTY"), ("rye", "YY", "B_NAME_TOK"), ("oats", "XX", "B_NAME_TOK")]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "nothing.json.gz").write_bytes(b"")
    (row,) = inspect(df, models=Models.load(spark, str(empty))).collect()
    assert row.labelled[0].label == "QTY"
    with pytest.raises(ValueError, match="json.gz"):
        Models(chain_path="model.bin").chain()


def test_composite_amounts_combined(spark):
    df = spark.createDataFrame([(0, "2 lb 8 oz rye"), (1, "3 cups minus 8 tbsp rye"), (2, "2 cups rye")], "id int, sentence string")
    got = {r.id: (r.combined, r.unit) for r in combine_amounts(parse(df)).collect()}
    assert got == {0: (pytest.approx(2.5), "pound"), 1: (pytest.approx(2.5), "cup")}


#: Sentences of our own with the labels that they should get: Q quantity, U unit, S size, N name, P preparation, C comment, F purpose, . punctuation.
LABELLED = [
    ("2 cups rye flour", "QUNN"), ("1 large leek, sliced", "QSN.P"), ("3 tbsp plum jam", "QUNN"), ("250 g smoked eel", "QUNN"), ("1/2 tsp mace", "QUN"),
    ("4 carrots, peeled and diced", "QN.PPP"), ("1 can of sweet corn", "QUCNN"), ("2 oz dark chocolate, chopped", "QUNN.P"), ("6 eggs, beaten", "QN.P"),
    ("1 bunch parsley, roughly chopped", "QUN.PP"), ("salt for serving", "NFF"), ("about 2 cups cider", "CQUN"), ("1 small onion, finely diced", "QSN.PP"),
    ("2 cloves garlic, crushed", "QUN.P"), ("1 pound lean beef", "QUNN"), ("3 cups whole milk", "QUNN"), ("12 walnuts, toasted", "QN.P"), ("1 pinch nutmeg", "QUN"),
    ("5 large figs, halved", "QSN.P"), ("2 quarts fish stock", "QUNN"), ("1 cup barley, rinsed and drained", "QUN.PPP"), ("7 sprigs thyme", "QUN"),
    ("1 tbsp olive oil", "QUNN"), ("2 sticks butter, softened", "QUN.P"), ("1 medium pear (about 200 g)", "QSN.CQU."), ("3 slices rye bread, cubed", "QUNN.P"),
    ("1 lemon, juiced", "QN.P"), ("100 ml cream for the sauce", "QUNFFF"), ("8 ounces goat cheese, crumbled", "QUNN.P"), ("2 cups cold water", "QUNN"),
]
SHORT = {"QTY": "Q", "UNIT": "U", "SIZE": "S", "PREP": "P", "COMMENT": "C", "PURPOSE": "F", "PUNC": "."}


def test_default_labels_on_own_sentences(spark):
    """What the hand-set chain gets right on labelled sentences; README gives the figures."""
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(LABELLED)], "id int, sentence string")
    right = words = whole = 0
    for r in inspect(df, options=Options()).orderBy("id").collect():
        got = "".join(SHORT.get(t.label, "N") for t in r.labelled)
        want = LABELLED[r.id][1]
        assert len(got) == len(want), (r.sentence, got, want)
        right += sum(a == b for a, b in zip(got, want))
        words += len(want)
        whole += got == want
    print(f"words {right}/{words}, sentences {whole}/{len(LABELLED)}")
    assert right / words >= 0.9 and whole / len(LABELLED) >= 0.6


def test_a_row_of_inspect_as_text(spark):
    rows = inspect(spark.createDataFrame([(0, "2 cups rye or oat flour"), (1, None)], "id int, sentence string")).orderBy("id")
    said = [describe(r) for r in rows.collect()]
    assert said[0].split("\n")[:5] == ["sentence: 2 cups rye or oat flour", "normalised: 2 cups rye or oat flour", "tokens:", said[0].split("\n")[3], said[0].split("\n")[4]]
    assert said[0].split("\n")[4].startswith("  1: cup (cup) ") and "multiple: [[2, 3, 4, 5]]" in said[0] and said[1].startswith("sentence: None")
    assert rows.select(F.size("marginals")).first()[0] == 6
