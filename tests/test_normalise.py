import random

import pytest
from pyspark.sql import functions as F

from larder.functions import normalise as N
from larder.functions import tokenise as T
from larder.functions.features import is_numeric, word_shape
from larder.functions.words import tokenise

#: Sentences of our own: each rule's case, beside words of our own, and what the rule's definition makes of it.
SENTENCES = [
    ("&frac14; jar quince jelly (cold)", "#1$4 jar quince jelly (cold)"),
    ("&#x2154; jar &amp; lid", "#2$3 jar & lid"),
    ("7 2/3 dried figs", "7#2$3 dried figs"),
    ("nine plums", "nine plums"),
    ("fist-size lump of dough", "fist-size lump of dough"),
    ("6 jars relish – mild or fiery", "6 jars relish - mild or fiery"),
    ("kale—torn", "kale - torn"),
    ("7–9 parsnips", "7-9 parsnips"),
    ("4&frac34; cups damson pulp", "4#3$4 cups damson pulp"),
    ("5 1/8 kg swede", "5#1$8 kg swede"),
    ("3 and 3/4 tsp mace", "3#3$4 tsp mace"),
    ("⅔ cup oat bran", "#2$3 cup oat bran"),
    ("6⅛ cups broth", "6#1$8 cups broth"),
    ("⅛-¼ teaspoon", "#1$8-#1$4 teaspoon"),
    ("250ml buttermilk", "250 ml buttermilk"),
    ("4-ounce trout, boned", "4 ounce trout, boned"),
    ("3kg20g beets", "3 kg 20 g beets"),
    ("3lb-5oz beets", "3 lb - 5 oz beets"),
    ("2 tbsp. carob", "2 tbsp carob"),
    ("2 Tsps. carob, 3 oz. rye", "2 Tsps carob, 3 oz rye"),
    ("4 to 7 ripe pears", "4-7 ripe pears"),
    ("2 or 3 leeks", "2-3 leeks"),
    ("90 g - 120 g smoked eel", "90-120 g smoked eel"),
    ("90 g - 120 kg smoked eel", "90 g - 120 kg smoked eel"),
    ("6 x 90 g crab claws", "6x 90 g crab claws"),
    ("⅓ - ⅔ cup cider, and more", "#1$3-#2$3 cup cider, and more"),
    ("11 - 12 radishes", "11-12 radishes"),
    ("3 cups sorrel ($0.75*)", "3 cups sorrel"),
    ("3 cups sorrel (€ 4.10)", "3 cups sorrel"),
    ("2 kg 70/30 lamb", "2 kg 70/30 lamb"),
    ("three-pound brisket", "three pound brisket"),
    ("3⁄4 gill", "#3$4 gill"),
    ("  rye  ", "rye"),
    ("", ""),
    (None, None),
]
TOKENS = [
    ("3 gills plum brandy", ["3", "gills", "plum", "brandy"]),
    ("9 ounce [250 g] tin", ["9", "ounce", "[", "250", "g", "]", "tin"]),
    ('4" stick cassia, bruised', ['4"', "stick", "cassia", ",", "bruised"]),
    ("duck and / or goose fat", ["duck", "and/or", "goose", "fat"]),
    ("duck and/or goose fat", ["duck", "and/or", "goose", "fat"]),
    ("spice, i.e. mace.", ["spice", ",", "i.e.", "mace", "."]),
    ("#3$8 jug whey", ["#3$8", "jug", "whey"]),
    ("capers* ~ 9", ["capers", "*", "~", "9"]),
    ("dill; fennel: anise?", ["dill", ";", "fennel", ":", "anise", "?"]),
]
NUMBERS = ["7", "3.25", "9x", "#3$8", "5#1$8-6#7$8", "eleven", "6-seven", "dozen", "three-quarter", "000"], ["00", "y", "7-y", "jug", "--", ""]


def test_normalise(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "id int, sentence string")
    got = [r.normalised for r in N.add_normalised(df).orderBy("id").collect()]
    assert got == [want for _, want in SENTENCES]


def test_python_form_equals_the_column_form(spark):
    rng = random.Random(3)
    pieces = ["2", "1/2", "½", "3.5", " ", " ", "-", "–", "—", "to", "or", "and", "g", "cups", "lb", "oz.", "tsp.", "x", "&frac12;", "&amp;", "⅓", "⁄", "80/20", "three", "Six", "pound", "\u00a0", "\u3000", "($2.50*)", "(", ")", "rye", "10 g", "12 gram", "٣", "\t", "4 kg", "0.5", "#1$2"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + [s for s, _ in SENTENCES if s is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")
    got = [r.normalised for r in N.add_normalised(df).orderBy("id").collect()]
    assert [(t, N.normalise_text(t)) for t in texts] == list(zip(texts, got))


def test_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(TOKENS)], "id int, s string")
    got = [r.t for r in df.select("id", T.tokens(F.col("s")).alias("t")).orderBy("id").collect()]
    assert got == [want for _, want in TOKENS]
    assert [tokenise(s) for s, _ in TOKENS] == got


def test_numbers(spark):
    words = [(w, True) for w in NUMBERS[0]] + [(w, False) for w in NUMBERS[1]]
    df = spark.createDataFrame(words, "w string, want boolean")
    assert df.where(T.is_numeric(F.col("w")) != F.col("want")).count() == 0
    assert all(is_numeric(w) == want for w, want in words)


@pytest.mark.parametrize(("word", "shape"), [("Crème", "Xxxxx"), ("Œuf7", "Œxxd"), ("30kg", "ddxx"), ("?abc", "?xxx")])
def test_shape(spark, word, shape):
    assert word_shape(word) == shape
    assert spark.range(1).select(T.word_shape(F.lit(word))).first()[0] == shape


def test_brackets_pair_in_order(spark):
    texts = F.array(*[F.lit(t) for t in ["a", "(", "b", ")", "c", ")"]])
    got = spark.range(6).select(T.inside_parentheses(texts, F.col("id").cast("int")).alias("x")).collect()
    assert [r.x for r in got] == [False, True, True, True, False, True]


def test_buckets_and_affixes(spark):
    n = spark.createDataFrame([(1,), (2,), (9,), (70,)], "n int")
    assert [r[0] for r in n.select(T.length_bucket(F.col("n"))).collect()] == [1, 2, 8, 64]
    a = spark.range(1).select(T.affixes(F.lit("figgy"))).first()[0]
    assert [(x["size"], x["prefix"], x["suffix"]) for x in a] == [(3, "fig", "ggy"), (4, "figg", "iggy")]
