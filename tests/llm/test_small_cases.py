"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larder.llm import decontaminate, language_id, line_dedup, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts

from .conftest import ODD

EMPTY = hashlib.sha256(b"").hexdigest()


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def items(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (None, "a"), (3, ""), (3, "")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1)], "doc_id bigint, quality int")


OPERATORS = {
    "op1": lambda s, d: decontaminate.benchmark_hits(d, items(s)),
    "op2": lambda s, d: token_counts.token_counts(d, tokenizer()),
    "op3": lambda s, d: language_id.identify(d),
    "op4": lambda s, d: line_dedup.dedup_lines(d),
    "op5": lambda s, d: suffix_dedup.suffix_dedup(d),
    "op6": lambda s, d: substring_dedup.substring_dedup(d),
    "op7": lambda s, d: simhash.near_duplicates(d),
    "op8": lambda s, d: quality_rules.quality_rules(d),
    "op9": lambda s, d: quality_classifier.score_quality(d, labels(s)),
    "op10": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, documents, name):
    odd = documents(ODD, sources=[None if i % 3 else "s" for i in range(len(ODD))], langs=[None if i % 2 else "en" for i in range(len(ODD))])
    clash = odd.withColumns({c: F.lit("x") for c in ("key", "fp", "spans", "size", "h", "n", "anchor", "features", "held_out", "taken", "block", "label")})
    got = OPERATORS[name](spark, clash).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(ODD)))
    again = OPERATORS[name](spark, clash.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, documents, name):
    assert OPERATORS[name](spark, documents(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_and_repeated_ids(spark, documents, name):
    texts = ["one two three four five six"] * 2 + ["", None, "other words here"]
    got = OPERATORS[name](spark, documents(texts, ids=[7, 7, None, None, 8])).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) == [(False, 7), (False, 7), (False, 8)]
    assert sum(r.doc_id is None for r in got) == 2


def test_all_null_texts(spark, documents):
    df = documents([None, None, None])
    assert {r.lang_pred for r in language_id.identify(df).collect()} == {"und"}
    assert {(r.n_bytes, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()} == {(0, EMPTY)}
    assert {(r.n_words, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()} == {(0, EMPTY)}
    assert {(r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()} == {("0" * 16, 0)}
    assert {(r.size, r.target, r.taken) for r in mixing.mix(df).collect()} == {(0, 0.0, 0)}
    assert {r.score for r in quality_classifier.score_quality(df, labels(spark).limit(0)).collect()} == {0.5}


def test_items_without_words_and_empty_benchmark(spark, documents):
    df = documents(["one two three", "x"])
    none = items(spark).limit(0)
    assert {r.n_hit for r in decontaminate.benchmark_hits(df, none).collect()} == {0}
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(df, items(spark)).collect()}
    assert got[0].n_hit == 3 and got[0]["items"] == ["1"] and got[1].n_hit == 0
