"""Cross-parsing against a plain greedy parser, letters of all planes, and the reference sample."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import kernels, language_id


def greedy(known, read):
    i = n = 0
    while i < len(read):
        j = i
        while j < len(read) and read[i : j + 1] in known:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


@pytest.mark.parametrize("block", [3, 8, 512])
def test_phrases_as_a_plain_parser_counts_them(block):
    rng = random.Random(2)
    references = {"a": "".join(rng.choice("abcd é") for _ in range(400)), "zh": "".join(rng.choice("我们今天在市场𠀀𠀁") for _ in range(300))}
    parser = language_id.CrossParser(references, block).unpacked()
    texts = ["".join(rng.choice("abcd é我们今𠀀x😀") for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    read = [r for r in map(language_id.letter_bytes, texts) if r]
    got = parser.phrases(read)
    for k, text in enumerate(references.values()):
        assert got[k].tolist() == [greedy(language_id.letter_bytes(text), r) for r in read]


def test_a_long_text_is_parsed_as_a_whole():
    reference = "the quick brown fox jumps over the lazy dog " * 30
    parser = language_id.CrossParser({"en": reference}).unpacked()
    long = language_id.letter_bytes(reference * 800)
    assert len(long) > 1 << 20
    assert parser.phrases([long, long[:700]])[0].tolist() == [greedy(language_id.letter_bytes(reference), long), 1]


def test_letters_of_all_planes(documents):
    texts = ["😀 🎉 123", "我們在這裡", "𠀀𠀁𠀂", "hello there", "…", None, "", "\U0001d4d0\U0001d4d1"]
    references = {"en": "hello there my friend", "zh": "我們在這裡說話 𠀀𠀁𠀂𠀃"}
    rows = {r.doc_id: r for r in language_id.identify(documents(texts), references=references).collect()}
    assert [rows[i].lang_pred for i in range(7)] == ["und", "zh", "zh", "en", "und", "und", "und"]
    assert rows[7].lang_pred != "und" and rows[0].score == 0


def test_many_letters_all_count(documents):
    ja = [chr(0x4E00 + i) for i in range(600)]
    zh = [chr(0x5E00 + i) for i in range(600)]
    references = {"ja": "".join(ja), "zh": "".join(zh), "en": "plenty of letters here " * 50}
    texts = [a + b for a, b in zip(ja[::7], ja[1::7])] + [a + b for a, b in zip(zh[::7], zh[1::7])]
    rows = {r.doc_id: r.lang_pred for r in language_id.identify(documents(texts), references=references).collect()}
    half = len(texts) // 2
    assert [rows[i] for i in range(len(texts))] == ["ja"] * half + ["zh"] * half


def test_reference_sample_reaches_its_bound(documents):
    texts = ["short one"] * 40 + ["word " * 500] * 3 + [f"text number {i} of many" for i in range(60)]
    docs = documents(texts, ids=[5] * 40 + list(range(100, 103)) + list(range(200, 260)), langs=["de"] * 43 + ["en"] * 60)
    got = language_id.reference_sample(docs, "doc_id", "text", "lang", 400)
    assert len(got["en"]) == 400 and len(got["de"]) in (9, 400)
    everything = language_id.reference_sample(docs, "doc_id", "text", "lang", 10**6)
    assert everything["de"].count("short one") <= 1 and everything["en"].count("text number") == docs.where("lang = 'en' and pmod(crc32(string(doc_id)), 5) != 0").count()


def test_stage_keeps_columns_and_fills_missing_labels(documents):
    docs = documents(["good words here", "good words there", "123", None, "words good"], langs=["en", "en", "en", "en", None]).withColumn("c0", F.lit("x")).withColumn("h", F.lit(1))
    rows = language_id.keep_identified(docs).collect()
    assert {(r.doc_id, r.lang) for r in rows} == {(0, "en"), (1, "en"), (4, "en")} and {(r.c0, r.h) for r in rows} == {("x", 1)}
    assert language_id.keep_identified(docs.limit(0)).count() == 0


def test_a_worker_holds_one_table_and_no_copy():
    rng = random.Random(5)
    parser = language_id.CrossParser({lang: "".join(rng.choice("abcdefghijklm ") for _ in range(6000)) for lang in ("a", "b", "c", "d")})
    tracemalloc.start()
    table = parser.unpacked().table
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.25 * table.nbytes


def test_tables_of_powers_are_as_large_as_the_texts_need(monkeypatch):
    monkeypatch.setattr(kernels, "_powers", (np.ones(1, dtype=np.uint64),) * 2)
    for n, most in ((0, 1 << 17), (5000, 1 << 17), (200_000, 1 << 19)):
        values = np.arange(n, dtype=np.uint64)
        twice = kernels.RangeHash(np.concatenate((values, values)))
        assert n == 0 or twice(np.array([0]), np.array([n])) == twice(np.array([n]), np.array([2 * n]))
        assert len(kernels._powers[0]) <= most
