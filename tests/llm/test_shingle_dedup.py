import random

import numpy as np
import pytest

import corpus_pipeline
from larder.llm import shingle_dedup

from .conftest import ODD
from .test_exact import groups


def plain_set(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    return groups(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)


def edited_copies(seed=3):
    """Texts and chains of copies with more and more changed words, on both sides of similarity 0.8."""
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(6):
            if rng.random() < 0.5:
                words = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 60)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts + ["", " ", "a b", "a b", "a c"]


@pytest.mark.parametrize(("small", "chunk"), [(32, 128), (2, 3)])
def test_against_all_pairs(documents, small, chunk):
    texts = edited_copies()
    want = plain_roots(texts)
    assert 30 < len(set(want.values())) < len(texts) - 60
    got = shingle_dedup.near_duplicates(documents(texts), small=small, chunk=chunk).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_pipeline_stage_drops_edited_copies(spark, documents):
    texts = edited_copies()
    want = plain_roots(texts)
    kept = corpus_pipeline.dedup_documents(spark, documents(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in want.items() if i == root)


def test_no_pair_is_lost_between_bands():
    rng = np.random.default_rng(5)
    n, lost = shingle_dedup.bands(0.8), 0
    for _ in range(2000):
        shared, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        both = np.concatenate((shared, own[:10], shared, own[10:]))
        a, b = shingle_dedup._band_keys(both, np.array([0, 90, 180]), n)
        lost += not (a == b).any()
    assert lost == 0


def test_odd_texts(documents):
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(documents(ODD)).collect()}
    assert got == {i: ODD.index(t) if t and t.split() else 0 for i, t in enumerate(ODD)} | {12: 12, 8: 7}
    assert shingle_dedup.near_duplicates(documents(["x"]).limit(0)).count() == 0


def test_pipeline_stage_has_its_simhash_step(spark, documents, monkeypatch):
    """Without any band, what SimHash finds is linked yet, after the exact check; near fingerprints of unlike texts aren't."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1]), "a b", "a c", "a b", " ".join(words) + " " + words[0]]
    monkeypatch.setattr(shingle_dedup, "bands", lambda similarity: 0)
    kept = corpus_pipeline.dedup_documents(spark, documents(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
