"""Operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from larder.llm import decontaminate, golay, line_dedup, repeats, simhash, substring_dedup, suffix_dedup, token_counts
from larder.llm.automaton import SuffixAutomaton
from larder.llm.components import components
from larder.llm.suffix_sort import suffix_array


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60)))
        s = x.tolist()
        assert suffix_array(x).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_automaton_knows_every_substring():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        a = SuffixAutomaton(sequences)
        known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        query = [rng.randrange(3) for _ in range(15)]
        for i, (_, n) in enumerate(a.matching(query), 1):
            assert n == max((k for k in range(i + 1) if tuple(query[i - k : i]) in known), default=0)


def texts_with_repeats(seed, n=60):
    """Texts that share passages, with near and exact copies among them."""
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "δέλτα", "eps", "zeta", "ETA", "th"]
    say = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(k))
    passages = [say(45), say(60), say(25)]
    out = []
    for _ in range(n):
        parts = [say(rng.randrange(30)) for _ in range(2)]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3)
            parts.insert(1, p[cut : len(p) - rng.randrange(len(p) // 3)])
        out.append(" ".join(parts))
    out += [out[3], out[3] + " end", out[5][:-4], out[7], "ab" * 90, "ab" * 140, None, ""]
    return out


def removed_bytes(texts, window):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                mask[s : s + window] = True
            seen.add(w)
        out.append((len(raw), int(mask.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest()))
    return out


@pytest.mark.parametrize("window", [100, 40])
@pytest.mark.parametrize("many", [2048, 2])
def test_suffix_dedup(documents, monkeypatch, window, many):
    monkeypatch.setattr(repeats, "MANY", many)
    texts = texts_with_repeats(1)
    got = sorted(suffix_dedup.suffix_dedup(documents(texts).repartition(5), window=window).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.kept_sha256) for r in got] == removed_bytes(texts, window)


def removed_words(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 12])
@pytest.mark.parametrize("many", [2048, 2])
def test_substring_dedup(documents, monkeypatch, window, many):
    monkeypatch.setattr(repeats, "MANY", many)
    texts = texts_with_repeats(2) + ["again and " * 40]
    got = sorted(substring_dedup.substring_dedup(documents(texts).repartition(5), window=window).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == removed_words(texts, window)


def test_many_copies_and_forgetful_tasks(documents, monkeypatch):
    texts = texts_with_repeats(4, 12) * 6
    want_bytes, want_words = removed_bytes(texts, 100), removed_words(texts, 35)
    for remembered in (300_000, 1):
        monkeypatch.setattr(repeats, "REMEMBERED", remembered)
        got = sorted(suffix_dedup.suffix_dedup(documents(texts).coalesce(2)).collect(), key=lambda r: r.doc_id)
        assert [(r.n_bytes, r.n_removed, r.kept_sha256) for r in got] == want_bytes
        got = sorted(substring_dedup.substring_dedup(documents(texts).coalesce(2)).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == want_words


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_decontaminate(spark, documents, shard_bytes):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, say(k)) for i, k in enumerate([20, 13, 14, 3, 1, 5])] + [(9, None), (None, say(16)), (None, say(2)), (7, say(13)), (7, say(30))]
    texts = [say(40) for _ in range(20)] + [say(10) + " " + items[0][1].upper() + ", " + say(60), items[7][1], None, "", "w0-w1 W2"]
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(documents(texts), spark.createDataFrame(items, "item_id bigint, text string"), shard_bytes=shard_bytes).collect()}
    for d, t in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        hit, found = set(), set()
        for name, item in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
            n = min(13, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(name if name is None else str(name))
        assert (got[d].n_words, got[d].n_hit) == (len(own), len(hit))
        assert got[d]["items"] == sorted(found - {None}) + [None] * (None in found)
        assert sum(s.hi - s.lo for s in got[d].spans) == len(hit)


def test_cutting_and_dropping(spark, documents):
    item = " ".join(f"q{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = documents([f"Before, {filler} {item}. After", f"x {item}", "clean text stays\nas it is"])
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert out == {0: f"Before, {filler} . After", 2: "clean text stays\nas it is"}


def test_golay_indices_are_shared_within_two_bits():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 60)
    index, n = golay.indices(words)
    assert set(n.tolist()) <= {1, 6}
    for a, word in enumerate(words.tolist()):
        own = set(index[a, : n[a]].tolist())
        near = np.array([word ^ (1 << i) ^ (1 << j) for i in range(23) for j in range(23)])
        other, m = golay.indices(near)
        assert all(own & set(o[:k].tolist()) for o, k in zip(other, m))


@pytest.mark.parametrize("bits", [1, 2])
def test_links_connect_what_is_near(spark, bits):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    prints = {int(b) for b in base}
    for b in base[:6].tolist():  # crowded neighbourhoods
        for _ in range(60):
            x = np.uint64(b & (1 << 64) - 1)
            for p in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                x ^= np.uint64(1 << p)
            prints.add(int(np.array([x]).view(np.int64)[0]))
    values = np.array(sorted(prints))
    df = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    for small in (32, 2):
        found = simhash.links(df, bits, small).collect()
        bit_count = lambda a, b: int(np.bitwise_count(np.int64(a) ^ np.int64(b)).item()) if a ^ b >= 0 else 64 - bin(~(a ^ b)).count("1")
        assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= bits for r in found)
        roots = {r.node: r.root for r in components(simhash.links(df, bits, small)).collect()}
        assert groups(values.tolist(), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= bits) == {v: roots.get(v, v) for v in values.tolist()}
        del bit_count


def groups(values, near):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {v: find(v) for v in values}


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(1, n)} | {501: 500}


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


@pytest.mark.parametrize("small", [32, 4])
def test_line_groups(spark, documents, small):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    lines = []
    for _ in range(150):
        line = rng.choice(base)
        if rng.random() < 0.5:
            k = rng.randrange(len(line))
            line = line[:k] + rng.choice("xyz") + line[k + 1 :]
        lines.append(line.capitalize() + ".")
    texts = ["\n".join(lines[i : i + 5]) + "\nshort line" for i in range(0, 150, 5)]
    docs = documents(texts).select("doc_id", "text")
    gone = {(r.doc_id, r.line) for r in line_dedup.line_groups(docs, small=small).collect()}
    norm = {(d, n): " ".join(re.findall("[a-z0-9]+", line.lower())) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))}
    root = groups(sorted(norm), lambda a, b: norm[a] == norm[b] or line_dedup.similar(norm[a], norm[b]))
    assert gone == {k for k in norm if root[k] != k} and 20 < len(gone) < 175


PIECES = ["hello", "World!", "don't", "it's", "naïve", "été", "日本語", "a b", "<|endoftext|>", "x<|endoftext|>y", "12345", " ", "\x1c", "...", "ΣΑΣ", "😀👍", "#$%&", "\t", "\r\n", "İ", "ﬁ", "e\u0301", "\u0301"]


def odd_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    return texts + [" ".join(rng.choice(PIECES) for _ in range(4000)), "".join(rng.choice("abcdef'") for _ in range(3000)), None]


def test_token_counts_as_the_library_counts(documents):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = token_counts.load_tokenizer(path)
    texts = odd_texts()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((1 << 15, 256), (300, 8)):
        got = sorted(token_counts.token_counts(documents(texts), path, chunk=chunk, overlap=overlap).collect(), key=lambda r: r.doc_id)
        assert [r.n_tokens for r in got] == want
    encoder = token_counts.TokenCounter(path, chunk=200, overlap=8).chunked
    for t in texts[-3:-1]:
        e = library.encode(t, add_special_tokens=False)
        assert encoder.tokens(t) == (e.ids, [o[0] for o in e.offsets])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(documents, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    counter = token_counts.TokenCounter(path, chunk=100, overlap=8)
    assert counter.chunked is None
    texts = [t or "" for t in odd_texts()]
    if name.endswith(".json"):
        want = [len(e) for e in token_counts.load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert counter.counts(texts) == want


def test_a_text_of_a_million_characters(documents):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    text = " ".join(rng.choice(PIECES) for _ in range(250_000))
    assert len(text) > 1 << 20
    want = len(token_counts.load_tokenizer(path).encode(text, add_special_tokens=False).ids)
    assert [r.n_tokens for r in token_counts.token_counts(documents([text]), path).collect()] == [want]


def test_fingerprints_and_components_against_a_plain_version(documents):
    import xxhash

    rng = random.Random(12)
    vocabulary = [f"Wörd{i}" if i % 9 == 0 else f"Word{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 30, 200, 900]))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:40]:
        for _ in range(3):
            copy = list(w)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("\t".join(copy) + rng.choice(["", " ", "\n"]))
    texts += [None, "", " \n", texts[0], texts[0].upper().replace("Ö", "ö")]

    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for t in texts]
    root = groups(list(range(len(texts))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = sorted(simhash.near_duplicates(documents(texts)).collect(), key=lambda r: r.doc_id)
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == [root[i] for i in range(len(texts))]
    assert len(set(root.values())) < len(set(prints))


@pytest.mark.parametrize("operator", ["op5", "op6"])
def test_crowded_anchors_are_compared_the_same_either_way(operator, monkeypatch):
    """Many different contents around one anchor: by the method itself, and by the hashes of windows that take over beyond MANY contents."""
    rng = random.Random(7)
    if operator == "op5":
        kind = suffix_dedup.kind()
        middle, letters = bytes(rng.choices(b"abc ", k=60)), b"ab "
        texts = [bytes(rng.choices(letters, k=70)) for _ in range(12)]
        made = [rng.choice(texts)[-rng.randrange(20, 70) :] + middle + rng.choice(texts)[: rng.randrange(20, 70)] for _ in range(150)]
        spot = [m.index(middle) for m in made]
    else:
        kind = substring_dedup.kind()
        middle = " ".join(f"m{i}" for i in range(16)).encode()
        texts = [[rng.choice(["a", "b"]).encode() for _ in range(30)] for _ in range(8)]
        made = [b" ".join(rng.choice(texts)[-rng.randrange(8, 30) :] + [middle] + rng.choice(texts)[: rng.randrange(12, 30)]) for _ in range(150)]
        spot = [m.split().index(b"m0") for m in made]
    contents = []
    for n, (m, at) in enumerate(zip(made, spot)):
        data = np.frombuffer(m, dtype=np.uint8)
        contents.append(repeats.Content(kind.units(data, np.array([0, len(data)]))[0], at, (True, n, 0), n))
    found = []
    for many in (repeats.MANY, 2):
        monkeypatch.setattr(repeats, "MANY", many)
        got = repeats._compare_groups([contents], kind)
        # only windows around the anchor are this anchor's business; others meet elsewhere
        found.append({n: sorted({(a, b) for a, b in spans if a <= contents[n].at and b >= contents[n].at + kind.gram}) for n, spans in got.items()})
    clean = [{n: s for n, s in f.items() if s} for f in found]
    assert clean[0] == clean[1] and len(clean[0]) > 50


@pytest.mark.parametrize("operator", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_a_text_over_a_megabyte_repeats_itself(documents, operator):
    rng = random.Random(2)
    half = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80_000))
    texts = [half + " between " + half, "unrelated words of its own " + half[:5000]]
    assert len(texts[0]) > 1 << 20
    rows = {r.doc_id: r for r in operator(documents(texts)).collect()}
    if operator is suffix_dedup.suffix_dedup:
        lead = len(half) + len(" between ")
        first = set(half[:99]) and rows[0].n_removed
        assert len(half) <= first <= len(half) + 1 and rows[0].n_spans == 1 and rows[1].n_removed >= 5000 and lead
    else:
        assert rows[0].n_removed == 160_000 and rows[1].n_removed in (len(half[:5000].split()), len(half[:5000].split()) - 1)
