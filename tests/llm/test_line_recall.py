import random

from larder.llm import line_dedup


def test_equal_lines_go_however_short(documents):
    chinese = "我们今天在市场上买了许多新鲜的蔬菜和水果然后回家做饭"
    texts = [f"Read more\n{chinese}\nYes!\n---\n\n", f"read MORE.\nyes\n{chinese}\n---\n\nno", "你好\nno\n你好"]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(documents(texts)).collect()}
    assert got == {0: texts[0], 1: "---\n\nno", 2: "你好"}


def test_minimum_in_characters_is_for_the_fuzzy_step_only(documents):
    near = ["one two three four", "one two three foud", "one two three four five", "one two three foud five"]
    assert [r.n_removed for r in line_dedup.dedup_lines(documents(near)).orderBy("doc_id").collect()] == [0, 0, 0, 1]


def edited(rng, line, kind, rate):
    if kind == "letter":
        k = rng.randrange(len(line))
        return line[:k] + rng.choice("xyz") + line[k + 1 :]
    words = line.split()
    if kind == "letters":
        return "".join(rng.choice(["", c + "x", "y"]) if rng.random() < rate else c for c in line)
    if kind == "words":
        return " ".join("".join(rng.choice("abcdefghij") for _ in w) if rng.random() < rate else w for w in words)
    return " ".join(w for w in words if rng.random() >= rate)


def test_recall_against_plain_edit_similarity(documents):
    """Lines of 3 to 80 words beside an edited copy: whoever is similar enough by edit distance alone is to be found."""
    rng = random.Random(8)
    found, wanted = {}, {}
    for kind, rate in (("letter", 0), ("letters", 0.03), ("words", 0.08), ("drop", 0.08)):
        for n in (3, 5, 8, 12, 20, 40, 80):
            pairs = []
            while len(pairs) < 60:
                line = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 10))) for _ in range(n))
                other = " ".join(edited(rng, line, kind, rate).split())
                if len(line) >= 20 and len(other) >= 20 and line != other and line_dedup.similar(line, other):
                    pairs.append((line, other))
                elif kind in ("words", "drop") and n < 5:
                    break
            texts = [t for p in pairs for t in p]
            wanted[kind, n] = len(pairs)
            found[kind, n] = texts
    flat = [(key, t) for key, texts in found.items() for t in texts]
    rows = line_dedup.dedup_lines(documents([t for _, t in flat])).collect()
    got = dict.fromkeys(wanted, 0)
    for r in rows:
        got[flat[r.doc_id][0]] += r.n_removed
    share = {key: got[key] / n for key, n in wanted.items() if n}
    assert sum(got.values()) >= 0.95 * sum(wanted.values())
    assert min(share.values()) >= 0.8, share
    assert all(share["letter", n] >= 0.9 for n in (3, 5, 8, 12, 20, 40, 80)), share


def test_walk_over_buckets_is_the_same_however_rows_are_cut():
    import numpy as np

    rng = np.random.default_rng(3)
    key, h = np.sort(rng.integers(0, 12, 60)), rng.integers(0, 6, 60)
    fp = h * 0
    plain = {}
    for k, x in zip(key.tolist(), h.tolist()):
        plain.setdefault(k, set()).add(x)
    want = {(k, x) for k, s in plain.items() if len(s) > 1 for x in s}
    for size in (1, 2, 7, 60):
        walk, out = line_dedup._Buckets(), []
        for i in range(0, 60, size):
            b = walk.take(key[i : i + size], h[i : i + size], fp[i : i + size])
            out += zip(b["key"].to_pylist(), b["h"].to_pylist(), b["centre"].to_pylist())
        assert {(k, x) for k, x, _ in out} == want and len(out) <= len(want) + 60 // size
        assert all(len({c for k, _, c in out if k == key}) == 1 for key in {k for k, _, _ in out})
    far = np.array([0, 1 << 40, 0, 0])  # bucket 1 holds two lines that aren't near: it goes, unless a batch cuts it
    b = line_dedup._Buckets().take(np.array([1, 1, 2, 2]), np.array([5, 6, 7, 8]), np.where(far > 0, -1 << line_dedup.LENGTH_BITS, 0))
    assert set(b["key"].to_pylist()) == {2}


def test_crowded_buckets_and_pairs_give_the_same_groups(documents):
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base.replace(f"word{i} ", f"other{i} ") for i in range(1, 38)] + ["something else that stands by itself " * 2]
    for options in ({}, {"small": 4}):
        rows = line_dedup.dedup_lines(documents(texts), **options).collect()
        assert {r.doc_id for r in rows if not r.n_removed} == {0, 37}


def test_many_pairs_as_one_by_one():
    rng = random.Random(1)
    pairs = []
    for _ in range(4000):
        a = "".join(rng.choice("abcdé") for _ in range(rng.choice([0, 1, 5, 20, 63, 64, 65, 100, 130, 200, 300])))
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 2 + 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = rng.choice(["", "x", "ab"])
        pairs.append((a, "".join(b)))
    for least in (0.95, 0.8, 0.5, 0.2):
        want = [line_dedup.edit_distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9 for a, b in pairs]
        assert line_dedup.similar_pairs(pairs, least).tolist() == want


def test_the_quick_answer_is_never_wrong():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = rng.choice(["", "x", "ab"])
        limit = rng.randrange(12)
        assert line_dedup.edit_distance(a, "".join(b)) <= limit or not line_dedup.within(a, "".join(b), limit)


def test_hot_keys_join_back_the_same(spark, monkeypatch):
    from larder.llm import components

    rows = spark.createDataFrame([(k % 7 if k < 500 else 99, k) for k in range(2000)] + [(-1, 0)], "key bigint, x bigint")
    few = rows.where("key > 0").groupBy("key").count()
    want = sorted((r.key, r.x, r["count"]) for r in rows.join(few, "key").collect())
    for most in (components.FEW, 3):
        monkeypatch.setattr(components, "FEW", most)
        monkeypatch.setattr(components, "HOT", 4)
        got = components.join_back(rows, few, "key", "count", keep=True).collect()
        assert sorted((r.key, r.x, r["count"]) for r in got) == want
        assert components.join_back(rows, few.limit(0), "key", "count").count() == 0


def test_a_crowd_loses_no_candidate(documents):
    """Lines that share a passage, each with a copy edited as much as the similarity allows: every near pair of the crowd is compared."""
    import numpy as np

    from .test_exact import groups

    rng = random.Random(4)
    said = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 10))) for _ in range(n))
    passage, texts = said(9), []
    for _ in range(150):
        own = said(7).split()
        texts.append(f"{passage} {' '.join(own)}")
        for k in rng.sample(range(7), 3):
            own[k] = said(1)
        texts.append(f"{passage} {' '.join(own)}")
    flat = "".join(texts).encode()
    x = line_dedup.Lines(np.frombuffer(flat, dtype=np.uint8), np.cumsum([0, *map(len, texts)]), 1)
    sketches = x.sketches(np.arange(len(texts)), x.chars())
    both = set()
    for line, fp, keys in sketches:  # candidates: a shared key, and lengths and bits that allow the similarity
        for n, i in enumerate(line.tolist()):
            met = (keys == keys[n]).any(axis=1) & line_dedup.near(fp.view(np.int64), fp.view(np.int64)[n : n + 1])
            both |= {(i, j) for j in line[met].tolist()}
    want = groups(list(range(len(texts))), lambda a, b: (a, b) in both and line_dedup.similar(texts[a], texts[b]))
    assert 100 < len(set(want.values())) < len(texts) - 40
    for options in ({}, {"small": 2, "chunk": 40}):
        rows = line_dedup.dedup_lines(documents(texts), **options).collect()
        assert {r.doc_id for r in rows if not r.n_removed} == set(want.values())


def test_pairs_beyond_their_limits_are_given_up_early():
    rng = random.Random(6)
    said = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    assert line_dedup.edit_distance(said(4000), "xyz" * 1300, 100) < 300
    pairs = []
    for n in (30, 70, 130, 300, 700):
        for _ in range(120):  # half of them share a passage at their beginning, end or middle; many are just within or beyond their limits
            a, b = said(n), list(said(n))
            lo = rng.choice([0, 0, n // 5, n // 2])
            b[lo : lo + rng.choice([n, n * 4 // 5, n // 2, 0])] = a[lo : lo + rng.choice([n, n * 4 // 5, n // 2])]
            pairs.append((a, "".join(b)))
    far = [line_dedup.edit_distance(a, b) for a, b in pairs]
    limits = [(1 - 0.8) * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    for (a, b), d, limit in zip(pairs, far, limits):
        got = line_dedup.edit_distance(a, b, limit)
        assert got == d if d <= limit else got > limit
    for plain in (True, False):
        assert line_dedup.similar_pairs(pairs, plain=plain).tolist() == [d <= limit for d, limit in zip(far, limits)]
    assert 50 < sum(d <= limit for d, limit in zip(far, limits)) < 550


def test_keys_of_blocks_stay_whole_and_none_is_lost():
    """Entries dealt out in blocks come back as they were: each key in one piece, in files where a block is too large, a very frequent key too."""
    import numpy as np

    rng = np.random.default_rng(5)
    h, fp = rng.integers(-(1 << 63), 1 << 63, (2, 300), dtype=np.int64)
    keys = rng.integers(0, 1 << 64, (300, 4), dtype=np.uint64) >> np.uint64(1) << np.uint64(1)
    keys[:120, 0] = keys[0, 0]  # a key that many lines have, between others of its block
    keys[120:180, 1] = keys[0, 0] + np.arange(60, dtype=np.uint64)
    entries = line_dedup._entries(line_dedup._packed(h, fp, keys), 4)
    want = sorted((k, a, b) for row, a, b in zip(keys.view(np.int64).tolist(), h.tolist(), fp.tolist()) for k in row)
    assert sorted(map(tuple, entries.tolist())) == want
    rows = []
    for part in (entries[:500], entries[500:]):
        made = line_dedup._blocks(part)
        rows += [(b, np.frombuffer(x, dtype=np.int64).reshape(-1, 3)) for b, x in zip(made["block"].to_pylist(), made["entries"].to_pylist())]
    rows.sort(key=lambda x: x[0])
    for enough, most in ((1, 10), (1, 100), (50, 1000), (1 << 20, 1 << 20)):
        pieces = list(line_dedup._whole(iter(rows), enough, most))
        assert sorted(tuple(x) for p in pieces for x in p.tolist()) == want
        for key in {k for k, _, _ in want}:
            at = [i for i, p in enumerate(pieces) if (p[:, 0] == key).any()]
            assert at == list(range(at[0], at[-1] + 1))  # the walk goes on with a key in the next piece only
        walk = line_dedup._Buckets()
        met = [b for p in pieces for b in walk.take(*p.T)["key"].to_pylist()]
        assert met.count(int(keys.view(np.int64)[0, 0])) >= 120


def test_keys_are_dealt_out_many_in_a_row(documents):
    """A row for each key of each line took most of the time of meeting."""
    texts = [f"line {i} has words of its own, {i * i} and {i * 7} of them" for i in range(4000)]
    read = line_dedup.lines(documents(texts)).where("sketches is not null").select("bands", "sketches")
    n = sum((len(r.sketches) // 8 // (2 + r.bands)) * r.bands for r in read.collect())
    dealt = line_dedup._dealt(read).collect()
    assert n >= 4000 * 10 and sum(len(r.entries) for r in dealt) == 24 * n and len(dealt) <= n / 2
