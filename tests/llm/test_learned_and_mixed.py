"""Held-out accuracy of the learned operators, the mixture's properties, queries against SQL, and the pipeline."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import language_id, mixing, quality_classifier, queries, shingle_dedup

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 1000 and right / n > 0.98


@tables
def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    bad, good = got.score[got.quality == 0].to_numpy(), got.score[got.quality == 1].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_chain_marginals_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    chain = quality_classifier.LineChain(rng.normal(size=quality_classifier.N_FEATURES), rng.normal(size=(2, 2)))
    features = rng.integers(0, quality_classifier.N_FEATURES, (9, 4))
    before = np.array([0, 4, 5, 9])
    got = chain.marginals(features, before)
    emit = chain.weights[features].sum(axis=1)
    for a, b in zip(before, before[1:]):
        mass = np.zeros(b - a)
        total = 0.0
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(emit[a + t] * y for t, y in enumerate(path)) + sum(chain.links[i, j] for i, j in zip(path, path[1:])))
            total += w
            mass += w * np.array(path)
        assert got[a:b] == pytest.approx(mass / total)


def test_gradient_against_differences():
    """The climb follows the conditional likelihood: its gradient, by marginals and expected transitions, is that of finite differences."""
    rng = np.random.default_rng(4)
    Chain, n = quality_classifier.LineChain, quality_classifier.N_FEATURES
    features, before, labels = rng.integers(0, n, (12, 3)), np.array([0, 5, 6, 12]), np.array([1, 0, 1])
    weights, links = rng.normal(size=n) * 0.3, rng.normal(size=(2, 2)) * 0.3
    line_label = np.repeat(labels, np.diff(before))

    def likelihood(w, k):
        total = 0.0
        emit = w[features].sum(axis=1)
        for a, b in zip(before, before[1:]):
            forward = np.array([0.0, emit[a]])
            for t in range(a + 1, b):
                forward = np.array([np.logaddexp(forward[0] + k[0, y], forward[1] + k[1, y]) + emit[t] * y for y in (0, 1)])
            path = line_label[a:b]
            total += (emit[a:b] * path).sum() + sum(k[i, j] for i, j in zip(path, path[1:])) - np.logaddexp(*forward)
        return total

    chain = Chain(weights, links)
    good = chain.marginals(features, before)
    by_weight = np.bincount(features.ravel(), weights=np.repeat(line_label - good, 3), minlength=n)
    by_link = chain.pairs(features, before, line_label.astype(float)) - chain.pairs(features, before, good)
    step = 1e-5
    for i in np.unique(features)[:12]:
        d = np.zeros(n)
        d[i] = step
        assert by_weight[i] == pytest.approx((likelihood(weights + d, links) - likelihood(weights - d, links)) / (2 * step), abs=1e-5)
    for i, j in np.ndindex(2, 2):
        d = np.zeros((2, 2))
        d[i, j] = step
        assert by_link[i, j] == pytest.approx((likelihood(weights, links + d) - likelihood(weights, links - d)) / (2 * step), abs=1e-5)


def test_scores_against_a_plain_version(spark, documents):
    """A document's score is the length-weighted mean of its lines' marginals, whatever slice it came in."""
    rng = np.random.default_rng(5)
    chain = quality_classifier.LineChain(rng.normal(size=quality_classifier.N_FEATURES) * 0.4, rng.normal(size=(2, 2)))
    texts = ["One line here.", "", None, "A b\n\nC D! 12 %%\nlast line, with words", "same\nsame\nsame", "x " * 3000 + "\n" + "long tail"]
    rows = sorted(quality_classifier.score_quality(documents(texts), None, chain=chain).collect(), key=lambda r: r.doc_id)
    for r, text in zip(rows, texts):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        features, weight, before = quality_classifier.line_features(data, np.array([0, len(data)]))
        lines = [x for x in (text or "").split("\n") if x.split()]
        assert list(weight) == ([len(x.encode()) for x in lines] or [1])
        good = chain.marginals(features, before)
        assert r.score == pytest.approx(float((good * weight).sum() / weight.sum())) and r.predicted == (r.score >= 0.3)


def test_training_texts_are_whole_within_the_bound(spark, documents):
    docs = documents(["line of words\n" * 50, "other words\n" * 8, "third text", "third text"], ids=[1, 2, 3, 3])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    usable = {r.doc_id for r in docs.where("pmod(crc32(string(doc_id)), 5) != 0").select("doc_id").distinct().collect()}
    lines = {1: 50, 2: 8, 3: 1}
    _, before, marks = quality_classifier.training_sample(docs, labels, "doc_id", "text", "quality", 3000, 300_000)
    assert sorted(np.diff(before)) == sorted(lines[d] for d in usable) and len(marks) == len(usable)
    _, before, _ = quality_classifier.training_sample(docs, labels, "doc_id", "text", "quality", 3000, 20)
    assert sorted(np.diff(before)) == sorted(lines[d] for d in usable if d != 1)


def test_mixture(spark, documents):
    texts = ["w " * k for k in range(1, 61)]
    sources = [["a", "b", None, "ü"][i % 4] if i < 40 else "a" for i in range(60)]
    rows = mixing.mix(documents(texts, sources=sources)).collect()
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, r.source_size, r.target])
        s[0] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert list(sorted(by, key=lambda s: (s is None, s or ""))) == ["a", "b", "ü", None]
    for taken, size, target in by.values():
        assert taken == round(target) and target <= 2 * size
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(s for _, s, _ in by.values()))
    again = mixing.mix(documents(texts, sources=sources).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("nulls", [False, True])
def test_query_against_sql(spark, tmp_path, name, nulls):
    folder = DATA
    if nulls:  # items without an id or text, documents without a text or source
        folder = str(tmp_path)
        for table, column in (("documents", "source"), ("benchmark", "item_id")):
            df = spark.read.parquet(f"{DATA}/{table}.parquet").limit(60)
            key = F.crc32(F.col("text"))
            odd = df.withColumn(column, F.when(key % 3 == 0, None).otherwise(F.col(column))).withColumn("text", F.when(key % 7 == 1, None).otherwise(F.col("text")))
            odd.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = queries.QUERIES[name](spark, folder)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as from '{folder}/{t}.parquet{'/*.parquet' if nulls else ''}'")
    want = db.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    order = lambda names: sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: round(float(v), 5) if isinstance(v, float) else v
    rows = lambda names, values: sorted(repr([clean(r[i]) for i in order(names)]) for r in values)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.QUERIES[name](spark, DATA).count() == n


@tables
def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(10_000 + i, t, "en", "src0", 1) for i, t in enumerate([None, "", "12 34 !!", "???"])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "language_id":
            assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {10_000, 10_001, 10_002, 10_003}
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(docs).collect()}
            assert {r.doc_id for r in kept.collect()} == {d for d, c in groups.items() if d == c}
        assert 0 < kept.count() <= docs.count()
        docs = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    sums = docs.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(r.t == round(r.g) for r in sums)


CLASH = ("__gone", "gone", "removed_from", "__words", "__spots", "__items", "__stays", "stays", "c0", "c1", "h", "fp", "key", "size", "taken", "block", "carried", "row", "spans", "n")


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_tables(spark, documents, tmp_path, number):
    """Clashing columns, null and repeated ids, null, empty and long texts, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[number]
    item = " ".join(f"question{i}" for i in range(15))
    spark.createDataFrame([("i", item), (None, "other " * 14), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"some{i % 977} words{i % 1009}" for i in range(60_000))
    texts = ["a good line of words here\nsecond line", None, "", "one two three four five", "one two three four five", long, f"start {item} end " + "filler words here " * 200]
    docs = documents(texts, ids=[7, 7, None, 3, 4, None, 5]).withColumns({c: F.lit("x") for c in CLASH})
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    last = number == len(corpus_pipeline.STAGES) - 1
    if last:
        assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"] and {r.text for r in rows} <= set(texts)
    else:
        assert out.columns == docs.columns and all(r[c] == "x" for r in rows for c in CLASH)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    want = {
        "language_id": [(False, 3), (False, 4), (False, 5), (False, 7), (True, 0)],
        "line_dedup": [(False, 3), (False, 5), (False, 7), (False, 7), (True, 0), (True, 0)],
        "simhash_near_dedup": [(False, 3), (False, 5), (False, 7), (False, 7), (True, 0), (True, 0)],
        "benchmark_decontamination": [(False, 3), (False, 4), (False, 5), (False, 7), (False, 7), (True, 0), (True, 0)],
        "mixing": None,
    }[name]
    assert last or ids == want, (name, ids)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@tables
def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
