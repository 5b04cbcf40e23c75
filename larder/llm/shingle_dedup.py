"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash bands, exact check, connected groups.

Candidates come from two sides.  SimHash fingerprints of the shingles that differ in at most ``simhash.BITS`` bits meet by Golay keys, as in
``simhash``; a pair of the least similarity is rarely that near, so MinHash bands find the rest.

Texts of equal shingle sets are one node from the start.  A band's key is made of ``ROWS`` minima
of the set under hashes of their own; there are so many bands that a pair of exactly the least
similarity shares none with a chance of ``MISS`` at most (more similar pairs, less).  Candidates are
verified by their whole shingle sets, so that no pair below the least similarity is linked.

Each bucket's members are first compared with its smallest.  A bucket whose members that leaves
in several groups is compared pair by pair: up to ``SMALL`` members at once, a larger one in
cells of two chunks of about ``CHUNK`` members, where members of one group aren't compared.

Defined results: words are cut at ASCII blanks, in ASCII lower case; fewer words than a shingle make
one shingle; null and wordless texts have equal (empty) sets; repeated rows are nodes of the same
set; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sieve, simhash
from .components import components, join_back
from .storage import cut

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
MISS = 1e-6
SMALL = 32
CHUNK = 128


def bands(similarity: float) -> int:
    """The number of bands by which a pair of ``similarity`` is missed with a chance of ``MISS`` at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def shingles(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and the number of hashes before each row."""
    low = K.LOWER[buf]
    starts, ends, first = K.find_words(low, offsets, ~K.SPACE)
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(0, dtype=K.U64), np.zeros(len(offsets), dtype=np.int64)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    last = np.minimum(at + shingle, np.repeat(first[1:], n))
    hashes = K.RangeHash(K.RangeHash(K.BYTE_VALUE[low])(starts, ends))(at, last)
    hashes = hashes[np.lexsort((hashes, row))]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(counts)))))


def _set_hashes(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    out = np.zeros(len(before) - 1, dtype=K.U64)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        out[some] = K.mix(np.add.reduceat(K.mix(hashes), before[some]))
    return out


def _band_keys(hashes: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """``n`` keys for each row that has shingles."""
    starts = before[:-1][np.diff(before) > 0]
    seeds = K.mix(np.arange(1, 2 * n * ROWS + 1, dtype=K.U64))
    keys = np.empty((len(starts), n), dtype=K.U64)
    for k in range(n):
        key = np.full(len(starts), k, dtype=K.U64)
        for j in range(k * ROWS, (k + 1) * ROWS):
            key = K.mix(key + np.minimum.reduceat((hashes ^ seeds[2 * j]) * (seeds[2 * j + 1] | K.U64(1)), starts))
        keys[:, k] = key
    return keys


def _sketches(docs: DataFrame, shingle: int, n: int) -> DataFrame:
    """(doc_id, h, fp, keys) for each document: its shingle set's hash, its SimHash fingerprint and its bands' keys."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes, before = shingles(*K.string_buffer(part.column(1)), shingle)
            ends = np.concatenate(([0], np.cumsum((np.diff(before) > 0) * n))).astype(np.int32)
            keys = _band_keys(hashes, before, n).ravel() if len(hashes) else hashes
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
            prints = simhash.text_prints(part.column(1), shingle)
            made = [pa.array(_set_hashes(hashes, before).view(np.int64)), pa.array(prints.view(np.int64)), lists]
            return pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "h", "fp", "keys"])

        return work

    return K.map_slices(docs, ["doc_id", "text"], "text", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint, keys array<bigint>", make)


def _near_prints(sketched: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: sets of one fingerprint beside its smallest, and the smallest of fingerprints that link."""
    sets = cut(sketched.select("fp", "h").distinct())
    least = cut(sets.groupBy("fp").agg(F.min("h").alias("least")))
    equal = sets.join(least, "fp").where("h != least").select(F.col("h").alias("a"), F.col("least").alias("b"))
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"h{side}"))
    linked = simhash.links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    return equal.unionByName(linked).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _texts(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(h, text) of the sets in ``wanted``; a bitmap keeps most others out of the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve.bitmap(wanted, "h", wanted.count()))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            h = _set_hashes(*shingles(*K.string_buffer(part.column(0)), shingle))
            both = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0)], ["h", "text"])
            return both.filter(pa.array(sieve.passes(sent.value, h)))

        return work

    found = K.map_slices(docs, ["text"], "text", "h bigint, text string", make)
    return found.join(wanted, "h", "left_semi").groupBy("h").agg(F.max("text").alias("text"))


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    out = []
    for part in K.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
        hashes, before = shingles(*K.string_buffer(part.column(0)), shingle)
        out += np.split(hashes, before[1:-1])
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (small + large - shared) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b")

    @K.tidied
    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "ta"):
                ok = [similar(x, y, similarity) for x, y in zip(_sets(part.column(2), shingle), _sets(part.column(3), shingle))]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _cells(members: DataFrame, texts: DataFrame, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """Links inside large buckets (key, h, root, n), cell by cell."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "h", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "h", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(texts, "h")

    def link(table: pa.Table) -> pa.Table:
        h, sets = table["h"].to_pylist(), _sets(table["text"].combine_chunks(), shingle)
        group = table["root"].to_numpy().copy()
        a, b = [], []
        for x in range(len(h)):
            for y in range(x + 1, len(h)):
                if group[x] != group[y] and similar(sets[x], sets[y], similarity):
                    group[group == group[y]] = group[x]
                    a.append(h[x])
                    b.append(h[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = SMALL, chunk: int = CHUNK
) -> DataFrame:
    """One row (doc_id, component_id) for each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(_sketches(docs, shingle, bands(similarity)))
    found = sketched.select("doc_id", "h")
    distinct = found.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    keyed = sketched.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most").drop("most")
    met = cut(keyed.join(shared, "key").distinct())
    by_prints = cut(_near_prints(sketched).distinct())
    wanted = cut(met.select("h").unionByName(by_prints.select(F.col("a").alias("h"))).unionByName(by_prints.select(F.col("b").alias("h"))).distinct())
    texts = cut(_texts(docs, wanted, shingle))
    by_bands = met.where("h != least").select(F.col("h").alias("a"), F.col("least").alias("b"))
    links = cut(_verified(by_prints.unionByName(by_bands).distinct(), texts, shingle, similarity))

    # What the comparison with the smallest leaves in several groups of a bucket.
    rooted = met.join(components(links).withColumnRenamed("node", "h"), "h", "left").select("key", "h", "least", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("who"))
    mixed = mixed.where("lo < hi and n > 2").groupBy("who", "n").agg(F.min("key").alias("key")).select("key", "n")  # buckets of the same members: one
    left = cut(rooted.join(mixed, "key"))
    few = left.where(F.col("n") <= small).groupBy("key", "least").agg(F.array_sort(F.collect_list(F.struct("h", "root"))).alias("m"))
    pair = f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {small}), y -> x.root != y.root and x.h != least), y -> named_struct('a', x.h, 'b', y.h))))"
    pairs = few.select(F.explode(F.expr(pair)).alias("p")).select("p.a", "p.b").distinct()
    more = _verified(pairs, texts, shingle, similarity).unionByName(_cells(left.where(F.col("n") > small).select("key", "h", "root", "n"), texts, shingle, similarity, chunk))

    roots = components(links.unionByName(more))
    member = cut(distinct.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "first", "n", F.coalesce("root", "h").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("sets")))
    of = cut(join_back(member, least, "root", "sets").select("h", "n", "component_id"))
    return join_back(found, of, "h", "n").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of the documents whose id is the smallest of their group.  Rows that share a kept id are one document and all stay."""
    place = docs.columns.index(id_col)
    groups = near_duplicates(docs, id_col, text_col, **options)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.join(stays, F.col(f"c{place}").eqNullSafe(F.col("stays")), "left_semi").toDF(*docs.columns)
