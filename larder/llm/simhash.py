"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints are taken once; documents of equal fingerprint are one node from then on.
Each distinct fingerprint gets keys from its segments (see ``golay``): keys that meet
give candidates, which are verified by their differing bits.  A bucket of up to
``small`` fingerprints is verified pair by pair.  A larger one is not paired: each of
its fingerprints is put down under itself and under each of the 64 words one bit away; two
fingerprints differ in at most two bits exactly if they meet under such a word, and a link from each to the smallest one there keeps them
connected.  So no bucket costs more than in proportion to its size.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; shingles count as often as they
occur; repeated rows are nodes of the same fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from . import kernels as K
from .components import components, join_back
from .storage import cut

BITS = 2
SMALL_BUCKET = 32
SEED = 42


def _fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    import xxhash

    low = K.LOWER[buf]
    starts, ends, first = K.find_words(low, offsets, ~K.SPACE)
    counts = np.diff(first)
    # All words of the slice, joined by one space, so that a shingle is one stretch of bytes.
    raw = low.tobytes()
    joined = b" ".join(raw.split())
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    end = begin + lengths
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    total = int(n.sum())
    doc_start = np.cumsum(n) - n
    at = np.arange(total) - np.repeat(doc_start, n) + np.repeat(first[:-1], n)
    last = np.minimum(at + shingle - 1, np.repeat(first[1:] - 1, n))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[s:e], seed) for s, e in zip(begin[at].tolist(), end[last].tolist())), dtype=np.uint64, count=total)
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        ones = K.bit_sums(hashes, doc_start[some], n[some])
        packed = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little")
        out[some] = packed.view("<u8").ravel()
    return out


def _checked_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A copy of the texts with a blank behind each, so that no word runs from one text into the next."""
    n = len(offsets) - 1
    out = np.full(len(buf) + n, 0x20, dtype=np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offsets))] = buf
    return out, offsets + np.arange(n + 1)


def text_prints(texts: pa.Array, shingle: int, seed: int = SEED) -> np.ndarray:
    """The fingerprints of a column of texts."""
    return _fingerprints(*_checked_words(*K.string_buffer(texts)), shingle, seed)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """One row (doc_id, fp) for each document; ``fp`` holds the 64 bits of the fingerprint."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            prints = text_prints(part.column(1), shingle, seed)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

        return work

    return K.map_slices(narrow, ["doc_id", "text"], "text", f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint", make)


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys, rows = golay.keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _around(members: DataFrame) -> DataFrame:
    """(word, fp): each fingerprint under itself and under all words one bit away."""
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    return members.select("fp", F.explode(words).alias("word"))


def links(prints: DataFrame, bits: int = BITS, small: int = SMALL_BUCKET) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fp`` that connect all within ``bits`` (2 at most) of one another."""
    if not 0 <= bits <= 2:
        raise ValueError("Golay keys find fingerprints that differ in at most 2 bits")
    keyed = _keyed(prints)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = few.select(
        F.explode(
            F.expr(
                f"flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, {small}), y -> bit_count(x ^ y) <= {bits}), y -> named_struct('a', x, 'b', y))))"
            )
        ).alias("p")
    ).select("p.a", "p.b")
    if bits < 2:  # two fingerprints under one word may differ in two bits: pair such buckets only with themselves one bit away
        many = met.where(F.col("n") > small).select("fp").distinct()
        around = _around(many).withColumnRenamed("word", "b").join(many.withColumnRenamed("fp", "b"), "b")
        return pairs.unionByName(around.select(F.col("fp").alias("a"), "b").where(f"bit_count(a ^ b) <= {bits}")).where("a != b").distinct()
    many = _around(met.where(F.col("n") > small).select("fp").distinct())
    least = many.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = many.join(least, "word").where("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED, bits: int = BITS, small: int = SMALL_BUCKET
) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each document."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct, bits, small))
    member = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")))
    of = cut(join_back(member, least, "root", "prints").select("fp", "n", "component_id"))
    return join_back(prints, of, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
