"""Ranking as relational plans: BM25 over an inverted index, cosine top-k, agreement and fusion of rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
TOP = 50
AGREEMENT_P = 0.95
MOST_QUERY_VALUES = 8_000_000  # doubles of query vectors in one broadcast (64 MB)


def bm25_index(docs: DataFrame, doc: str = "doc", tokens: str = "tokens", asked: DataFrame | None = None) -> DataFrame:
    """Postings (token, doc, tf, doc_len, avgdl, idf): idf is ln(documents / documents with the token).

    With ``asked`` (query, tokens) only its tokens have postings: the others never reach a shuffle.
    """
    sizes = docs.select(F.col(doc).alias("doc"), F.col(tokens).alias("tokens"), F.size(tokens).alias("doc_len"))
    totals = sizes.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
    every = sizes.select("doc", "doc_len", F.explode("tokens").alias("token"))
    if asked is not None:
        every = every.join(asked.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    postings = every.groupBy("token", "doc", "doc_len").agg(F.count("*").alias("tf"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    return postings.join(df, "token").join(F.broadcast(totals)).select("token", "doc", "tf", "doc_len", "avgdl", F.log(F.col("n") / F.col("df")).alias("idf"))


def bm25_scores(queries: DataFrame, postings: DataFrame, k1: float = K1, b: float = B, in_order: bool = False, decimals: int = 9) -> DataFrame:
    """(query, doc, score, first): ``queries`` has query and tokens; a repeated token counts again. ``first`` is the place of the
    first query token that the document holds, by which equal scores keep their order.

    Parts are summed as they come and the sum is rounded to ``decimals``, so that it doesn't tell in which order; ``in_order`` sums them in the
    order of the query's tokens instead, without rounding, for which each pair gathers its parts.  A token's hits are dealt out by query and
    document; where one token has a large part of all postings, adaptive execution splits its join.
    """
    asked = queries.select("query", F.posexplode("tokens").alias("place", "token"))
    length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (length + F.col("tf"))
    if in_order:
        hits = asked.join(postings, "token").select("query", "doc", "place", part.alias("part"))
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("place", "part"))), F.lit(0.0), lambda s, x: s + x["part"])
        return hits.groupBy("query", "doc").agg(total.alias("score"), F.min("place").alias("first"))
    counted = asked.groupBy("query", "token").agg(F.count("*").alias("times"), F.min("place").alias("place"))
    hits = counted.join(postings, "token").select("query", "doc", "place", (part * F.col("times")).alias("part"))
    return hits.groupBy("query", "doc").agg(F.round(F.sum("part"), decimals).alias("score"), F.min("place").alias("first"))


def top_k(scores: DataFrame, k: int = TOP, ascending: bool = False, ties: tuple[str, ...] = ("first", "doc")) -> DataFrame:
    """The best ``k`` documents of each query with their rank; ties by the given columns."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = Window.partitionBy("query").orderBy(score, *ties)
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, doc: str = "doc", vector: str = "vec") -> DataFrame:
    """(query, doc, score, rank) by cosine similarity: query vectors, of bounded size, are broadcast in blocks; documents stream
    past them, and each batch keeps its own best ``k`` before the ranking.

    ``queries`` has query and vec. A null or zero vector has similarity 0.
    """
    spark = vectors.sparkSession
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    blocks = max(1, -(-n * max(1, width) // MOST_QUERY_VALUES))
    numbered = queries.select("query", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
    kind, doc_kind = queries.schema["query"].dataType.simpleString(), vectors.schema[doc].dataType.simpleString()
    parts = []
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("query", "vec").toArrow()
        sent = spark.sparkContext.broadcast((rows["query"].combine_chunks(), _unit(rows["vec"].to_pylist(), width)))

        def run(batches, sent=sent):
            names, matrix = sent.value
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                scores = _unit(batch.column(1).to_pylist(), width) @ matrix.T  # documents by queries
                keep = min(k, batch.num_rows)
                best = np.argpartition(-scores, keep - 1, axis=0)[:keep] if keep < batch.num_rows else np.tile(np.arange(batch.num_rows)[:, None], (1, len(names)))
                if keep < batch.num_rows:  # equals of the last kept score may be ahead of it by their ids
                    least = np.take_along_axis(scores, best, axis=0).min(axis=0)
                    d, q = np.nonzero(scores >= least)
                else:
                    d, q = best.ravel(), np.tile(np.arange(len(names)), keep)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(d)), pa.array(scores[d, q])], ["query", "doc", "score"])

        parts.append(vectors.select(F.col(doc).alias("doc"), F.transform(vector, lambda x: x.cast("double")).alias("vec")).mapInArrow(run, f"query {kind}, doc {doc_kind}, score double"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return top_k(every, k, ties=("doc",))


def _unit(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r) == width:
            out[i] = [x if x is not None else 0.0 for x in r]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def rank_agreement(a: DataFrame, b: DataFrame, p: float = AGREEMENT_P, depth: int = TOP) -> DataFrame:
    """(query, agreement): rank-biased overlap of two rankings (query, doc, rank) down to the length of the first.

    At each depth the overlap counts documents whose worse rank is at most that depth.
    """
    if not 0 <= p <= 1:
        raise ValueError(f"p should be between 0 and 1. Provided value is {p}.")
    a, b = (x.where(F.col("rank") <= depth).select("query", "doc", "rank") for x in (a, b))
    sizes = a.groupBy("query").agg(F.max("rank").alias("n"))
    both = a.join(b.withColumnRenamed("rank", "other"), ["query", "doc"]).select("query", F.greatest("rank", "other").alias("met"))
    counted = both.groupBy("query", "met").agg(F.count("*").alias("c"))
    deep = sizes.select("query", F.explode(F.sequence(F.lit(1), "n")).alias("met")).join(counted, ["query", "met"], "left")
    overlap = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("query").orderBy("met"))
    parts = deep.select("query", "met", (overlap / F.col("met") * F.pow(F.lit(p), F.col("met"))).alias("part"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("met", "part"))), F.lit(0.0), lambda s, x: s + x["part"])
    return parts.groupBy("query").agg((F.lit(1 - p) * total).alias("agreement"))


def min_max(score: Column, by: str = "query") -> Column:
    """Scores from 0 to 1 within each query; all equal ones are 0.5."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(low == high, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / F.greatest(high - low, F.lit(1e-9)))))


def ranker_confidence(scores: DataFrame, score: str = "score") -> DataFrame:
    """(query, confidence): 0.7 of the relative gap between the best score and the next different one, and 0.3 of one over one
    plus the variation of all but the best."""
    down = F.reverse(F.array_sort(F.collect_list(score)))
    lists = scores.groupBy("query").agg(down.alias("s"))
    best = F.col("s")[0]
    second = F.coalesce(F.try_element_at(F.filter("s", lambda x: x != best), F.lit(1)), F.lit(0.0))
    rest = F.slice("s", 2, F.size("s"))
    mean = F.aggregate(rest, F.lit(0.0), lambda t, x: t + x) / F.size(rest)
    lists = lists.withColumn("mean", mean)
    deviation = F.sqrt(F.aggregate(rest, F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.size(rest))
    spread = F.when((F.size("s") > 2) & (F.col("mean") > 0), 1.0 / (1.0 + deviation / F.col("mean"))).otherwise(1.0)
    confidence = F.when(F.size("s") < 2, 0.0).otherwise(0.7 * (best - second) / best + 0.3 * spread)
    return lists.select("query", confidence.alias("confidence"))


def fuse(up: DataFrame, down: DataFrame) -> DataFrame:
    """(query, doc, score): two rankings as one. ``up`` scores the better the higher, ``down`` the better the lower; each is
    normalised and weighs by its confidence; a document that one lacks gets nothing from it."""
    a = up.select("query", "doc", min_max(F.col("score")).alias("score"))
    b = down.select("query", "doc", min_max(F.col("score")).alias("score"))
    weights = ranker_confidence(a).withColumnRenamed("confidence", "ca").join(ranker_confidence(b).withColumnRenamed("confidence", "cb"), "query", "full")
    weights = weights.select("query", F.coalesce("ca", F.lit(0.0)).alias("ca"), F.coalesce("cb", F.lit(0.0)).alias("cb"))
    both = a.withColumnRenamed("score", "sa").join(b.withColumnRenamed("score", "sb"), ["query", "doc"], "full").join(weights, "query")
    mixed = (F.col("ca") * F.coalesce("sa", F.lit(0.0)) + F.col("cb") * (1 - F.coalesce("sb", F.lit(1.0)))) / (F.col("ca") + F.col("cb"))
    return both.select("query", "doc", mixed.alias("score"))
