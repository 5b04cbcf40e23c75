"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  A line's features are binned measures
of its own text and of the lines before and after it; a chain of two states links
neighbouring lines.  Forward-backward marginals of "good", weighted by line length, are
the document's score.

Training is on the driver in numpy, over a bounded sample of labelled documents that
aren't held out: whole texts in hash order, ``sample_docs`` of them at most and no more than ``sample_lines`` lines
together (a text of more lines than are left is passed over): each line takes its document's label, and the conditional
likelihood of the label sequences is maximised by Adam with a small quadratic penalty.

Defined results: a null or wordless text is one line of no words and gets that line's
marginal; repeated rows get equal scores; without any usable label every score is 0.5;
a document labelled twice takes part in training once for each label; equal rows take part once; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .language_id import held_out
from .quality_rules import Coverage, later_equals

SAMPLE_DOCS = 3000
SAMPLE_LINES = 300_000
THRESHOLD = 0.3
BINS = {
    "words": [1, 2, 4, 8, 16, 32, 64, 128],
    "word_length": [2, 3, 4, 5, 6, 7, 9, 12],
    "upper": [0.001, 0.05, 0.15, 0.3, 0.6],
    "digit": [0.001, 0.02, 0.1, 0.3],
    "symbol": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25],
    "punctuation": [0.001, 0.01, 0.02, 0.04, 0.08, 0.15],
    "mark": [0.001, 0.01, 0.05],
    "distinct": [0.2, 0.4, 0.6, 0.8, 0.95, 0.9999],
    "again": [0.5],
    "accent": [0.001, 0.05, 0.1, 0.2],
}
#: Measures whose bins of the neighbouring lines are features too.
NEAR = ("words", "word_length", "upper", "symbol", "punctuation", "distinct", "again")


def _classes() -> np.ndarray:
    c = np.zeros((256, 6), dtype=np.uint8)
    c[0x41:0x5B, 0] = 1
    c[0x30:0x3A, 1] = 1
    for s in b"#*$%&|<>":
        c[s, 2] = 1
    for s in b".,;:'\"()-/[]{}_=+@\\^`~":
        c[s, 3] = 1
    for s in b"!?":
        c[s, 4] = 1
    c[0xC0:, 5] = 1
    return c


_CLASS = _classes()
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _layout() -> tuple[dict[str, tuple[int, int]], int]:
    at, place = 1, {}
    for name, edges in BINS.items():
        place[name] = (at, len(edges) + 1)
        at += len(edges) + 1
    for side in ("before", "after"):
        for name in NEAR:
            place[f"{side}_{name}"] = (at, len(BINS[name]) + 2)  # and one for no line there
            at += len(BINS[name]) + 2
    return place, at


PLACE, N_FEATURES = _layout()


def line_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a slice of documents: feature numbers (lines x features that hold), lengths in bytes, lines before each document."""
    n_docs = len(offsets) - 1
    c = Coverage(buf, offsets)
    starts, ends, first = K.find_words(buf, offsets, _LINE)
    wf, wt = np.searchsorted(c.starts, starts), np.searchsorted(c.starts, ends)
    some = wt > wf
    doc = np.repeat(np.arange(n_docs), np.diff(first))[some]
    starts, ends, wf, wt = starts[some], ends[some], wf[some], wt[some]
    n_words = (wt - wf).astype(np.float64)
    chars = np.concatenate(([0], np.cumsum(c.chars)))
    word_chars = (chars[wt] - chars[wf]).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    measures: dict[str, np.ndarray] = {"words": n_words, "word_length": word_chars / np.maximum(n_words, 1)}
    for k, name in enumerate(("upper", "digit", "symbol", "punctuation", "mark", "accent")):
        total = np.concatenate(([0], np.cumsum(_CLASS[buf, k], dtype=np.int64)))
        measures[name] = (total[ends] - total[starts]) / size
    line_of = np.repeat(np.arange(len(starts)), wt - wf)
    if len(line_of):
        hashes = c.bytes(c.starts, c.ends)
        repeat = later_equals(hashes + K.mix(line_of.astype(K.U64)))
        measures["distinct"] = 1 - np.bincount(line_of, weights=repeat, minlength=len(starts)) / n_words
        measures["again"] = later_equals(c.bytes(starts, ends) + K.mix(doc.astype(K.U64))).astype(np.float64)
    else:
        measures["distinct"] = measures["again"] = np.zeros(len(starts))
    # A document without such lines is one line of zeros.
    counts = np.bincount(doc, minlength=n_docs)
    rows = np.concatenate([doc, np.flatnonzero(counts == 0)])
    order = np.argsort(rows, kind="stable")
    doc = rows[order]
    empty = int((counts == 0).sum())
    bins = {m: np.digitize(np.concatenate([v, np.zeros(empty)]), BINS[m])[order] for m, v in measures.items()}
    weight = np.concatenate([size, np.ones(empty)])[order]
    features = [np.zeros(len(doc), dtype=np.int64)] + [PLACE[m][0] + bins[m] for m in BINS]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = doc[1:] != doc[:-1]
    tail = np.roll(head, -1)
    for side, edge, shift in (("before", head, 1), ("after", tail, -1)):
        for m in NEAR:
            features.append(PLACE[f"{side}_{m}"][0] + np.where(edge, len(BINS[m]) + 1, np.roll(bins[m], shift)))
    lines_before = np.concatenate(([0], np.cumsum(np.maximum(counts, 1))))
    return np.stack(features, axis=1).astype(np.int16), weight, lines_before


class LineChain:
    """A chain of two states: state 1 is good.  ``weights`` score state 1 against state 0; ``links[i, j]`` scores i before j."""

    def __init__(self, weights: np.ndarray, links: np.ndarray):
        self.weights, self.links = weights, links

    def marginals(self, features: np.ndarray, lines_before: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward and backward passes over all documents in lockstep."""
        emit = self.weights[features].sum(axis=1)
        lengths = np.diff(lines_before)
        order = np.argsort(-lengths, kind="stable")
        begin, ordered = lines_before[:-1][order], lengths[order]
        out = np.zeros(len(emit))
        if not len(emit):
            return out
        alive = np.searchsorted(-ordered, -np.arange(int(ordered[0])), side="left")
        k = self.links
        forward = np.zeros((len(emit), 2))
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + t
            if t:
                p = forward[at - 1]
                s0 = np.logaddexp(p[:, 0] + k[0, 0], p[:, 1] + k[1, 0])
                s1 = np.logaddexp(p[:, 0] + k[0, 1], p[:, 1] + k[1, 1]) + emit[at]
            else:
                s0, s1 = np.zeros(n), emit[at]
            top = np.maximum(s0, s1)
            forward[at, 0], forward[at, 1] = s0 - top, s1 - top
        backward = np.zeros((len(emit), 2))
        for t in range(len(alive) - 2, -1, -1):
            n = int(alive[t + 1])
            nxt = begin[:n] + t + 1
            b0, b1 = backward[nxt, 0], backward[nxt, 1] + emit[nxt]
            s0 = np.logaddexp(k[0, 0] + b0, k[0, 1] + b1)
            s1 = np.logaddexp(k[1, 0] + b0, k[1, 1] + b1)
            top = np.maximum(s0, s1)
            backward[nxt - 1, 0], backward[nxt - 1, 1] = s0 - top, s1 - top
        score = (forward[:, 1] + backward[:, 1]) - (forward[:, 0] + backward[:, 0])
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))

    def pairs(self, features: np.ndarray, lines_before: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Expected numbers of the four transitions, from marginals and the chain's conditional structure."""
        emit = self.weights[features].sum(axis=1)
        starts = np.zeros(len(emit), dtype=bool)
        starts[lines_before[:-1]] = True
        at = np.flatnonzero(~starts)
        # P(i, j) of neighbours given their marginals: scale exp(links) to both margins.
        p, q = np.clip(good[at - 1], 1e-9, 1 - 1e-9), np.clip(good[at], 1e-9, 1 - 1e-9)
        odds = math.exp(np.clip(self.links[0, 0] + self.links[1, 1] - self.links[0, 1] - self.links[1, 0], -50, 50))
        if abs(odds - 1) < 1e-9:
            both = p * q
        else:
            s = 1 + (p + q) * (odds - 1)
            both = (s - np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * p * q, 0))) / (2 * (odds - 1))
        n11 = both.sum()
        n10, n01 = (p - both).sum(), (q - both).sum()
        return np.array([[len(at) - n11 - n10 - n01, n01], [n10, n11]])

    @classmethod
    def fit(cls, features: np.ndarray, lines_before: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.08, penalty: float = 1.0) -> LineChain:
        chain = cls(np.zeros(N_FEATURES), np.zeros((2, 2)))
        line_label = np.repeat(labels, np.diff(lines_before)).astype(np.float64)
        n = len(line_label)
        seen = chain.pairs(features, lines_before, line_label)
        flat = features.ravel()
        width = features.shape[1]
        m1 = v1 = np.zeros(N_FEATURES)
        m2 = v2 = np.zeros((2, 2))
        for step in range(1, rounds + 1):
            good = chain.marginals(features, lines_before)
            g1 = np.bincount(flat, weights=np.repeat(line_label - good, width), minlength=N_FEATURES) / n - penalty * chain.weights / n
            g2 = (seen - chain.pairs(features, lines_before, good)) / n - penalty * chain.links / n
            m1, v1 = 0.9 * m1 + 0.1 * g1, 0.999 * v1 + 0.001 * g1**2
            m2, v2 = 0.9 * m2 + 0.1 * g2, 0.999 * v2 + 0.001 * g2**2
            a, b = 1 - 0.9**step, 1 - 0.999**step
            chain.weights = chain.weights + rate * (m1 / a) / (np.sqrt(v1 / b) + 1e-8)
            chain.links = chain.links + rate * (m2 / a) / (np.sqrt(v2 / b) + 1e-8)
        return chain

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, weight, before = line_features(buf, offsets)
        good = self.marginals(features, before)
        return np.clip(np.add.reduceat(good * weight, before[:-1]) / np.add.reduceat(weight, before[:-1]), 0, 1)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int, sample_lines: int):
    """Features of a bounded, hash-ordered sample of labelled documents; only feature numbers reach the driver."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")).alias("h")
    )
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.coalesce(F.size(F.split(text, "\n")), F.lit(1)).alias("lines"))
    chosen = marked.orderBy("h", "doc_id", "label").limit(sample_docs)  # a top-k: no full sort
    joined = texts.join(F.broadcast(chosen), "doc_id")
    order = ["h", "doc_id", "label", "t"]
    left, taken = sample_lines, []
    for r in joined.select(*order, "lines").orderBy(*order).limit(sample_docs).collect():
        key = tuple(r[:4])
        if r.lines <= left and (not taken or taken[-1] != key):
            left -= r.lines
            taken.append(key)
    kept = docs.sparkSession.createDataFrame(taken, joined.select(*order).schema)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                features, _, before = line_features(*K.string_buffer(part.column(1)))
                packed = [features[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(0).cast(pa.string()), part.column(2), pa.array(packed, pa.binary())], ["h", "id", "label", "features"])

    K.small_batches(docs)
    wanted = joined.join(F.broadcast(kept), order, "left_semi").select("doc_id", "text", "label", "h")
    rows = wanted.mapInArrow(run, "h bigint, id string, label int, features binary").distinct().collect()
    rows.sort(key=lambda r: (r.h, r.id or "", r.label, bytes(r.features)))
    width = 1 + len(BINS) + 2 * len(NEAR)
    parts = [np.frombuffer(bytes(r.features), dtype=np.int16).reshape(-1, width) for r in rows]
    before = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros((0, width), np.int16)), before, np.array([r.label for r in rows])


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_docs=SAMPLE_DOCS, sample_lines=SAMPLE_LINES) -> LineChain:
    features, before, marks = training_sample(docs, labels, id_col, text_col, label_col, sample_docs, sample_lines)
    if not len(marks):
        return LineChain(np.zeros(N_FEATURES), np.zeros((2, 2)))
    return LineChain.fit(features, before, marks)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, chain: LineChain | None = None
) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each document."""
    chain = chain or fit(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast((chain.weights, chain.links))
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def make():
        model = LineChain(*sent.value)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.scores(*K.string_buffer(part.column(2)))
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

        return work

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return K.map_slices(narrow, ["doc_id", "held_out", "text"], "text", schema, make)
