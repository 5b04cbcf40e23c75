"""Suffix-array deduplication: bytes of long strings that start earlier in the corpus go.

Regions that may repeat meet by anchor (see ``repeats``).  Their bytes, joined with
separators, are suffix-sorted by linear grouping (see ``suffix_sort``); windows that are
equal are neighbours in the array, and all but the first in corpus order are covered.

Defined results: a null text is empty and keeps nothing, with the digest of no bytes;
texts shorter than a window keep everything; rows that share an id are one document,
with earlier starts judged by place, and equal texts in them are not repeats of each other; a
null id comes before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats
from .suffix_sort import suffix_array

WINDOW = 100
GRAM = 40


def earlier_windows(symbols: list[np.ndarray], ranks: list[int], window: int) -> list[list[int]]:
    """For each sequence, the starts of windows that a sequence of lower rank has too."""
    lengths = np.array([len(s) for s in symbols])
    begin = np.cumsum(lengths + 1) - lengths - 1
    flat = np.zeros(int(lengths.sum()) + len(symbols), dtype=np.int64)  # 0 separates
    inside = np.ones(len(flat), dtype=bool)
    inside[begin + lengths] = False
    flat[inside] = np.unique(np.concatenate(symbols), return_inverse=True)[1] + 1
    owner = np.repeat(np.arange(len(symbols)), lengths + 1)
    room = np.repeat(begin + lengths, lengths + 1) - np.arange(len(flat))
    order = suffix_array(flat)
    order = order[room[order] >= window]
    if len(order) < 2:
        return [[] for _ in symbols]
    views = np.lib.stride_tricks.sliding_window_view(flat, window)
    equal = np.zeros(len(order), dtype=bool)
    for a in range(1, len(order), 8192):
        b = min(len(order), a + 8192)
        equal[a:b] = (views[order[a:b]] == views[order[a - 1 : b - 1]]).all(axis=1)
    cluster = np.cumsum(~equal)
    rank = np.array(ranks)[owner[order]]
    least = np.full(int(cluster[-1]) + 1, len(ranks) + 1)
    np.minimum.at(least, cluster, rank)
    out: list[list[int]] = [[] for _ in symbols]
    for p in order[rank > least[cluster]].tolist():
        out[owner[p]].append(p - int(begin[owner[p]]))
    return out


def kind(window: int = WINDOW, gram: int | None = None) -> repeats.Kind:
    return repeats.Kind(window, gram or max(1, window * GRAM // WINDOW), repeats.byte_units, False, earlier_windows)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each document: bytes, removed bytes, maximal removed runs, and the digest of what is left.

    ``with_text`` adds the bytes that are left as ``kept``.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = repeats.with_spans(narrow, repeats.covered(narrow, kind(window)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offsets = K.string_buffer(part.column(1))
            raw = memoryview(buf)
            rows = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                mask = repeats.span_mask(part.column(2), i, b - a)
                if mask is None:
                    left, gone, runs = raw[a:b], 0, 0
                else:
                    left, gone, runs = buf[a:b][~mask].tobytes(), int(mask.sum()), len(K.runs_of(mask)[0])
                rows.append((b - a, gone, runs, hashlib.sha256(left).hexdigest()) + ((bytes(left),) if with_text else ()))
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string(), pa.binary()])]
            return pa.RecordBatch.from_arrays([part.column(0), *made], names)

        return work

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return K.map_slices(joined, ["doc_id", "text", "spans"], "text", schema, make)
