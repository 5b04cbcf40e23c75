"""Windows of a fixed number of units (bytes or words), keyed by content.

Every window of ``window`` units selects one anchor: the leftmost of its grams of
``gram`` units with the least hash.  The choice depends on the window's content alone,
so equal windows, wherever they stand, select equal anchors at equal places.  The
windows of a document that select the same anchor start next to one another; together
they are a region.  Work on equal windows can so be dealt out by anchor, with one row
for each region rather than for each window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import kernels as K


class Regions(NamedTuple):
    """Regions of a slice: document row, first window start, behind the last window's end (units of the slice), anchor, its hash, the region's hash."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima inside blocks of that width."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def regions(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> Regions:
    """Regions of documents whose unit hashes are ``units[first[d]:first[d + 1]]``."""
    none = np.zeros(0, dtype=np.int64)
    if len(units) < window:
        return Regions(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    ranged = K.RangeHash(units)
    spots = np.arange(len(units) - gram + 1)
    grams = ranged(spots, spots + gram)
    bits = np.uint64(max(20, int(len(units)).bit_length()))
    keys = (K.mix(grams + np.uint64(0x51ED270B)) >> bits << bits) | spots.astype(np.uint64)
    at = (sliding_min(keys, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(doc[: len(units) - window + 1] == doc[window - 1 :])
    if not len(starts):
        return Regions(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    chosen = at[starts]
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(head)
    lasts = np.concatenate((heads[1:], [len(starts)])) - 1
    lo, hi, at = starts[heads], starts[lasts] + window, chosen[heads]
    content = ranged(lo, hi) + K.mix((at - lo).astype(np.uint64))
    return Regions(doc[lo], lo, hi, at, grams[at], content)
