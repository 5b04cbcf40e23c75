"""Substring deduplication by matching statistics against suffix automata.

Regions that may repeat meet by anchor (see ``repeats``): a shard of the reference, here the
corpus itself, is what shares anchors.  Each shard's contents make a generalised suffix
automaton whose states know whether more than one content holds their strings; each
content then streams past it, and where the longest suffix held twice reaches the window,
the window is covered.  Shards are made where their readers are, so nothing that grows
with the corpus is broadcast.

Words are runs of anything but ASCII white space, compared unchanged.  Defined results:
a null or wordless text keeps nothing, with the digest of no bytes; fewer words than a
window keep everything; windows of repeated rows and of exact copies are covered in all of
them, the first included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats
from .automaton import SuffixAutomaton

WINDOW = 35
GRAM = 16
_SEVERAL = -2


class SharedAutomaton(SuffixAutomaton):
    """A generalised suffix automaton that knows which strings more than one sequence holds."""

    def __init__(self, sequences: list[list[int]]):
        super().__init__(sequences)
        owner = [-1] * len(self.next)
        for number, sequence in enumerate(sequences):
            state = 0
            for symbol in sequence:
                state = self.next[state][symbol]
                up = state
                while up and owner[up] != number and owner[up] != _SEVERAL:
                    owner[up] = number if owner[up] == -1 else _SEVERAL
                    up = self.link[up]
        self.shared = [0] * len(self.next)  # length of the longest suffix of a state's strings that several sequences hold
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.shared[state] = self.length[state] if owner[state] == _SEVERAL else self.shared[self.link[state]]

    def covered_starts(self, sequence: list[int], window: int) -> list[int]:
        """Starts of windows that another sequence holds too."""
        out, state = [], 0
        for i, symbol in enumerate(sequence):
            state = self.next[state][symbol]  # its own text never leaves the automaton
            if min(self.shared[state], i + 1) >= window:
                out.append(i + 1 - window)
        return out


def shared_windows(symbols: list[np.ndarray], ranks: list[int], window: int) -> list[list[int]]:
    """For each sequence, the starts of windows that another sequence has too."""
    numbers = np.unique(np.concatenate(symbols), return_inverse=True)[1]
    cuts = np.cumsum([len(s) for s in symbols])[:-1]
    sequences = [s.tolist() for s in np.split(numbers, cuts)]
    automaton = SharedAutomaton(sequences)
    return [automaton.covered_starts(s, window) for s in sequences]


def kind(window: int = WINDOW, gram: int | None = None) -> repeats.Kind:
    return repeats.Kind(window, gram or max(1, window * GRAM // WINDOW), repeats.word_units, True, shared_windows)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each document: words, removed words, and the digest of the kept words joined by one space.

    ``with_text`` adds those words as ``kept``.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = repeats.with_spans(narrow, repeats.covered(narrow, kind(window)))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            buf, offsets = K.string_buffer(part.column(1))
            raw = buf.tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words = raw[a:b].split()
                mask = repeats.span_mask(part.column(2), i, len(words))
                gone = 0
                if mask is not None:
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                left = b" ".join(words)
                rows.append((len(words) + gone, gone, hashlib.sha256(left).hexdigest()) + ((left.decode("utf-8", "replace"),) if with_text else ()))
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.string()] * 2)]
            return pa.RecordBatch.from_arrays([part.column(0), *made], names)

        return work

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return K.map_slices(joined, ["doc_id", "text", "spans"], "text", schema, make)
