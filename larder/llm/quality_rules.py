"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

Words of a slice of documents are hashed at once; prefix sums of the words' hashes give
the hash of any n-gram, and one sort for each length finds the n-grams that a document
holds twice or more.  A rule limits the share of word characters inside duplicated
n-grams of one length, and the share inside duplicated lines.

Defined results: a null or empty text has no words and fails the base rules (too few
words); repeated rows are judged each; lines are cut at \\n only, and lines without a
word count neither as duplicates nor as earlier lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Largest share of word characters that duplicated n-grams of a length may cover.
NGRAM_LIMITS = {5: 0.35, 7: 0.32, 10: 0.30}
#: Largest share of word characters that lines equal to an earlier line may cover.
LINE_LIMIT = 0.30
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def repeated(keys: np.ndarray) -> np.ndarray:
    """A mask of the elements that have an equal."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    mask = np.zeros(len(keys), dtype=bool)
    mask[order[1:][same]] = True
    mask[order[:-1][same]] = True
    return mask


def later_equals(keys: np.ndarray) -> np.ndarray:
    """A mask of the elements that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    mask = np.zeros(len(keys), dtype=bool)
    mask[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return mask


def spread(found: np.ndarray, n: int, total: int) -> np.ndarray:
    """A mask of the ``total`` words that lie in a found n-gram; ``found`` holds first words."""
    step = np.zeros(total + 1, dtype=np.int32)
    at = np.flatnonzero(found)
    step[at] += 1
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


class Coverage:
    """The words of a slice of documents and what repeats among them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        self.starts, self.ends, self.first = K.find_words(buf, offsets, ~K.SPACE)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.bytes = K.RangeHash(K.BYTE_VALUE[buf]) if len(buf) else None
        hashes = self.bytes(self.starts, self.ends) if len(self.starts) else np.zeros(0, dtype=K.U64)
        self.words = K.RangeHash(hashes) if len(hashes) else None
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # code points before a byte
        self.chars = points[self.ends] - points[self.starts]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.n_words)).astype(np.int64)

    def in_repeats(self, n: int) -> np.ndarray:
        """A mask of the words inside an n-gram that its document holds twice or more."""
        total = len(self.starts)
        if total < n:
            return np.zeros(total, dtype=bool)
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        keys = self.words(at, at + n) + K.mix(self.doc[at].astype(K.U64) + K.U64(1))
        found = np.zeros(total, dtype=bool)
        found[at[repeated(keys)]] = True
        return spread(found, n, total)

    def duplicate_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of lines equal to an earlier one, and of the word characters in them."""
        none = np.zeros(len(self.n_words), dtype=np.int64)
        if not len(self.buf):
            return none, none
        starts, ends, first = K.find_words(self.buf, self.offsets, _LINE)
        word_from, word_to = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        some = word_to > word_from
        doc = np.repeat(np.arange(len(self.n_words)), np.diff(first))[some]
        keys = self.bytes(starts[some], ends[some]) + K.mix(doc.astype(K.U64) + K.U64(1))
        again = later_equals(keys)
        chars = np.concatenate(([0], np.cumsum(self.chars)))
        held = chars[word_to[some]] - chars[word_from[some]]
        size = len(self.n_words)
        return (
            np.bincount(doc[again], minlength=size).astype(np.int64),
            np.bincount(doc[again], weights=held[again], minlength=size).astype(np.int64),
        )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """One row for each document: counts, characters in duplicates for each length, and the verdicts."""
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in limits)]

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            c = Coverage(*K.string_buffer(part.column(1)))
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[c.buf])))[c.offsets]
            lines, line_chars = c.duplicate_lines()
            found = [
                c.n_words.astype(np.int64),
                c.per_doc(c.chars),
                np.diff(symbols).astype(np.int64),
                lines,
                c.per_doc(c.in_repeats(3)),
                line_chars,
                *(c.per_doc(np.where(c.in_repeats(n), c.chars, 0)) for n in limits),
            ]
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *longs])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    counted = K.map_slices(narrow, ["doc_id", "text"], "text", f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in longs), make)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    over = F.col("dup_line_chars") > F.lit(line_limit) * F.col("word_chars")
    for n, limit in limits.items():
        over = over | (F.col(f"dup_{n}gram_chars") > F.lit(limit) * F.col("word_chars"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
