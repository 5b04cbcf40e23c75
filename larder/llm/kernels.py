"""Vectorised byte and word kernels shared by the text operators.

Arrow hands each batch over as one UTF-8 buffer with offsets; these kernels find
words and hash them for a whole slice of documents at once, so that no Python
code runs per character.  A slice holds about ``SLICE_BYTES``; a document longer
than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_BYTES = 1 << 20
U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    words = [int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)]
    return np.array(words, dtype=U64)


BYTE_VALUE = _byte_values()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_powers = (np.ones(1, dtype=U64), np.ones(1, dtype=U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())  # every worker keeps its tables
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _powers = (tables[0], tables[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class RangeHash:
    """Hashes of any ranges of one sequence from its prefix sums: equal contents give equal hashes."""

    def __init__(self, values: np.ndarray):
        power, self._inverse = _power_tables(len(values))
        self._prefix = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * power[: len(values)], out=self._prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._prefix[ends] - self._prefix[starts]) * self._inverse[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8)[lo:hi], offsets - lo


def slices(batch: pa.RecordBatch, column: str | int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts together hold about ``size`` bytes."""
    if not batch.num_rows:
        return
    _, offsets = string_buffer(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = max(row + 1, end)
        yield batch.slice(row, end - row)
        row = end


def find_words(buf: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and the number of words before each row."""
    starts, ends = find_runs(in_word[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def find_runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values within the rows."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(inside)]
    before[row_starts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    row_ends = offsets[1:][offsets[1:] > 0] - 1
    after[row_ends] = False
    return starts, np.flatnonzero(inside & ~after) + 1


_SPREAD = np.array([sum(1 << 8 * i for i in range(8) if b >> i & 1) for b in range(256)], dtype=U64)


def bit_sums(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes from ``starts``, which follow one another without gaps, how many have each of the 64 bits.

    Eight counters of eight bits share a machine word; stretches of up to 255 hashes can't overflow them.
    """
    out = np.zeros((len(counts), 64), dtype=np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    stretches = -(-counts[some] // 255)
    first = np.cumsum(stretches) - stretches
    begin = np.repeat(starts[some], stretches) + 255 * (np.arange(int(stretches.sum())) - np.repeat(first, stretches))
    octets = hashes[: starts[-1] + counts[-1]].astype("<u8").view(np.uint8).reshape(-1, 8)
    packed = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], begin) for k in range(8)], axis=1)
    out[some] = np.add.reduceat(packed.astype("<u8").view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    return out


def tidied(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which a worker hands back memory that it no longer needs: workers live on, and what their
    allocators hold adds up beside the executor's own."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
                trim(0)

    return wrapped


def map_slices(
    df: DataFrame,
    columns: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]],
    size: int = SLICE_BYTES,
) -> DataFrame:
    """Run ``make()`` once in each task and its result on each slice; only ``columns`` go to Python."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, size):
                out = work(part)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    small_batches(df)
    return df.select(*columns).mapInArrow(run, schema)


_kept: tuple[str, object] = ("", None)


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, built once in a worker and kept for its next tasks.  A worker keeps one such thing only, whatever operator it is for."""
    global _kept
    if _kept[0] != key:
        _kept = ("", None)  # the old one goes before the new one is made
        _kept = (key, make())
    return _kept[1]


def small_batches(df: DataFrame) -> None:
    """Bound the bytes of the Arrow batches that go to Python, as whole texts may be long, unless the session has a bound of its own.

    Spark has no such setting for one plan; the number of rows in a batch, which other operators may have set, stays as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(BATCH_BYTES)).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def union_lengths(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A mask of ``n`` positions that any of the half-open intervals covers."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0
