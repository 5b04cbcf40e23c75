"""Fuzzy line deduplication: sketches of normalised lines, keys that meet, edit similarity, connected groups.

Lines are cut at \\n and normalised: lower case (ASCII and Latin-1), runs of ASCII characters
other than letters and digits become one blank.  Lines without a word are never touched.
Equal normalised lines (by 128 bits of hash) are one from the start, however short.  Only distinct lines
of at least ``MIN_CHARS`` normalised characters are compared further.

A line's grams are runs of bytes, of 5, 7 or 8 by its length (``CLASSES``; the classes overlap by what the
similarity allows, so that two similar lines always share one; of long lines one gram in four counts, chosen by the gram's hash).
A key is made of ``ROWS`` MinHash minima of the grams; keys are dealt out in blocks, packed (``_meet``).  Lines that share a key are candidates where their lengths allow the
similarity and where single bits of ``BITS`` minima, put beside the length in one word, differ in at most ``BITS_APART`` places
(chance neighbours differ in about 20).  Candidates are verified by edit similarity (at least ``SIMILARITY``
of the longer line's characters), and one occurrence for each connected group stays: the first by (doc_id, line).

In every bucket the lines are first compared with one of them only, its centre.  What that leaves in several groups is compared pair by
pair: buckets of up to ``SMALL`` lines by joins; crowded ones, such as those of lines that share a passage but not the rest, in cells of
two chunks of about ``CHUNK`` lines, where lines of one group aren't compared.  So no candidate is lost to a crowd, and a crowd of lines
that aren't similar costs the square of its size in comparisons, dealt out over the cells.  Texts are sent only for lines that share a key, found by a bitmap of
bounded size; the edit distances of a batch of pairs are taken side by side, as far as they may stay within the limit.

Defined results: a null or empty text has no lines and nothing removed; rows that share an
id are one document, and equal places in them are one occurrence; a null id comes first;
a text's other lines, blank ones included, stay as they are and in order; two different lines of
one 64-bit hash (one in 10^19 pairs) are grouped with their exact copies only; an empty table gives no rows.
Which line is a bucket's centre depends on the order in which rows arrive; the groups don't.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sieve
from .components import FEW, components, join_back
from .storage import cut, release

MIN_WORDS = 1
MIN_CHARS = 20
SIMILARITY = 0.8
SMALL = 32
ROWS = 3


class Grams(NamedTuple):
    """How lines of ``least`` to ``most`` characters (0: without end) are sketched: bytes in a gram, bands, and one in how many grams counts."""

    size: int
    least: int
    most: int
    bands: int
    one_in: int


CLASSES = (Grams(5, 0, 40, 16, 1), Grams(7, 32, 200, 10, 1), Grams(8, 160, 0, 7, 4))
GRAMS_AT_ONCE = 1 << 16
CHUNK = 512
PAIRS_AT_ONCE = 1 << 12
SIDE_BY_SIDE = 1 << 14
FEW_PAIRS = 10
SPREAD = 1.5
GATHERED = 8 << 20
PACKED = 1 << 13
BLOCK_BITS = 12
SPLIT_BITS = 6
DEALT = 1 << 18
AT_ONCE = 1 << 16
AT_MOST = 1 << 20
LOOK_EVERY = 16
LENGTH_BITS = 9
LENGTH_MASK = (1 << LENGTH_BITS) - 1
LENGTH_STEP = 1.025
LENGTHS_APART = 10  # steps; a fifth less is 9.04
BITS = 40
BITS_APART = 14
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = True
_WORD_BYTE[0x80:] = True

_BLANKED = np.where(_WORD_BYTE, np.arange(256), 0x20).astype(np.uint8).tobytes()


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common ends, the longer first."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    return (a, b) if len(a) >= len(b) else (b, a)


def edit_distance(a: str, b: str, limit: float | None = None) -> int:
    """Levenshtein distance by bit vectors: a column of the table is one number of len(a) bits. Common ends cost nothing.
    With a ``limit`` a number beyond it stands for all distances beyond it, and is given as soon as it is sure."""
    a, b = _trimmed(a, b)
    if not b:
        return len(a)
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, distance = full, 0, len(a)
    for j, c in enumerate(b, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more = down | ~(diagonal | up) & full
        less = up & diagonal
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up = less | ~(diagonal | more) & full
        down = more & diagonal
        if limit is not None and not j % LOOK_EVERY:  # values never fall along the diagonal that ends in the distance
            ahead = (1 << j + len(a) - len(b)) - 1
            if (least := j + (up & ahead).bit_count() - (down & ahead).bit_count()) > limit:
                return least
    return distance


def within(a: str, b: str, limit: float) -> bool:
    """Whether a plain way of editing a to b, from one stretch they share to the next, takes no more than ``limit``. If not, a better one may."""
    i = j = spent = 0
    while spent <= limit:
        n = _common(a[i:], b[j:])
        i, j = i + n, j + n
        if i == len(a) or j == len(b):
            return spent + len(a) - i + len(b) - j <= limit
        for step in range(40):
            if i + step + 8 > len(a) or (at := b.find(a[i + step : i + step + 8], j, j + step + 48)) >= 0:
                break
        else:
            at = -1
        if i + step + 8 > len(a) or at < 0:
            return spent + max(len(a) - i, len(b) - j) <= limit
        spent += max(step, at - j)
        i, j = i + step, at
    return False


def _limit(a: str, b: str, least: float) -> float:
    return (1 - least) * max(len(a), len(b)) + 1e-9


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    limit = _limit(a, b, least)
    return abs(len(a) - len(b)) <= limit and (a == b or within(a, b, limit) or edit_distance(a, b) <= limit)


def similar_pairs(pairs: list[tuple[str, str]], least: float = SIMILARITY, plain: bool = True) -> np.ndarray:
    """``similar`` for many pairs: those of nearly the same length that the plain way of editing doesn't settle are compared side by side.
    Without ``plain`` all of them are, which is quicker where few are similar."""
    out = np.zeros(len(pairs), dtype=bool)
    limits = np.zeros(len(pairs))
    order, rest = [], {}
    for i, (a, b) in enumerate(pairs):
        limits[i] = limit = _limit(a, b, least)
        if abs(len(a) - len(b)) > limit:
            continue
        out[i] = a == b or (plain and within(a, b, limit))
        if not out[i]:
            a, b = _trimmed(a, b)
            out[i] = len(a) <= limit or not b
            if not out[i]:
                rest[i] = (a, b)
                order.append(i)
    order.sort(key=lambda i: len(rest[i][0]))
    at = 0
    while at < len(order):
        blocks = -(-max(64, SPREAD * len(rest[order[at]][0])) // 64)
        end = at
        while end < len(order) and end - at < SIDE_BY_SIDE // blocks and len(rest[order[end]][0]) <= 64 * blocks:
            end += 1
        some = order[at : max(end, at + 1)]
        at += len(some)
        if len(some) < FEW_PAIRS * blocks:  # too few to be worth it
            for i in some:
                out[i] = edit_distance(*rest[i], limits[i]) <= limits[i]
        else:
            out[some] = _distances([rest[i] for i in some], int(blocks), limits[some]) <= limits[some]
    return out


def _distances(pairs: list[tuple[str, str]], blocks: int, limits: np.ndarray) -> np.ndarray:
    """Levenshtein distances, where they are within the pairs' ``limits`` (larger ones come out larger than that), of pairs whose first
    text, the longer one, fills up to ``blocks`` words of 64 bits: a column of all tables at a time, of it only the blocks near the diagonals
    between the tables' corners, and only of pairs that may stay within their limits yet."""
    n = len(pairs)
    size = np.array([len(a) for a, _ in pairs])
    width = np.array([len(b) for _, b in pairs])
    order = np.argsort(-width, kind="stable")  # longest second text first: columns end at the back
    pairs, size, width, limits = [pairs[i] for i in order.tolist()], size[order], width[order], np.floor(limits[order]).astype(np.int64)
    points = [np.frombuffer("".join(x[k] for x in pairs).encode("utf-32-le", "surrogatepass"), dtype="<u4") for k in (0, 1)]
    letters, number = np.unique(points[0], return_inverse=True)
    there = np.zeros((len(letters) + 1) * blocks * n, dtype=K.U64)  # by letter, block and pair: the letter's places; the last letter is none
    place = np.arange(len(points[0])) - np.repeat(np.cumsum(size) - size, size)
    np.add.at(there, (number * blocks + place // 64) * n + np.repeat(np.arange(n), size), K.U64(1) << (place % 64).astype(K.U64))
    found = np.minimum(np.searchsorted(letters, points[1]), len(letters) - 1)
    found = np.where(letters[found] == points[1], found, len(letters))
    text = np.full((n, int(width[0]) if n else 0), len(letters), dtype=np.int64)
    text[np.arange(text.shape[1])[None, :] < width[:, None]] = found
    text = np.ascontiguousarray(text.T) * (blocks * n) + np.arange(n)
    one = K.U64(1)
    up, down = np.full((blocks, n), ~K.U64(0)), np.zeros((blocks, n), dtype=K.U64)
    bottom = np.minimum(np.arange(1, blocks + 1)[:, None] * 64, size[None, :])  # a block's last row
    last = ((bottom - 1) % 64).astype(K.U64)
    score = bottom.astype(np.int64)
    result = np.maximum(size, limits + 1)
    result[width == 0] = size[width == 0]
    further = size - width
    above, below = int(((limits - further) // 2).max()), int(((limits + further) // 2).max())  # a way within the limit strays so far from the diagonal of the first corner
    who = np.flatnonzero(width)  # the pairs that are still looked at
    m = len(who)
    if m < n:
        up, down, bottom, last, score = (x[:, who] for x in (up, down, bottom, last, score))
    active = 0
    for j in range(len(text)):
        if not m:
            break
        first = max(0, (j - above) // 64)
        while active < blocks and 64 * active <= j + below + 1:
            if active and j:
                score[active] = score[active - 1] + (bottom[active] - bottom[active - 1])
            active += 1
        more, less = np.ones(m, dtype=K.U64), np.zeros(m, dtype=K.U64)
        row = text[j, who[:m]]
        for w in range(first, active):
            eq, p, d, bit = there[row + w * n], up[w, :m], down[w, :m], last[w, :m]
            beside = eq | d
            eq |= less
            across = (((eq & p) + p) ^ p) | eq
            plus = d | ~(across | p)
            minus = p & across
            out_more, out_less = plus >> bit & one, minus >> bit & one
            score[w, :m] += out_more.view(np.int64) - out_less.view(np.int64)
            plus = plus << one | more
            minus = minus << one | less
            up[w, :m] = minus | ~(beside | plus)
            down[w, :m] = plus & beside
            more, less = out_more, out_less
        was = m
        while m and width[who[m - 1]] == j + 1:
            m -= 1
        if m < was:
            ended = np.arange(m, was)
            own = (size[who[ended]] - 1) // 64  # the block of a text's last row
            result[who[ended]] = np.where(active > own, score[np.minimum(own, active - 1), ended], result[who[ended]])
        if not (j + 1) % LOOK_EVERY and m:  # values never fall along the diagonal that ends in the distance
            spot = j + further[who[:m]]
            w, at = spot // 64, np.arange(m)
            beyond = (K.U64(2) << (spot % 64).astype(K.U64)) - one  # of the block's rows those to the spot
            rows = ((K.U64(2) << last[w, at]) - one) & ~beyond
            value = score[w, at] - np.bitwise_count(up[w, at] & rows).astype(np.int64) + np.bitwise_count(down[w, at] & rows)
            keep = np.flatnonzero(value <= limits[who[:m]])
            if m - len(keep) > m // 16:
                who, m = who[keep], len(keep)
                up, down, bottom, last, score = (x[:, keep] for x in (up, down, bottom, last, score))
    out = np.empty(n, dtype=np.int64)
    out[order] = result
    return out


class Lines:
    """The lines of a slice of documents that have enough words, found and hashed without building their texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, min_words: int):
        low = K.LOWER[buf]
        if len(low) > 1:  # capitals of Latin-1, which are two bytes
            second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
            low[1:][second] += 0x20
        self.low = low
        self.inside = _WORD_BYTE[low]
        self.starts, self.ends = K.find_runs(self.inside, offsets)
        breaks = np.flatnonzero(low == 0x0A)
        some = np.flatnonzero(np.diff(offsets))
        cuts = np.unique(np.concatenate((offsets[some], breaks + 1, offsets[-1:])))
        begin, end = cuts[:-1], cuts[1:]
        lo, hi = np.searchsorted(self.starts, begin), np.searchsorted(self.starts, end)
        keep = hi - lo >= max(1, min_words)
        self.lo, self.hi, begin = lo[keep], hi[keep], begin[keep]
        self.row = np.searchsorted(offsets, begin, side="right") - 1
        self.number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[self.row])
        none = np.zeros(0, dtype=K.U64)
        self.words = _word_hashes(low, self.starts, self.ends)
        self.hashes = K.RangeHash(self.words)(self.lo, self.hi) if len(self.lo) else none

    def checks(self) -> np.ndarray:
        """Second hashes of the lines: only lines of which both are equal count as equal."""
        return K.RangeHash(K.mix(self.words ^ K.U64(0x5851F42D4C957F2D)))(self.lo, self.hi) if len(self.lo) else self.hashes

    def chars(self) -> np.ndarray:
        """The lines' normalised lengths in characters, blanks between words included."""
        size = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        more = np.flatnonzero((self.low & 0xC0) == 0x80)  # bytes that go on with a character; only words have such
        within_ = np.searchsorted(more, self.ends[self.hi - 1]) - np.searchsorted(more, self.starts[self.lo])
        return size[self.hi] - size[self.lo] - within_ + self.hi - self.lo - 1

    def normalised(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes of all lines, a blank behind each word, and where each line starts and ends there."""
        keep = self.inside.copy()
        keep[1:] |= self.inside[:-1]
        flat = self.low[keep].tobytes().translate(_BLANKED)
        step = self.ends - self.starts
        step[:-1] += self.starts[1:] > self.ends[:-1]  # no byte is between the last word of a text and the first of the next
        place = np.cumsum(step) - step
        last = self.hi - 1
        return flat, place[self.lo], place[last] + self.ends[last] - self.starts[last]

    def sketches(self, lines: np.ndarray, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lines, fp, keys) by class of lengths: which of ``lines`` are in it, what stands for their lengths and grams, and their keys."""
        code = np.minimum(np.log(np.maximum(chars, 1)) / np.log(LENGTH_STEP), LENGTH_MASK).astype(K.U64)
        out = []
        flat, begin, end = self.normalised()
        for c in CLASSES:
            some = np.flatnonzero((chars >= c.least) & ((chars <= c.most) | (c.most == 0)))
            if not len(some):
                continue
            a, b = begin[lines[some]], end[lines[some]]
            own = np.frombuffer(b" ".join([flat[x:y] for x, y in zip(a.tolist(), b.tolist())]), dtype=np.uint8)
            last = np.cumsum(b - a + 1) - 1
            least = _minima(own, last - (b - a), last, c)
            band = K.U64(c.size << 32 | c.one_in << 16) + np.arange(c.bands, dtype=K.U64)
            keys = np.broadcast_to(band, (len(some), c.bands))
            for j in range(ROWS):
                keys = K.mix(keys + least[:, j : c.bands * ROWS : ROWS])
            bits = (K.mix(least[:, :BITS].astype(K.U64)) >> K.U64(40) & K.U64(1)) << np.arange(LENGTH_BITS, LENGTH_BITS + BITS, dtype=K.U64)
            out.append((lines[some], code[some] | np.bitwise_or.reduce(bits, axis=1), keys))
        return out

    def texts(self, lines: np.ndarray) -> list[str]:
        """The normalised texts of some lines."""
        raw = self.low.tobytes()
        spans = zip(self.starts[self.lo[lines]].tolist(), self.ends[self.hi[lines] - 1].tolist())
        return [b" ".join(raw[a:b].translate(_BLANKED).split()).decode("utf-8", "replace") for a, b in spans]


def _eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last."""
    flat = np.concatenate((flat, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(flat) - 7,), dtype="<u8", buffer=flat.data, strides=(1,))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    eight, size = _eights(low), ends - starts
    out = K.mix(size.astype(K.U64) * K.U64(0xD6E8FEB86659FD93) ^ (eight[starts] & _MASKS[np.minimum(size, 8)]))
    rest = np.flatnonzero(size > 8)
    k = 8
    while len(rest):  # eight bytes of each word that is so long
        at = starts[rest] + k
        out[rest] = K.mix(out[rest] ^ (eight[at] & _MASKS[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one range behind the other."""
    size = ends - starts
    return np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)


def _minima(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, c: Grams) -> np.ndarray:
    """For each of the lines, which stand in ``flat`` one behind the other with a byte between, the least values of its grams under hashes of their own."""
    n = max(BITS, c.bands * ROWS)
    seeds = K.mix(np.arange(1, 2 * n + 1, dtype=K.U64)).astype(np.uint32)
    bound = np.uint32((1 << 32) // c.one_in - 1)
    flat = np.concatenate((flat, np.zeros(9, dtype=np.uint8)))
    four = np.ndarray((len(flat) - 3,), dtype="<u4", buffer=flat.data, strides=(1,))  # the four bytes from each place on
    mask = np.uint32((1 << 8 * (c.size - 4)) - 1)
    out = np.empty((len(begin), n), dtype=np.uint32)
    i = 0
    while i < len(begin):  # so many grams at a time as stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(end, begin[i] + GRAMS_AT_ONCE * c.one_in)))
        at = begin[i:j] - begin[i]
        values = four[begin[i] : end[j - 1]] * np.uint32(0x9E3779B1)
        values ^= values >> np.uint32(15)
        values += (four[begin[i] + 4 : end[j - 1] + 4] & mask) * np.uint32(0x85EBCA77)
        values ^= values >> np.uint32(13)
        values *= np.uint32(0xC2B2AE3D)
        last = np.maximum(end[i:j] - begin[i] - c.size, at)
        for d in range(1, c.size + 1):  # no gram begins behind the last one: the line's first stands there again
            spot = last + d
            fits = spot < np.append(at[1:], len(values))
            values[spot[fits]] = values[at[fits]]
        if c.one_in > 1:  # which grams count depends on them alone; a line without any has its first
            counts = values <= bound
            counts[at] |= ~np.logical_or.reduceat(counts, at)
            some = np.flatnonzero(counts)
            values, at = values[some], np.searchsorted(some, at)
        made = np.empty_like(values)
        for k in range(n):
            np.bitwise_xor(values, seeds[2 * k], out=made)
            np.multiply(made, seeds[2 * k + 1] | np.uint32(1), out=made)
            out[i:j, k] = np.minimum.reduceat(made, at)
        i = j
    return out


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two lines' lengths and gram bits allow the similarity."""
    lengths = np.abs((x & LENGTH_MASK) - (y & LENGTH_MASK))
    return (lengths <= LENGTHS_APART) & (np.bitwise_count((x.view(np.uint64) ^ y.view(np.uint64)) >> K.U64(LENGTH_BITS)) <= BITS_APART)


_NEAR_SQL = f"abs((x.fp & {LENGTH_MASK}) - (y.fp & {LENGTH_MASK})) <= {LENGTHS_APART} and bit_count(shiftrightunsigned(x.fp ^ y.fp, {LENGTH_BITS})) <= {BITS_APART}"


class _Unseen:
    """Which of the hashes a task hasn't met; its memory is bounded, and forgetting only repeats work."""

    def __init__(self, most: int = 300_000):
        self.most, self.shown = most, set()

    def __call__(self, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keep = []
        for k, h in zip(places.tolist(), hashes[places].tolist()):
            if h not in self.shown:
                if len(self.shown) >= self.most:
                    self.shown.clear()
                self.shown.add(h)
                keep.append(k)
        return np.array(keep, dtype=np.int64)


def lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line, h, g, bands, sketches): for each line of enough words its two hashes, and for those of ``min_chars`` or more that are new to
    a task, in further rows without an id, their sketches (``_packed``), many in a row.  ``docs`` has doc_id and text."""
    names = ["doc_id", "line", "h", "g", "bands", "sketches"]

    def make():
        unseen = _Unseen()

        def work(part: pa.RecordBatch):
            x = Lines(*K.string_buffer(part.column(1)), min_words)
            if not len(x.row):
                return
            empty = [pa.nulls(len(x.row), pa.int32()), pa.nulls(len(x.row), pa.binary())]
            made = [pa.array(x.number.astype(np.int32)), pa.array(x.hashes.view(np.int64)), pa.array(x.checks().view(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(x.row)), *made, *empty], names)
            size = x.chars()
            new = unseen(np.flatnonzero(size >= min_chars), x.hashes)
            for line, fp, keys in x.sketches(new, size[new]) if len(new) else ():
                for i in range(0, len(line), PACKED):
                    none = [pa.nulls(1, t) for t in (part.column(0).type, pa.int32(), pa.int64(), pa.int64())]
                    some = _packed(x.hashes[line[i : i + PACKED]], fp[i : i + PACKED], keys[i : i + PACKED])
                    yield pa.RecordBatch.from_arrays([*none, pa.array([keys.shape[1]], pa.int32()), pa.array([some], pa.binary())], names)

        return work

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line int, h bigint, g bigint, bands int, sketches binary"
    return K.map_slices(docs, ["doc_id", "text"], "text", schema, make)


def _packed(h: np.ndarray, fp: np.ndarray, keys: np.ndarray) -> bytes:
    """Hashes, what stands for lengths and grams, and keys of some lines, as 64-bit numbers one behind the other."""
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (h, fp, keys))


def _entries(packed: bytes, bands: int) -> np.ndarray:
    """What ``_packed`` holds as rows (key, h, fp), one for each key of each line."""
    numbers = np.frombuffer(packed, dtype=np.int64)
    n = len(numbers) // (2 + bands)
    out = np.empty((n * bands, 3), dtype=np.int64)
    out[:, 0] = numbers[2 * n :]
    out[:, 1], out[:, 2] = (np.repeat(numbers[i * n : (i + 1) * n], bands) for i in (0, 1))
    return out


def _blocks(entries: np.ndarray) -> pa.RecordBatch:
    """(block, entries): the entries by the first bits of their keys, as bytes."""
    block = (entries[:, 0].view(K.U64) >> K.U64(64 - BLOCK_BITS)).astype(np.uint16)
    entries = entries[np.argsort(block, kind="stable")]
    size = np.bincount(block, minlength=1 << BLOCK_BITS)
    some = np.flatnonzero(size)
    ends = np.concatenate(([0], np.cumsum(size[some]))) * entries.itemsize * 3
    made = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries)])
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), made], ["block", "entries"])


def _dealt(sketched: DataFrame) -> DataFrame:
    """(block, entries) of the rows (bands, sketches)."""

    @K.tidied
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for bands, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(_entries(packed, bands))
                n += len(held[-1])
                if n >= DEALT:
                    yield _blocks(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield _blocks(np.concatenate(held))

    return sketched.mapInArrow(run, "block int, entries binary")


def _undivided(parts: Iterator[np.ndarray], bits: int, most: int) -> Iterator[np.ndarray]:
    """Entries that agree in the first ``bits`` of their keys, in pieces of some ``most`` entries that share no key, unless they hold that key only.  What is
    larger is split by the next bits, in files of the task's own."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n <= most:
            continue
        if bits < 64:
            break
        yield np.concatenate(held)
        held, n = [], 0
    if n > most:
        more = min(SPLIT_BITS, 64 - bits)
        with tempfile.TemporaryDirectory() as folder:
            names = [f"{folder}/{i}" for i in range(1 << more)]
            for part in itertools.chain(held, parts):
                which = part[:, 0].view(K.U64) << K.U64(bits) >> K.U64(64 - more)
                for i in np.unique(which).tolist():
                    with open(names[i], "ab") as file:
                        file.write(part[which == i].tobytes())
            held = []
            for name in names:
                yield from _undivided(_read(name, most), bits + more, most)
    elif held:
        yield np.concatenate(held)


def _read(name: str, most: int) -> Iterator[np.ndarray]:
    try:
        with open(name, "rb") as file:
            while some := file.read(24 * most):
                yield np.frombuffer(some, dtype=np.int64).reshape(-1, 3)
    except FileNotFoundError:  # no entry has these bits
        return


def _whole(rows: Iterator[tuple[int, np.ndarray]], enough: int = AT_ONCE, most: int = AT_MOST) -> Iterator[np.ndarray]:
    """Entries of (block, entries), sorted by block, some ``enough`` of them together: all of a key's behind one another, and no key in two pieces
    unless one holds that key only."""
    held, n = [], 0
    for _, some in itertools.groupby(rows, lambda x: x[0]):
        for part in _undivided((x for _, x in some), BLOCK_BITS, most):
            held.append(part)
            n += len(part)
            if n >= enough:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(h, norm) of lines whose hash is in ``wanted``; a bitmap keeps most others out of the shuffle.  Different lines of one hash are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve.bitmap(wanted, "h", wanted.count()))

    def make():
        bits, unseen = sent.value, _Unseen()

        def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
            x = Lines(*K.string_buffer(part.column(0)), min_words)
            checks = x.checks()
            keep = unseen(np.flatnonzero(sieve.passes(bits, x.hashes)), x.hashes ^ K.mix(checks))
            if not len(keep):
                return None
            made = [pa.array(x.hashes[keep].view(np.int64)), pa.array(checks[keep].view(np.int64)), pa.array(x.texts(keep), pa.string())]
            return pa.RecordBatch.from_arrays(made, ["h", "g", "norm"])

        return work

    found = K.map_slices(docs, ["text"], "text", "h bigint, g bigint, norm string", make).join(wanted, "h", "left_semi")
    return found.groupBy("h").agg(F.max("norm").alias("norm"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo = hi").select("h", "norm")


class _Buckets:
    """Goes through rows (key, h, fp) sorted by key, and gives the members of buckets of two lines or more, each beside the bucket's
    centre: a star, however large the bucket.  Only the open bucket's centre is kept.  Two lines alone that aren't near go.

    Which line is the centre, the first of its order in the batch where the bucket begins, doesn't matter for the groups in the end; an order of its own for half of the keys makes it another
    line in half of a group's buckets, so that lines far from one centre are near another.
    """

    ORDERS = K.mix(np.arange(1, 3, dtype=K.U64)).view(np.int64)

    def __init__(self):
        self.centre = [np.zeros(0, dtype=np.int64)] * 3
        self.shown = False

    def take(self, *columns: np.ndarray) -> pa.RecordBatch:
        was = len(self.centre[0])
        order = np.lexsort((columns[1] ^ self.ORDERS[columns[0] & 1], columns[0]))
        key, h, fp = (np.concatenate((a, b[order])) for a, b in zip(self.centre, columns))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(key)]))))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | ((h[1:] != h[:-1]) & (h[1:] != h[first[group[1:]]]))
        key, h, fp, group = key[new], h[new], fp[new], group[new]
        first = np.searchsorted(group, np.arange(len(first)))
        size = np.diff(np.concatenate((first, [len(key)])))
        out = size[group] > 1
        if was and self.shown:
            out[0] = False
        if len(first):
            at = first[-1]
            self.shown = bool(size[-1] > 1) or (self.shown and at == 0 and was > 0)
            self.centre = [x[at : at + 1] for x in (key, h, fp)]
        x = np.flatnonzero(out)
        centre = first[group[x]]
        close = (x != centre) & near(fp[x], fp[centre])
        whole = (size[group[x]] == 2) & (centre >= was) & (group[x] != len(first) - 1)  # a pair, not cut by the batch
        keep = ~whole | close | np.append(close[1:], False)[: len(x)]
        made = [key[x], h[x], fp[x], h[centre], close, ~whole]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in made], ["key", "h", "fp", "centre", "near", "more"])


def _meet(sketched: DataFrame) -> DataFrame:
    """(key, h, fp, centre, near, more) for the lines of (bands, sketches) that share a key with another; now and then a line stands in a bucket twice.
    ``more`` is false where the bucket surely holds two lines only.  Rows are dealt out by blocks of keys, thousands of entries in a row."""

    def rows(batches):
        for batch in batches:
            for block, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield block, np.frombuffer(entries, dtype=np.int64).reshape(-1, 3)

    @K.tidied
    def run(batches):
        walk = _Buckets()
        for entries in _whole(rows(batches)):
            yield walk.take(*entries.T)

    met = _dealt(sketched).repartition("block").sortWithinPartitions("block")
    return met.mapInArrow(run, "key bigint, h bigint, fp bigint, centre bigint, near boolean, more boolean")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that hold ``GATHERED`` bytes together: the more pairs, the more of a length can be compared side by side."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= GATHERED:
            yield some
            some, held = [], 0
    if some:
        yield some


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("na")), "a")
    both = with_a.join(texts.select(F.col("h").alias("b"), F.col("norm").alias("nb")), "b")

    @K.tidied
    def run(batches):
        for some in _gathered(batches):
            ok = similar_pairs([p for x in some for p in zip(x.column(2).to_pylist(), x.column(3).to_pylist())], similarity)
            at = 0
            for x in some:
                yield x.select(["a", "b"]).filter(pa.array(ok[at : at + x.num_rows]))
                at += x.num_rows

    return both.select("a", "b", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, h, fp, centre, near, root, main, n): the members of buckets that hold several groups; ``main`` is the centre's group, ``n`` the bucket's size."""
    some = members.where("more").drop("more")
    rooted = cut(some.join(roots.withColumnRenamed("node", "h"), "h", "left").select(*some.columns, F.coalesce("root", "h").alias("root")))
    mixed = rooted.groupBy("key").agg(
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("h") == F.col("centre"), F.col("root"))).alias("main"),
        F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("who"),
    )
    mixed = mixed.where("lo < hi and n > 2").groupBy("who", "n").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "k.main", "n")  # buckets of the same members: one
    return cut(join_back(rooted, cut(mixed), "key", "n", keep=True))


def _all_pairs(mixed: DataFrame, small: int) -> DataFrame:
    """Candidates (a, b) of different groups in buckets of up to ``small`` lines; the centre has been compared."""
    few = mixed.where((F.col("n") <= small) & (F.col("h") != F.col("centre"))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("h", "root", "fp"))).alias("m"))
    pair = f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {small}), y -> x.root != y.root and {_NEAR_SQL}), y -> named_struct('a', x.h, 'b', y.h))))"
    return few.select(F.explode(F.expr(pair)).alias("p")).select("p.a", "p.b")


def _links(h: np.ndarray, fp: np.ndarray, group: np.ndarray, side: np.ndarray | None, texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar lines, by their places, that connect what is similar among candidates of different groups; with ``side``, among those of different sides."""
    group, found = group.copy(), []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        apart = group[a] != group[b]
        a, b = a[apart], b[apart]
        ok = similar_pairs([(texts[x], texts[y]) for x, y in zip(a.tolist(), b.tolist())], similarity, plain=False)
        for x, y in zip(a[ok].tolist(), b[ok].tolist()):
            if group[x] != group[y]:
                group[group == group[y]] = group[x]
                found.append((x, y))

    waiting, n = [], 0
    for x in range(len(h) - 1):
        other = group[x + 1 :] != group[x]
        if side is not None:
            other &= side[x + 1 :] != side[x]
        y = np.flatnonzero(other & near(fp[x + 1 :], fp[x : x + 1])) + x + 1
        if len(y):
            waiting.append((np.full(len(y), x), y))
            n += len(y)
        if n >= PAIRS_AT_ONCE:
            compare(*map(np.concatenate, zip(*waiting)))
            waiting, n = [], 0
    if n:
        compare(*map(np.concatenate, zip(*waiting)))
    return found


def _cells(crowded: DataFrame, texts: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Verified links (a, b) inside crowded buckets (key, h, fp, root, n), cell by cell: all candidates of different groups are compared."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = crowded.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "h", "fp", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "h", "fp", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(texts, "h")

    def link(table: pa.Table) -> pa.Table:
        h, at = np.unique(table["h"].to_numpy(), return_index=True)  # a line may stand in a bucket twice
        fp, root, own = (table[c].to_numpy()[at] for c in ("fp", "root", "own"))
        side = own if len(own) and own.min() != own.max() else None
        pairs = _links(h, fp, root, side, table["norm"].combine_chunks().take(pa.array(at)).to_pylist(), similarity)
        return pa.table({"a": pa.array([h[x] for x, _ in pairs], pa.int64()), "b": pa.array([h[y] for _, y in pairs], pa.int64())})

    # Cells are few bytes but much work: a number of partitions that is asked for isn't made smaller by the size of what they hold.
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(link, "a bigint, b bigint")


def _left_apart(members: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, small: int, chunk: int) -> DataFrame:
    """Verified links (a, b) in buckets that hold several groups yet: all candidates there of different groups are compared."""
    mixed = _mixed(members, roots)
    pairs = _verified(_all_pairs(mixed, small).distinct(), texts, similarity)
    return pairs.unionByName(_cells(mixed.where(F.col("n") > small).select("key", "h", "fp", "root", "n"), texts, similarity, chunk))


def _star(members: DataFrame) -> DataFrame:
    return members.where("near").select(F.least("centre", "h").alias("a"), F.greatest("centre", "h").alias("b"))


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, small: int = SMALL, min_chars: int = MIN_CHARS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line) of the lines that are not their group's first occurrence; ``docs`` has doc_id and text."""
    read = cut(lines(docs, min_words, min_chars))
    found, sketched = read.where("sketches is null").select("doc_id", "line", "h", "g"), read.where("sketches is not null").select("bands", "sketches")
    members = cut(_meet(sketched))
    release(docs.sparkSession)
    texts = cut(_texts(docs, cut(members.select("h").distinct()), min_words))
    roots = components(_verified(_star(members).distinct(), texts, similarity))
    links = cut(_left_apart(members, texts, roots, similarity, small, chunk))
    if not links.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    release(docs.sparkSession)
    # Only lines that occur more than once or are linked can be removed.  Different lines of one hash have no links: their second hash keeps them apart.
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "h")
    often = found.groupBy("h", "g").agg(F.count("*").alias("n")).join(linked, "h", "left").where("n > 1 or root is not null")
    group = [F.coalesce("root", "h").alias("group"), F.when(F.col("root").isNull(), F.col("g")).otherwise(0).alias("own")]
    some = cut(join_back(found, cut(often.select("h", "g", "n", *group)), ["h", "g"], "n").select("doc_id", "line", "group", "own"))
    firsts = cut(some.groupBy("group", "own").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("stays")))
    return join_back(some, firsts, ["group", "own"], "n").where(~F.struct("doc_id", "line").eqNullSafe(F.col("stays"))).select("doc_id", "line")


def _with_removed(docs: DataFrame, gone: DataFrame, place: int) -> DataFrame:
    """``docs``, its columns numbered so that no name clashes, with the removed lines of each; the id is in the column ``place``.  The
    removed lines are broadcast if they are ``FEW`` at most, and texts are dealt out only beyond that."""
    gone = cut(gone)
    lost = gone.groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    lost = F.broadcast(lost) if gone.count() <= FEW else lost
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.join(lost, F.col(f"c{place}").eqNullSafe(F.col("doc_id")), "left").drop("doc_id")


def _remaining(text: str | None, gone: list[int] | None) -> str | None:
    if not gone:
        return text
    drop = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **options) -> DataFrame:
    """One row for each document: lines, removed lines, the text that is left (unless ``with_text`` is false) and its digest."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = _with_removed(narrow, line_groups(narrow, **options), 0)

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts, gone = part.column(1).to_pylist(), part.column(2).to_pylist()
            left = [_remaining(t, g) or "" for t, g in zip(texts, gone)]
            made = [
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                pa.array([len(set(g)) if g else 0 for g in gone], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in left], pa.string()),
            ]
            return pa.RecordBatch.from_arrays([part.column(0), *made, *([pa.array(left, pa.string())] * with_text)], names)

        return work

    names = ["doc_id", "n_lines", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_lines bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return K.map_slices(joined, ["c0", "c1", "gone"], "c1", schema, make)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with texts cut; documents of which no word is left go, if they lost a line."""
    names = docs.columns
    place = names.index(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = _with_removed(docs, line_groups(narrow, **options), names.index(id_col))
    schema = docs.schema

    @K.tidied
    def run(batches):
        for batch in batches:
            gone = batch.column(len(names)).to_pylist()
            texts = [_remaining(t, g) for t, g in zip(batch.column(place).to_pylist(), gone)]
            keep = [not g or bool(t.split()) for t, g in zip(texts, gone)]
            columns = [pa.array(texts, batch.column(place).type) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    K.small_batches(docs)
    return joined.mapInArrow(run, schema)
