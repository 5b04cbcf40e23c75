"""Windows that occur more than once in a corpus: the frame of the two exact deduplications.

First pass: every document's regions (see ``windows``) give anchors, which are counted with
the least and the greatest hash of their regions' contents.  Anchors of one region are
done.  Bitmaps of bounded size keep those met again, and those met with different contents.

Second pass: regions of repeated anchors are dealt out by anchor.  Regions of equal
contents repeat each other in all their windows.  A task that meets a content again knows
at once that the later place is covered, and sends joined spans under keys of their own in
its stead: of a content, however frequent, few rows a task meet under its anchor.  Where contents differ, one region of
each content goes to ``compare``, which finds the windows that they share.  A content is
sent once from each task, and only for anchors that need it.

Contents that share an anchor are cut first to what can still match: hashes of their
surroundings, in steps, show how far each agrees with any other.  An anchor with more
than ``MANY`` contents is compared by hashes of its windows instead, in numpy, so
that its cost stays in proportion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sieve
from . import windows as W
from .quality_rules import repeated
from .storage import cut

MANY = 2048
BATCH_UNITS = 48_000
STEP = 4
REMEMBERED = 300_000


class Kind(NamedTuple):
    """Units of a text: ``units(buf, offsets)`` gives their hashes, first and last bytes, and units before each document."""

    window: int
    gram: int
    units: Callable
    first_counts: bool  # whether the first of equal windows is covered too
    compare: Callable  # symbols of several contents -> covered window starts


def byte_units(buf: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(buf))
    return K.BYTE_VALUE[buf], at, at + 1, offsets


def word_units(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, first = K.find_words(buf, offsets, ~K.SPACE)
    hashes = K.RangeHash(K.BYTE_VALUE[buf])(starts, ends) if len(starts) else np.zeros(0, dtype=K.U64)
    return hashes, starts, ends, first


class Content(NamedTuple):
    """One content of an anchor: unit hashes, place of the anchor in it, and the place of its first occurrence in order."""

    hashes: np.ndarray
    at: int
    rank: tuple
    row: int


def _cut_to_shared(contents: list[Content], kind: Kind) -> list[tuple[int, int]]:
    """For each content the part that others of its anchor may share; (0, 0) where no window can be shared."""
    flat = np.concatenate([c.hashes for c in contents])
    length = np.array([len(c.hashes) for c in contents])
    begin = np.cumsum(length) - length
    at = begin + np.array([c.at for c in contents])
    after = at + kind.gram
    right, left = begin + length - after, at - begin
    ranged = K.RangeHash(flat)
    anchor = ranged(at, after)
    reach = []
    for size, side in ((right, 1), (left, 0)):
        most = np.zeros(len(contents), dtype=np.int64)
        alive = np.arange(len(contents))
        level = 0
        while len(alive):
            level += STEP
            alive = alive[size[alive] >= level]
            if side:
                keys = ranged(after[alive], after[alive] + level)
            else:
                keys = ranged(at[alive] - level, at[alive])
            alive = alive[repeated(keys ^ anchor[alive])]
            most[alive] = level
        reach.append(np.minimum(size, most + STEP - 1))
    right, left = reach
    keep = left + right + kind.gram >= kind.window
    a, b = at - left - begin, after + right - begin
    return [(int(x), int(y)) if k else (0, 0) for x, y, k in zip(a, b, keep)]


def _by_windows(contents: list[Content], kind: Kind) -> dict[int, list[tuple[int, int]]]:
    """Covered windows of many contents of one anchor, by the windows' own hashes."""
    hashes, owner, start = [], [], []
    order = {c.row: i for i, c in enumerate(sorted(contents, key=lambda c: c.rank))}
    for c in contents:
        lo = np.arange(len(c.hashes) - kind.window + 1)
        hashes.append(K.RangeHash(c.hashes)(lo, lo + kind.window))
        owner.append(np.full(len(lo), order[c.row]))
        start.append(lo)
    h, o, s = np.concatenate(hashes), np.concatenate(owner), np.concatenate(start)
    by = np.lexsort((o, h))
    same = np.zeros(len(h), dtype=bool)
    same[by[1:]] = h[by[1:]] == h[by[:-1]]
    if kind.first_counts:
        same[by[:-1]] |= h[by[1:]] == h[by[:-1]]
    rows = {i: row for row, i in order.items()}
    out: dict[int, list[tuple[int, int]]] = {}
    for i, lo in zip(o[same].tolist(), s[same].tolist()):
        out.setdefault(rows[i], []).append((lo, lo + kind.window))
    return out


def _compare_groups(groups: list[list[Content]], kind: Kind) -> dict[int, list[tuple[int, int]]]:
    """Covered parts, by row, of contents that share anchors.

    Symbols are ranks of unit hashes; an anchor is one symbol, so windows of ``window``
    units are ``window - gram + 1`` symbols and hold an anchor each.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    few = []
    for g in groups:
        if len(g) > MANY:
            out |= _by_windows(g, kind)
        else:
            few.append(g)
    contents = [c for g in few for c in g]
    if not contents:
        return out
    parts = _cut_to_shared(contents, kind)
    used, symbols, ranks = [], [], []
    for c, (a, b) in zip(contents, parts):
        if b > a:
            used.append((c, a))
            symbols.append(np.concatenate((c.hashes[a : c.at], K.RangeHash(c.hashes)(np.array([c.at]), np.array([c.at + kind.gram])), c.hashes[c.at + kind.gram : b])))
            ranks.append(c.rank)
    if not used:
        return out
    order = {i: r for r, i in enumerate(sorted(range(len(ranks)), key=ranks.__getitem__))}
    found = kind.compare(symbols, [order[i] for i in range(len(used))], kind.window - kind.gram + 1)
    for (c, a), starts in zip(used, found):
        if starts:
            out[c.row] = [(a + s, a + s + kind.window) for s in starts]
    return out


def covered(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, lo, hi): parts of documents, in units, that repeated windows cover.  ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def counted():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            units, _, _, first = kind.units(*K.string_buffer(part.column(0)))
            r = W.regions(units, first, kind.window, kind.gram)
            return pa.RecordBatch.from_arrays([pa.array(r.anchor.view(np.int64)), pa.array(r.content.view(np.int64))], ["anchor", "content"])

        return work

    anchors = K.map_slices(docs, ["text"], "text", "anchor bigint, content bigint", counted)
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).where("n > 1")
    again = cut(again.select("anchor", (F.col("a") != F.col("b")).alias("mixed")))
    n, n_mixed = again.agg(F.count("*"), F.coalesce(F.sum(F.col("mixed").cast("bigint")), F.lit(0))).first()
    sent = spark.sparkContext.broadcast((sieve.bitmap(again, "anchor", n), sieve.bitmap(again.where("mixed"), "anchor", n_mixed)))
    columns = ["anchor", "content", "doc_id", "at", "lo", "hi", "text"]

    def occurrences():
        some, mixed = sent.value
        seen: dict[tuple[int, int], list] = {}

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offsets = K.string_buffer(part.column(1))
            units, starts, ends, first = kind.units(buf, offsets)
            r = W.regions(units, first, kind.window, kind.gram)
            keep = np.flatnonzero(sieve.passes(some, r.anchor))
            need = sieve.passes(mixed, r.anchor[keep]).tolist()
            ids = part.column(0).to_pylist()
            raw = buf.tobytes()
            base = first[r.doc]
            at, lo, hi = r.at - base, r.lo - base, r.hi - base
            shown: list[int] = []
            texts: list[bytes | None] = []
            sure: dict[int, list[tuple[int, int]]] = {}
            places = zip(keep.tolist(), r.anchor[keep].tolist(), r.content[keep].tolist(), r.doc[keep].tolist(), at[keep].tolist(), need)
            for k, anchor, content, doc, spot, differs in places:
                rank = (ids[doc] is not None, ids[doc], spot)
                before = seen.get((anchor, content))
                if before is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[anchor, content] = [rank, 1]
                    texts.append(raw[starts[r.lo[k]] : ends[r.hi[k] - 1]] if differs else None)
                    shown.append(k)
                    continue
                before[1] += 1
                if rank[:1] < before[0][:1] or (rank[0] == before[0][0] and rank[1:] < before[0][1:] if rank[0] else rank[2] < before[0][2]):
                    before[0] = rank
                elif before[1] > 2 or not kind.first_counts:
                    sure.setdefault(doc, []).append((int(lo[k]), int(hi[k])))
                    continue
                texts.append(None)
                shown.append(k)
            rows = np.array(shown, dtype=np.int64)
            spans = [(doc, a, b) for doc, found in sure.items() for a, b in _joined(found)]
            done = len(spans)
            spread = r.content[r.doc.searchsorted([s[0] for s in spans])] if done else np.zeros(0, dtype=np.uint64)
            numbers = lambda x, own: pa.array(np.concatenate([x[rows], np.array(own, dtype=np.int64)]).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([r.anchor[rows], spread]).view(np.int64)),
                    pa.array(np.concatenate([r.content[rows], spread]).view(np.int64), mask=np.arange(len(rows) + done) >= len(rows)),
                    part.column(0).take(pa.array(np.concatenate([r.doc[rows], np.array([s[0] for s in spans], dtype=np.int64)]).astype(np.int64))),
                    numbers(at, [0] * done),
                    numbers(lo, [s[1] for s in spans]),
                    numbers(hi, [s[2] for s in spans]),
                    pa.array(texts + [None] * done, pa.binary()),
                ],
                columns,
            )

        return work

    schema = f"anchor bigint, content bigint, doc_id {id_type}, at bigint, lo bigint, hi bigint, text binary"
    dealt = K.map_slices(docs, ["doc_id", "text"], "text", schema, occurrences)
    dealt = dealt.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(kind)
        for batch in batches:
            yield from walk.take(batch)
        yield from walk.finish()

    return dealt.mapInArrow(compare, f"doc_id {id_type}, lo bigint, hi bigint")


class _Walk:
    """Goes through occurrences sorted by anchor, content and place; keeps one content of each kind of the anchors at hand."""

    def __init__(self, kind: Kind):
        self.kind = kind
        self.anchor = self.content = None
        self.same: list | None = None  # first row of the content at hand: doc_id, at, lo, hi, text, number of rows
        self.contents: list[list] = []  # of the anchor at hand
        self.groups: list[list[list]] = []
        self.units = 0
        self.out: tuple[list, list, list] = ([], [], [])

    def _put(self, doc, lo, hi) -> None:
        self.out[0].append(doc)
        self.out[1].append(lo)
        self.out[2].append(hi)

    def _end_content(self) -> None:
        if self.same is not None:
            self.contents.append(self.same)
            if self.kind.first_counts and self.same[5] > 1:
                self._put(self.same[0], self.same[2], self.same[3])
        self.same = None

    def _end_anchor(self) -> None:
        self._end_content()
        if len(self.contents) > 1:
            self.groups.append(self.contents)
            self.units += sum(c[3] - c[2] for c in self.contents)
        self.contents = []

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.schema = batch.schema
        columns = [c.to_pylist() for c in batch.columns]
        for anchor, content, doc, at, lo, hi, text in zip(*columns):
            if content is None:  # known to be covered where it was found
                self._put(doc, lo, hi)
                continue
            if anchor != self.anchor:
                self._end_anchor()
                self.anchor, self.content = anchor, None
            if content != self.content:
                self._end_content()
                self.content = content
                self.same = [doc, at, lo, hi, text, 1]
            else:
                self.same[5] += 1
                if self.same[4] is None:
                    self.same[4] = text
                self._put(doc, lo, hi)
            if self.units >= BATCH_UNITS:
                self._flush_groups()
        yield from self._emit(4096)

    def _flush_groups(self) -> None:
        groups, rows = [], []
        for g in self.groups:
            made = []
            for c in g:
                buf = np.frombuffer(c[4], dtype=np.uint8)
                hashes = self.kind.units(buf, np.array([0, len(buf)]))[0]
                made.append(Content(hashes, c[1] - c[2], (c[0] is not None, c[0], c[1]), len(rows)))
                rows.append(c)
            groups.append(made)
        for row, spans in _compare_groups(groups, self.kind).items():
            doc, _, base = rows[row][:3]
            for lo, hi in _joined(spans):
                self._put(doc, base + lo, base + hi)
        self.groups, self.units = [], 0

    def _emit(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out[0]) >= least:
            doc, lo, hi = self.out
            self.out = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(doc, self.schema.field("doc_id").type), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "lo", "hi"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._end_anchor()
        self._flush_groups()
        yield from self._emit(1)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the spans of each: every span list belongs to one document, and is bounded by it."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("doc_id", "d")
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "spans")


def span_mask(spans: pa.Array, row: int, n: int) -> np.ndarray | None:
    value = spans[row]
    if not value.is_valid:
        return None
    pairs = value.values
    lo = pairs.field(0).to_numpy(zero_copy_only=False)
    hi = pairs.field(1).to_numpy(zero_copy_only=False)
    return K.union_lengths(lo, hi, n)
