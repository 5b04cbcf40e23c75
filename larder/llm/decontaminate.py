"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds word sequences of the normalised items.  Training documents
stream past it: at each word it gives the longest suffix that is a substring of
an item.  Once that reaches the window length, the words of the window are hit.
Words of an item shorter than a window are hit where the whole item occurs.

A vectorised filter goes first and loses nothing: only runs of words whose
neighbouring pairs all occur in items can reach a window, so only those runs walk
the automaton.

Defined results: a null or empty text has no words and no hits; a null or wordless
item has no window; equal items all count; items without an id hit like any other, count as one item together and
have no place in the list of ids; rows that repeat are judged alone, and
columns besides the two that are named pass through ``decontaminate`` untouched, whatever their names; an empty
table gives no rows.
Items of more than ``shard_bytes`` together are dealt into several automata, each with
a pass of its own over what the pass before it wrote to the checkpoint folder: so a worker never holds more than one
automaton, of about 2 * ``shard_bytes`` / 6 states, and keeps it for all its tasks.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .automaton import SuffixAutomaton
from .storage import cut

WINDOW = 13
SHARD_BYTES = 2 << 20
_ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = True
_WORD_BYTE[0x80:] = True

SPANS = "array<struct<lo:bigint,hi:bigint>>"
WORDS, SPOTS, ITEMS = "__words", "__spots", "__items"


def item_words(text: str | None) -> list[bytes]:
    return _ITEM_WORD.findall((text or "").encode("utf-8", "replace").lower())


class ItemIndex:
    """One automaton with what each of its states says about windows and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        ids = self.vocabulary
        sequences = [(name, [ids.setdefault(w, len(ids)) for w in item_words(text)]) for name, text in items]
        sequences = [(name, s) for name, s in sequences if s]
        for _, s in sequences:
            self.automaton.add(s)
        a = self.automaton
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        self.windows: dict[int, set[str]] = defaultdict(set)
        whole: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, s in sequences:
            if len(s) < window:
                whole[a.locate(s)][len(s)].add(name)
                continue
            state = 0
            for i, symbol in enumerate(s):
                state = a.next[state][symbol]
                if i + 1 >= window:
                    self.windows[self._at(a.locate(s[i + 1 - window : i + 1]), window)].add(name)
        # Short items that end where a state's strings end, longest first: its own and those up its links.
        self.whole: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(a.next)
        for state in sorted(range(len(a.next)), key=a.length.__getitem__):
            own = tuple((n, frozenset(names)) for n, names in sorted(whole[state].items(), reverse=True)) if state in whole else ()
            self.whole[state] = own + (self.whole[a.link[state]] if state else ())
        pairs = {(x, y) for _, s in sequences for x, y in zip(s, s[1:])}
        words = list(ids)
        buf = np.frombuffer(b" ".join(words), dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        hashes = K.RangeHash(K.BYTE_VALUE[buf])(starts, starts + lengths)
        order = np.argsort(hashes)
        self.word_hashes, self.word_ids = hashes[order], order.astype(np.int64)
        self.pairs = np.array(sorted((x << 32) | y for x, y in pairs), dtype=np.int64)

    def _at(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        a = self.automaton
        while state and a.length[a.link[state]] >= length:
            state = a.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit intervals in a run of words, and the items whose windows occur there."""
        spans, found = [], set()
        get = self.vocabulary.get
        for i, (state, length) in enumerate(self.automaton.matching(get(w, -1) for w in words)):
            if not length:
                continue
            if length >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found |= self.windows[self._at(state, self.window)]
            fits = [(n, names) for n, names in self.whole[state] if n <= length]
            if fits:
                spans.append((i + 1 - fits[0][0], i + 1))
                for _, names in fits:
                    found |= names
        return spans, found

    def hits(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """For each document of a slice: words, hit words, united spans (word numbers), items."""
        low = K.LOWER[buf]
        starts, ends, first = K.find_words(low, offsets, _WORD_BYTE)
        counts = np.diff(first)
        out = [(int(n), 0, [], []) for n in counts]
        if not len(starts) or not len(self.word_hashes):
            return out
        hashes = K.RangeHash(K.BYTE_VALUE[low])(starts, ends)
        at = np.minimum(np.searchsorted(self.word_hashes, hashes), len(self.word_hashes) - 1)
        ids = np.where(self.word_hashes[at] == hashes, self.word_ids[at], -1)
        joined = np.zeros(len(ids), dtype=bool)  # joined[i]: words i and i + 1 stand together in an item
        if len(self.pairs) and len(ids) > 1:
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            pair = (ids[both] << 32) | ids[both + 1]
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[near] == pair]] = True
            joined[first[1:-1][(first[1:-1] > 0)] - 1] = False
        if self.shortest > 1:
            lo, hi = K.runs_of(joined)
            keep = hi - lo + 1 >= self.shortest
            lo, hi = lo[keep], hi[keep] + 1
        else:
            lo, hi = K.runs_of(ids >= 0)
            cuts = np.unique(np.concatenate([lo, first[1:-1][(ids[np.minimum(first[1:-1], len(ids) - 1)] >= 0)]]))
            hi = np.minimum(hi[np.searchsorted(hi, cuts, side="right").clip(max=len(hi) - 1)], first[np.searchsorted(first, cuts, side="right")])
            lo = cuts
        raw = low.tobytes()
        gathered: dict[int, tuple[list, set]] = {}
        for s, e in zip(lo.tolist(), hi.tolist()):
            spans, found = self.scan([raw[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist())])
            if spans:
                doc = int(np.searchsorted(first, s, side="right")) - 1
                kept, names = gathered.setdefault(doc, ([], set()))
                kept += [(x + s - int(first[doc]), y + s - int(first[doc])) for x, y in spans]
                names |= found
        for doc, (spans, names) in gathered.items():
            n = int(counts[doc])
            x, y = np.array(spans, dtype=np.int64).T
            mask = K.union_lengths(x, y, n)
            out[doc] = (n, int(mask.sum()), [(int(p), int(q)) for p, q in zip(*K.runs_of(mask))], _ordered(names))
        return out


def _ordered(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def _shards(items: DataFrame, item_id: str, text: str, shard_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items dealt by hash into lists of about ``shard_bytes``, read one at a time; one empty list where there are none."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    dealt = F.pmod(F.xxhash64("t", F.lit("shard")), F.lit(n))
    for k in range(n):
        yield sorted(((r.i, r.t) for r in rows.where(dealt == k).collect()), key=repr)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row for each document: its word count, hit words, hit spans in word numbers, and items."""
    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).toDF("c0", "c1")
    found = _hits(found, items, "c1", item_id, item_text, window, shard_bytes, keep_text=False).withColumnRenamed("c0", "doc_id")
    merged = F.expr(
        f"aggregate(array_sort({SPOTS}), cast(array() as {SPANS}), (acc, s) -> "
        "if(size(acc) > 0 and element_at(acc, -1).hi >= s.lo, concat(slice(acc, 1, size(acc) - 1), "
        "array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, s.hi)))), concat(acc, array(s))))"
    )
    spans = F.when(F.size(SPOTS) == 0, F.col(SPOTS)).otherwise(merged)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.hi - s.lo)")
    return found.select("doc_id", F.col(WORDS).alias("n_words"), spans.alias("spans"), F.col(ITEMS).alias("items")).select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _hits(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, shard_bytes: int, keep_text: bool, then: Callable | None = None, schema: StructType | None = None) -> DataFrame:
    """``docs``, whose columns are c0, c1 and so on, with the numbers of words, hit spans and items of each row: a pass for each automaton,
    which adds to what the passes before it found. Without ``keep_text`` the last pass leaves the text out; with ``then`` it gives what that makes
    of each batch, of the given schema, in the same worker."""
    spark = docs.sparkSession
    for name, kind in ((WORDS, "bigint"), (SPOTS, SPANS), (ITEMS, "array<string>")):
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    shards = _shards(items, item_id, item_text, shard_bytes)
    ahead = next(shards)
    while ahead is not None:
        shard, ahead = ahead, next(shards, None)
        last = ahead is None
        docs = _pass(docs, spark.sparkContext.broadcast(shard), text_col, window, keep_text or not last, then if last else None, schema)
        if not last:  # or the workers of all passes would live at once
            docs = cut(docs)
    return docs


def _pass(docs: DataFrame, sent: Broadcast, text_col: str, window: int, keep_text: bool, then: Callable | None, given: StructType | None) -> DataFrame:
    names = docs.columns
    place, own = names.index(text_col), len(names) - 3
    out = [i for i in range(own) if keep_text or i != place]
    schema = StructType([docs.schema.fields[i] for i in [*out, own, own + 1, own + 2]])
    key = uuid.uuid4().hex

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = K.kept(key, lambda: ItemIndex(sent.value, window))
        for batch in batches:
            for part in K.slices(batch, text_col):
                found = index.hits(*K.string_buffer(part.column(place)))
                spans = [(old or []) + [{"lo": a, "hi": b} for a, b in x[2]] for old, x in zip(part.column(own + 1).to_pylist(), found)]
                texts = [_ordered({*(old or []), *x[3]}) for old, x in zip(part.column(own + 2).to_pylist(), found)]
                made = [pa.array([x[0] for x in found], pa.int64()), pa.array(spans, part.column(own + 1).type), pa.array(texts, part.column(own + 2).type)]
                done = pa.RecordBatch.from_arrays([*(part.column(i) for i in out), *made], schema.names)
                yield then(done) if then else done

    K.small_batches(docs)
    return docs.mapInArrow(run, given if then else schema)


def contaminated(n_words: Column, n_hit: Column, percent: int = 5) -> Column:
    """The rule: at least one hit word, and hit words are at least ``percent`` of all."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    percent: int = 5,
) -> DataFrame:
    """Drop documents beyond the coverage limit and cut hit spans out of the others.

    All columns stay, and nothing is shuffled or joined: rows that share an id are judged each.  A text without hits is returned byte for byte; in others each
    span is cut from its first word to its last, and what stood around it is kept.
    """
    names = docs.columns
    place = names.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def cut_out(part: pa.RecordBatch) -> pa.RecordBatch:
        keep: list[int] = []
        texts = part.column(place)
        left: dict[int, str] = {}
        for row, spans in enumerate(part.column(len(names) + 1).to_pylist()):
            if spans:
                text = np.frombuffer(texts[row].as_py().encode("utf-8", "replace"), dtype=np.uint8)
                starts, ends, _ = K.find_words(K.LOWER[text], np.array([0, len(text)]), _WORD_BYTE)
                mask = K.union_lengths(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]), len(starts))
                if int(mask.sum()) * 100 >= len(starts) * percent:
                    continue
                left[row] = _without(text.tobytes(), starts, ends, mask)
            keep.append(row)
        if left:
            texts = pa.array([left[i] if i in left else texts[i].as_py() for i in range(part.num_rows)], texts.type)
        columns = [texts if i == place else part.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names).take(pa.array(keep, pa.int64()))

    return _hits(plain, items, f"c{place}", item_id, item_text, window, SHARD_BYTES, keep_text=True, then=cut_out, schema=docs.schema)


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    out, at = [], 0
    for lo, hi in zip(*K.runs_of(mask)):
        out.append(raw[at : starts[lo]])
        at = int(ends[hi - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


__all__ = ["ItemIndex", "benchmark_hits", "contaminated", "decontaminate", "items_digest", "item_words"]
