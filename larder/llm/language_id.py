"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled reference text.  A text is parsed
greedily into phrases, each the longest match that goes on from where the last ended;
the language that needs the fewest phrases, normalised by the text's length and by the
logarithm of the reference's, wins.

Texts are read as the UTF-8 bytes of their letters in lower case, with one blank for whatever stands
between two runs of letters; so letters of every script count.  The automata become transition tables over the
bytes that their reference has (any other byte is a phrase of its own), and many blocks of text are parsed in
lockstep, one byte of each at a time.  Each block is parsed as if it began a text; then the state that
the block before really ends in goes on into it until both parses are in one state, from where on they agree.  That is
repeated until no block's end changes, so that phrases run across blocks and long texts are parsed as short ones are.

Reference texts are a bounded sample: for each language whole texts in the order of a hash of id and text, from rows that
aren't held out, until ``reference_chars`` characters; only the last one is cut, at the bound.  Equal rows count once.
Predictions see the text alone.

Defined results: a null text or one without letters is ``und`` with score 0; no usable
labelled row leaves every text ``und``; equal phrase counts go to the first language by
code point; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from copy import copy
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .automaton import SuffixAutomaton

REFERENCE_CHARS = 60_000
BLOCK = 512
MOVES_AT_ONCE = 1 << 14
UNKNOWN = "und"
_NEW = np.int32(1 << 30)
_GRAIN = 1 << 24


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 0, F.lit(True))


def reference_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, reference_chars: int) -> dict[str, str]:
    """Texts of ``reference_chars`` characters for each label (all it has, if it has fewer): what is collected is bounded by that and the number of labels."""
    text = F.substring(F.col(text_col).cast("string"), 1, reference_chars)  # more of one text is never used
    usable = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), text.alias("text"))
    held = {r.lang: r.n for r in usable.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect() if r.n}
    share = {lang: min(_GRAIN, math.ceil(_GRAIN * 4 * reference_chars / n)) for lang, n in held.items()}
    out: dict[str, str] = {}
    while share:
        bound = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
        some = usable.where(F.col("lang").isin(*share) & (F.pmod("h", F.lit(_GRAIN)) < bound)).groupBy("lang", "h").agg(F.max("text").alias("text"))
        texts: dict[str, list[str]] = {lang: [] for lang in share}
        for r in sorted(some.collect(), key=lambda r: (r.h % _GRAIN, r.h, r.text)):
            texts[r.lang].append(r.text)
        for lang, found in texts.items():
            out[lang] = "\n".join(found)[:reference_chars]
        # A label of few different rows, or of unlucky hashes, has too little yet: take more of it.
        share = {lang: min(_GRAIN, 16 * n) for lang, n in share.items() if len(out[lang]) < reference_chars and n < _GRAIN}
    return {lang: out[lang] for lang in sorted(out)}


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_bytes(text: str) -> bytes:
    """The letters of a text in lower case, with one blank for whatever stands behind a run of them; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return b""
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 0x20)[keep].astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")


class CrossParser:
    """Transition tables of all languages' automata in one array.

    The automata are built on the driver, from the bounded sample, and sent as their transitions; a task unpacks the table, some 15 MB for each language.
    """

    def __init__(self, references: dict[str, str], block: int = BLOCK):
        self.block = block
        self.languages, self.columns, self.roots, self.bits, self.packed = [], [], [], [], []
        at = 0
        for lang, text in references.items():
            read = letter_bytes(text)
            if not read:
                continue
            present = sorted(set(read))
            column = np.zeros(257, dtype=np.int32)  # 0: bytes that the reference hasn't
            column[present] = np.arange(1, len(present) + 1)
            column[256] = len(present) + 1  # behind a text's end
            a, width = SuffixAutomaton([column[np.frombuffer(read, dtype=np.uint8)].tolist()]), len(present) + 2
            moves = np.array([(state, symbol, to) for state, found in enumerate(a.next) for symbol, to in found.items()], dtype=np.int32)
            self.languages.append(lang)
            self.columns.append(column)
            self.roots.append(np.int32(at))
            self.bits.append(math.log2(len(read) + 2))
            self.packed.append((len(a.next), width, moves))
            at += len(a.next) * width
        self.table = None

    def unpacked(self) -> CrossParser:
        """A parser with its table, which is made in its place: workers have no room for a second copy."""
        out = copy(self)
        if self.packed:
            out.table = np.empty(sum(states * width for states, width, _ in self.packed), dtype=np.int32)
            for (states, width, moves), at in zip(self.packed, self.roots):
                self._fill(out.table[at : at + states * width].reshape(states, width), moves, int(at))
        return out

    @staticmethod
    def _fill(table: np.ndarray, moves: np.ndarray, at: int) -> None:
        """For each state and symbol the next state (as the place of its row in the whole table) and whether a phrase begins."""
        state, symbol, to = moves.T
        width = table.shape[1]
        root = np.full(width, at, dtype=np.int32)
        first = state == 0
        root[symbol[first]] = at + to[first] * np.int32(width)
        table[:] = root | _NEW
        for i in range(0, len(moves), MOVES_AT_ONCE):
            state, symbol, to = moves[i : i + MOVES_AT_ONCE].T
            inner = state > 0
            table[state[inner], symbol[inner]] = at + to[inner] * np.int32(width)
        table[:, width - 1] = at

    def _phrases(self, language: int, columns: np.ndarray, alive: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases of each block; ``columns[t]`` holds every block's byte number t, ``follows[b]`` the block before b or -1."""
        column, root, table = self.columns[language], self.roots[language], self.table
        state = np.full(columns.shape[1], root, dtype=np.int32)
        count = np.zeros(columns.shape[1], dtype=np.int64)
        for t in range(self.block):
            n = int(alive[t])
            if not n:
                break
            step = table[state[:n] + column[columns[t, :n]]]
            count[:n] += step >> 30
            np.bitwise_and(step, _NEW - 1, out=state[:n])
        begin = np.full(len(state), root, dtype=np.int32)  # the state that each block was parsed from
        todo = np.flatnonzero(follows >= 0)
        while len(todo):
            real = state[follows[todo]]
            todo, real = todo[real != begin[todo]], real[real != begin[todo]]
            was, now = begin[todo], real.copy()
            begin[todo] = real
            changed, at = todo, np.arange(len(todo))
            for t in range(self.block):
                inside = changed[at] < alive[t]
                at, was, now = at[inside], was[inside], now[inside]
                if not len(at):
                    break
                symbol = column[columns[t, changed[at]]]
                a, b = table[was + symbol], table[now + symbol]
                count[changed[at]] += (b >> 30) - (a >> 30)
                was, now = a & (_NEW - 1), b & (_NEW - 1)
                apart = was != now
                at, was, now = at[apart], was[apart], now[apart]
            state[changed[at]] = now  # blocks of which the end has changed
            ended = np.zeros(len(state), dtype=bool)
            ended[changed[at]] = True
            todo = np.flatnonzero((follows >= 0) & ended[follows])
        return count

    def phrases(self, read: list[bytes]) -> np.ndarray:
        """For each language (rows) and non-empty text the number of phrases of its greedy parse."""
        lengths = np.array([len(x) for x in read])
        blocks = -(-lengths // self.block)
        first = np.cumsum(blocks) - blocks
        matrix = np.full((int(blocks.sum()), self.block), 256, dtype=np.int16)
        flat = matrix.ravel()
        for x, at in zip(read, first.tolist()):
            flat[at * self.block : at * self.block + len(x)] = np.frombuffer(x, dtype=np.uint8)
        fill = np.minimum(np.repeat(lengths, blocks) - (np.arange(len(matrix)) - np.repeat(first, blocks)) * self.block, self.block)
        order = np.argsort(-fill, kind="stable")  # longest first: later steps look at fewer blocks
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.arange(len(matrix)) - 1
        before[first] = -1
        follows = np.where(before[order] >= 0, place[before[order]], -1)
        columns = np.ascontiguousarray(matrix[order].T)
        alive = np.searchsorted(-fill[order], -np.arange(self.block), side="left")
        counts = [np.add.reduceat(self._phrases(k, columns, alive, follows)[place], first) for k in range(len(self.languages))]
        return np.array(counts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out_lang, out_score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.table is None:
            return out_lang, out_score
        parsed = [(i, read) for i, text in enumerate(texts) if text and (read := letter_bytes(text))]
        if not parsed:
            return out_lang, out_score
        rates = self.phrases([read for _, read in parsed]) * np.array(self.bits)[:, None] / np.array([len(read) for _, read in parsed])
        best = np.argmin(rates, axis=0)
        ranked = np.sort(rates, axis=0)
        score = np.ones(len(parsed)) if len(ranked) == 1 else 1 - ranked[0] / np.maximum(ranked[1], 1e-12)
        for (i, _), lang, s in zip(parsed, best.tolist(), score.tolist()):
            out_lang[i], out_score[i] = self.languages[lang], min(1.0, max(0.0, s))
        return out_lang, out_score


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    reference_chars: int = REFERENCE_CHARS,
    references: dict[str, str] | None = None,
) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) for each document.

    ``references`` (text by language) takes the place of the sample of labelled rows.
    """
    if references is None:
        references = reference_sample(docs, id_col, text_col, lang_col, reference_chars)
    sent = docs.sparkSession.sparkContext.broadcast(CrossParser(references))
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def make():
        parser = sent.value.unpacked()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = parser.predict(part.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return work

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return K.map_slices(narrow, ["doc_id", "held_out", "text"], "text", schema, make)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reference_chars: int = REFERENCE_CHARS) -> DataFrame:
    """All columns of the documents whose text has an identifiable language; the others go.  A null label takes the language found."""
    parser_ = CrossParser(reference_sample(docs, id_col, text_col, lang_col, reference_chars))
    sent = docs.sparkSession.sparkContext.broadcast(parser_)
    names = docs.columns
    place, label = names.index(text_col), names.index(lang_col)

    @K.tidied
    def run(batches):
        parser = sent.value.unpacked()
        for batch in batches:
            for part in K.slices(batch, place):
                langs, _ = parser.predict(part.column(place).to_pylist())
                filled = pa.array([old if old is not None else x for old, x in zip(part.column(label).to_pylist(), langs)], part.column(label).type)
                columns = [filled if i == label else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    K.small_batches(docs)
    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, docs.schema)
