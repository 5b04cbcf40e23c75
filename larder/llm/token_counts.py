"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``chunk_chars`` is one chunk.  A longer one is encoded in chunks
that overlap; each chunk's tokens carry their offsets, and neighbouring chunks are
spliced at a proven stable boundary: a place in the overlap that follows a blank,
where both encodings begin a token and agree on every token up to the end of the
overlap's settled part.  That proves it only where no pre-token spans a blank, so that what
stands behind such a place doesn't depend on what stands before it: ``splits_at_blanks`` reads
that from the tokenizer's own description, and texts are encoded whole where it can't.  What makes a boundary stable also makes
a chunk's count the sum over its words; as words repeat, a worker keeps the counts that the library gave for them.  Where an
overlap has no such place, it is widened to twice its length, in the end to the
whole text.

``.json`` files are read by tokenizers, ``.model`` files by sentencepiece, which has no such description: texts are encoded whole.

Defined results: null counts as the empty text, which has no tokens; special strings
inside texts are taken as the library takes them by default; repeated rows are
counted each; a text without blanks is encoded whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
MEMO_WORDS = 600_000
#: Patterns of pre-tokenizers, as tokenizer files spell them, that match no blank.
BLANKLESS_PATTERNS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "\\w+|[^\\w\\s]+")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_blanks(description: dict) -> bool:
    """Whether a tokenizer file's normaliser works on each word alone and its pre-tokenizer lets no pre-token span a blank; False where that isn't known."""

    def parts(x: dict | None) -> list[dict]:
        return [] if not x else [p for y in x.get("normalizers", []) + x.get("pretokenizers", []) for p in parts(y)] if x["type"] == "Sequence" else [x]

    def plain(x: dict) -> bool:
        blanks = x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        return blanks or x["type"] in ("NFC", "NFD", "Lowercase", "StripAccents")

    def cuts(x: dict) -> bool:
        split = x["type"] == "Split" and x["pattern"].get("Regex") in BLANKLESS_PATTERNS and x["behavior"] == "Removed" and x["invert"]
        return split or x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")

    before = parts(description.get("pre_tokenizer"))
    return bool(before) and cuts(before[0]) and all(map(plain, parts(description.get("normalizer")))) and not (description["model"].get("dropout") or 0)


class ChunkedEncoder:
    """Encodes huge texts chunk by chunk: token numbers and starts as of the whole text."""

    def __init__(self, encode: Callable[[str], tuple[list[int], list[int]]], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.encode, self.chunk, self.overlap = encode, chunk, overlap

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        ids, starts = self.encode(text[: self.chunk])
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(0, end - overlap)
                new_ids, new_starts = self.encode(text[begin : end + self.chunk])
                new_starts = [s + begin for s in new_starts]
                cut = self._boundary(text, begin, end, ids, starts, new_ids, new_starts)
                if cut is not None:
                    break
                if begin == 0:  # the new encoding begins where the text does: it replaces all before it
                    cut = (0, 0)
                    break
                overlap *= 2
            ids[cut[0] :], starts[cut[0] :] = new_ids[cut[1] :], new_starts[cut[1] :]
            end = min(len(text), end + self.chunk)
        return ids, starts

    @staticmethod
    def _boundary(text, begin, end, ids, starts, new_ids, new_starts) -> tuple[int, int] | None:
        """The first token of the overlap that both encodings begin behind a blank and agree on up to the last blank."""
        last = text.rfind(" ", begin, end)
        if last < 0:
            return None
        old = len(starts)
        while old and starts[old - 1] >= begin:
            old -= 1
        place = {s: j for j, s in reversed(list(enumerate(new_starts[: len(starts) - old + 64]))) if s < end}
        for i in range(old, len(starts)):
            s = starts[i]
            j = place.get(s)
            if j is None or s <= begin or s > last or text[s - 1] not in " \n":
                continue
            a = [(t, x) for t, x in zip(ids[i:], starts[i:]) if x < last]
            b = [(t, x) for t, x in zip(new_ids[j : j + len(a)], new_starts[j : j + len(a)])]
            if a and a == b:
                return i, j
        return None


class TokenCounter:
    """Counts tokens as the library does."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, memo_words: int = MEMO_WORDS):
        self.chunked = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._counts = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
            return
        tokenizer = load_tokenizer(path)

        def encode(text: str) -> tuple[list[int], list[int]]:
            e = tokenizer.encode(text, add_special_tokens=False)
            return e.ids, [o[0] for o in e.offsets]

        self._counts = self._encoded = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if splits_at_blanks(json.loads(tokenizer.to_str())):
            self.chunked = ChunkedEncoder(encode, chunk, overlap)
            self.memo_words, self.memo, self._counts = memo_words, {"": 0}, lambda texts: list(map(self._by_words, texts))

    def _by_words(self, text: str) -> int:
        """Tokens of one chunk: those of its words, as the library gives them, from a table of bounded size."""
        words = text.replace("\n", " ").split(" ")
        if new := list({w for w in words if w not in self.memo}):
            if len(self.memo) + len(new) > self.memo_words:
                self.memo, new = {"": 0}, list(set(words) - {""})
            self.memo.update(zip(new, self._encoded(new)))
        return sum(map(self.memo.__getitem__, words))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: texts of one chunk go to the library together."""
        if not self.chunked:
            return self._counts(texts)
        one = iter(self._counts([t for t in texts if len(t) <= self.chunked.chunk]))
        return [next(one) if len(t) <= self.chunked.chunk else len(self.chunked.tokens(t)[0]) for t in texts]


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """One row for each document: bytes, tokens and whether these exceed ``limit``.

    ``path`` names the tokenizer's file, which every worker must be able to read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = K.kept(f"{path} {chunk} {overlap}", lambda: TokenCounter(path, chunk, overlap))

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = counter.counts(texts)
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return K.map_slices(narrow, ["doc_id", "text"], "text", schema, make)
