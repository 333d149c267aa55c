"""Token counts of whole texts by overlap resynchronisation (operator 1).

A huge text, of over ``chunk`` characters, is encoded in overlapping chunks with
offsets; neighbours are spliced at a boundary that both encodings have and that
is proven stable, and the overlap is widened until there is one. So memory
follows the chunk, not the text, and counts are those of the whole text. In a
text of one chunk every run of spaces is such a boundary, so its count is the
sum of its words', and a distinct word is encoded once while it is cached.

Why a boundary is stable: the pre-tokenizer of the vocabulary only keeps
matches of runs without white space, its normaliser composes nothing across
white space, and special strings hold none. So a position between a non-space
and a white-space character cuts every match. An ASCII digit is a match of its
own, does not compose with what stands before it and is in no special string,
so the position before one is stable as well.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); ids
may be null or repeat; further columns stay, but for those named like a result.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .packing import byte_signs

CHUNK = 8192
OVERLAP = 256
LIMIT = 2048
#: Words that a worker keeps the counts of.
CACHE = 250_000
FIELDS = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("n_chunks", T.LongType()), ("over_limit", T.BooleanType())]

_DIGITS = frozenset("0123456789")
# Fixed value: the vocabulary's own pattern.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _WordCounts(dict):
    """Tokens by word, from the library's model on each piece of the word; emptied when it is full."""

    def __init__(self, model):
        import regex

        self.model, self.pieces, self.signs = model, regex.compile(_PIECE).findall, byte_signs()

    def __missing__(self, word: str) -> int:
        got = sum(len(self.model.tokenize(p.encode().decode("latin-1").translate(self.signs))) for p in self.pieces(word))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


class ChunkCounter:
    """Counts tokens as the library would on the whole text. The words' counts last as long as the worker process."""

    _shared: dict[str, _WordCounts] = {}

    def __init__(self, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(path)
        self.lowered = Tokenizer.from_file(path)
        self.lowered.normalizer = normalizers.Sequence([])
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.marks = sorted({s.lower() for s in self.specials})
        self.chunk, self.overlap = chunk, overlap
        if path not in self._shared:
            self._shared[path] = _WordCounts(self.lowered.model)
        self.known = self._shared[path]

    def _prepared(self, text: str):
        """The library's tokenizer for a text, and the text as it gets it. Below U+0100 lower case is one to one and composed already, so the normaliser can be left out there."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole, text
        low = text.lower()
        if any(m in low for m in self.marks):
            return self.whole, text
        return self.lowered, low

    def encode(self, text: str):
        tokenizer, prepared = self._prepared(text)
        return tokenizer.encode(prepared, add_special_tokens=False)

    def count_all(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Tokens and chunks of each text.

        A text of one chunk is the sum of its words, as every run of spaces and
        line ends is a stable boundary; each distinct word is encoded once while
        it is cached. Outside Latin-1, and with special strings, the library
        gets the whole text.
        """
        out = [(0, 0)] * len(texts)
        split: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if t and len(t) > self.chunk:
                out[i] = self.count(t)
            elif t:
                tokenizer, ready = self._prepared(t)
                if tokenizer is self.whole:
                    out[i] = len(tokenizer.encode(ready, add_special_tokens=False)), 1
                else:
                    split[i] = ready.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        count = self.known.__getitem__
        for i, words in split.items():
            out[i] = sum(map(count, words)), 1
        return out

    def count(self, text: str) -> tuple[int, int]:
        """Tokens and chunks."""
        if len(text) <= self.chunk:
            return len(self.encode(text)), 1
        total, chunks, low = 0, 1, 0
        start, end = 0, self.chunk
        ids, starts, ends = self._offsets(text, start, end)
        while end < len(text):
            back, splice = self.overlap, None
            while splice is None:
                if end - back <= low:  # no stable boundary in all of this chunk: take a longer one
                    end = min(len(text), end + (end - start))
                    ids, starts, ends = self._offsets(text, start, end)
                    if end == len(text):
                        break
                    back = self.overlap
                next_start = end - back
                next_end = min(len(text), max(next_start + self.chunk, end + back))
                following = self._offsets(text, next_start, next_end)
                chunks += 1
                splice = self._boundary(text, next_start, end, (ids, starts, ends), following)
                back *= 2
            if splice is None:
                break
            total += int(np.searchsorted(starts, splice) - np.searchsorted(starts, low))
            low, start, end = splice, next_start, next_end
            ids, starts, ends = following
        return total + int(len(starts) - np.searchsorted(starts, low)), chunks

    def _offsets(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.encode(text[start:end])
        pairs = np.array(got.offsets, dtype=np.int64).reshape(-1, 2) + start
        return np.array(got.ids, dtype=np.int64), pairs[:, 0], pairs[:, 1]

    @staticmethod
    def _boundary(text: str, low: int, high: int, left, right) -> int | None:
        """The last stable boundary in (low, high), if from the first to the last both encodings agree."""
        first = next((p for p in range(low + 1, high) if _stable(text, p)), None)
        last = next((p for p in range(high - 1, low, -1) if _stable(text, p)), None)
        if first is None or first == last:
            return None
        agreed = []
        for ids, starts, ends in (left, right):
            a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
            if (a and ends[a - 1] > first) or (b and ends[b - 1] > last):
                return None
            agreed.append((ids[a:b], starts[a:b]))
        same = all(np.array_equal(x, y) for x, y in zip(*agreed, strict=True))
        return last if same else None


def _stable(text: str, p: int) -> bool:
    return text[p] in _DIGITS or text[p] in " \t\n\r" and not text[p - 1].isspace()


def token_counts(df: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens, n_chunks and over_limit to documents; a narrow step, no shuffle."""

    def make():
        counter = ChunkCounter(path, chunk, overlap)

        def compute(values: list) -> list[list]:
            counted = counter.count_all(values)
            n = [a for a, _ in counted]
            return [[len(v.encode()) if v else 0 for v in values], n, [b for _, b in counted], [x > limit for x in n]]

        return compute

    return append_columns(df, make, FIELDS, keep=keep)
