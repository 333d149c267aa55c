"""Sum-of-squares online packing of documents into token sequences (operator 3).

Each task packs the documents of its own partition as they come, without a
shuffle. What fills whole windows is cut off a document first; its rest goes to
the fill level at which the sum of the squared counts of partially filled
windows, kept in an array by level, becomes smallest. When the partition ends,
the windows still open are merged by cutting the emptiest into the gaps of the
fullest; the last one is cut at powers of two, so no position is padding.

Open windows are at most a few for each level, so memory doesn't follow the
partition. Sequence ids hold the partition's number in their upper bits; a task
that runs again gives the same rows for the same input.

Defined results: a null text is the empty text and has the final id alone; ids
of documents may be null or repeat, each row is packed for itself; an empty
table gives no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import Cache, pack_ids
from .common import pick, slices, small_batches
from .pretokens import pretokens

WINDOW = 2048
END_ID = 1
#: Pre-tokens that a worker keeps the ids of.
CACHE = 400_000
OUT_ROWS = 1024


def byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte: itself if it prints in Latin-1, else the next from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids as the library gives them, packed as little-endian 32-bit numbers.

    The library encodes each distinct pre-token once while it is cached; a text
    that holds an added token's string goes to the library as a whole.
    """

    _shared: dict = {}

    def __init__(self, path: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in self._shared:
            from tokenizers import Tokenizer

            if path is None:
                import public_tokenizers

                used = public_tokenizers.path("byte_bpe_50k.json")
            else:
                used = path
            tokenizer = Tokenizer.from_file(used)
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            model, signs = tokenizer.model, byte_signs()
            known = Cache(lambda piece: pack_ids([t.id for t in model.tokenize(piece.decode("latin-1").translate(signs))]), cache)
            self._shared[path] = (tokenizer, added, known)
        self.tokenizer, self.added, self.known = self._shared[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        out = [self.known.joined(p) for p in pretokens(["" if i in whole else t for i, t in enumerate(texts)])]
        for i in whole:
            out[i] = pack_ids(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out


class SumOfSquares:
    """Online packing. A piece is (document, start, length); a window a list of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose window should take a piece; of equal ones the fullest."""
        top = self.window - size
        n = self.counts
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top]  # a window that is full counts no more
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        if top == 0:
            return 0
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """The window, if the piece fills it."""
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        return None

    def finish(self) -> Iterator[list]:
        """The windows left, merged by cutting; of the last, parts whose lengths are powers of two."""
        left = [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]
        low, high = 0, len(left) - 1
        while low < high:
            into = left[low]
            gap = self.window - sum(p[2] for p in into)
            while gap and low < high:
                doc, start, length = left[high].pop()
                take = min(gap, length)
                into.append((doc, start + length - take, take))
                if take < length:
                    left[high].append((doc, start, length - take))
                gap -= take
                if not left[high]:
                    high -= 1
            if not gap:
                yield into
                low += 1
        if low <= high:
            rest = left[low]
            total = sum(p[2] for p in rest)
            for bit in reversed(range(total.bit_length())):
                if total >> bit & 1:
                    need, part = 1 << bit, []
                    while need:
                        doc, start, length = rest.pop(0)
                        take = min(need, length)
                        part.append((doc, start, take))
                        if take < length:
                            rest.insert(0, (doc, start + take, length - take))
                        need -= take
                    yield part


def pack(df: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    small_batches(df.sparkSession)
    source = pick(df, "doc_id", "text")
    fields = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(path, cache), SumOfSquares(window)
        base = TaskContext.get().partitionId() << 32
        made = 0
        rows: list[tuple] = []
        kind = None

        def emit(pieces: list) -> None:
            nonlocal made
            at = 0
            for (doc_id, tokens, held, ids), start, length in pieces:
                low = 4 * (start - held)
                rows.append((doc_id, start, length, tokens, base + made, at, ids[low : low + 4 * length]))
                at += length
            made += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)
            rows.clear()
            return out

        for whole in batches:
            kind = whole.schema.field(0).type
            for part in slices(whole, 1):
                docs = part.column(0).to_pylist()
                for doc_id, ids in zip(docs, encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cut = n - n % window
                    for start in range(0, cut, window):
                        emit([((doc_id, n, 0, ids), start, window)])
                        if len(rows) >= OUT_ROWS:
                            yield batch()
                    if cut < n:  # an open window holds the rest alone, not the document
                        done = packer.place(((doc_id, n, cut, ids[4 * cut :]), cut, n - cut), n - cut)
                        if done:
                            emit(done)
                            if len(rows) >= OUT_ROWS:
                                yield batch()
        for pieces in packer.finish():
            emit(pieces)
            if len(rows) >= OUT_ROWS:
                yield batch()
        if rows:
            yield batch()

    return source.mapInArrow(run, schema)
