"""Byte-level BPE encoding and decoding (operator 6).

Boundaries come from ``pretokens`` (classes and an associative scan, no regular
expression). The byte slices go through a cache of bounded size; a slice that it
lacks is merged pair by pair, lowest rank first. Ids carry the offsets of their
bytes, so decoding is a lookup of each id's bytes and any range of a text can be
decoded by itself.

Defined results: null and empty texts have no ids and decode to nothing; ids of
documents may be null or repeat. A text is handled whole; its slices are in
memory at once, a slice of a batch holds a few MB of text or one text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .pretokens import pretokens

CACHE = 250_000
#: Longer pre-tokens (in bytes) are not cached.
LONGEST = 256


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: adjacent parts with the lowest rank are joined, the leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 40
    costs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i] += parts.pop(i + 1)
        costs.pop(i)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over linked parts, for runs of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is part of another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two parts has changed
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i])


class Codec:
    """Encodes and decodes lists of texts; ids are little-endian unsigned 32-bit numbers. The cache lasts as long as the worker process."""

    _shared: dict = {}

    def __init__(self, path: str | None = None, cache: int = CACHE):
        if path not in self._shared:
            ranks = read_ranks(path)
            known = Cache(lambda piece: pack_ids(merge(piece, ranks)), cache)
            self._shared[path] = (known, {i: b for b, i in ranks.items()})
        self.known, self.bytes_of = self._shared[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.known.joined(pieces) for pieces in pretokens(texts)]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offsets: of each id its start, and the end of the last."""
        every = unpack(ids)
        out = np.zeros(len(every) + 1, np.int64)
        np.cumsum([len(self.bytes_of[i]) for i in every], out=out[1:])
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, unpack(ids)))


def pack_ids(ids: tuple[int, ...] | list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Cache(dict):
    """Packed ids by pre-token. What it lacks is encoded when it is asked for; it is emptied when it is full."""

    def __init__(self, encode: Callable[[bytes], bytes], limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: bytes) -> bytes:
        got = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = got
        return got

    def joined(self, pieces: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def encode_documents(df: DataFrame, path: str | None = None, cache: int = CACHE, keep: list[str] | None = None, with_offsets: bool = True) -> DataFrame:
    """Adds ids (and byte_offsets, one more than ids)."""

    def make():
        codec = Codec(path, cache)

        def compute(values: list) -> list[list]:
            ids = codec.encode([v or "" for v in values])
            return [[unpack(x) for x in ids], [codec.offsets(x).tolist() for x in ids]][: 1 + with_offsets]

        return compute

    fields = [("ids", T.ArrayType(T.IntegerType())), ("byte_offsets", T.ArrayType(T.LongType()))]
    return append_columns(df, make, fields[: 1 + with_offsets], keep=keep)


def round_trip(df: DataFrame, path: str | None = None, cache: int = CACHE, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens and the digests of the ids and of the bytes that they decode to."""

    def make():
        codec = Codec(path, cache)

        def compute(values: list) -> list[list]:
            ids = codec.encode([v or "" for v in values])
            digests = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            return [[len(x) // 4 for x in ids], digests, decoded]

        return compute

    return append_columns(df, make, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], keep=keep)
