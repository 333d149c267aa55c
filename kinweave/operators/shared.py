"""Windows that sequences share, and the pairs that share one, without a row for each window or a shuffle of pairs.

A window's bin is a hash of its least piece of a few characters (its minimizer),
so equal windows have one bin. Neighbouring windows mostly have the same bin: a
run of them travels as one string with its sequence's id, and many runs as one
compressed value. A task has all windows of a bin, sorts their hashes and
compares the texts of those that agree.

Of the shared windows, those that don't all follow the same character link all
pairs that have any (every common substring has a left-maximal one that begins
at or before it). A group, the ids that have such a window, is sent to each
block of ids that has a member in it; a block's task has all groups of its ids
and makes each id's partners once, so pairs are distinct where they are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows that a map task cuts into runs at once; windows that a bin's task sorts at once; values or pairs in a batch that a task returns.
RANGE, ROUND, OUT = 1 << 22, 1 << 22, 1 << 18
#: Bytes of input for a bin, and the most bins and blocks. Ids that differ in their low bits only have one block.
BIN_BYTES, BINS, BLOCKS, BLOCK_BITS = 2_000_000, 2048, 24, 8
_BASE32, _BASE64 = np.uint32(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint16(0xFFFF)
_RUNS = "bin int, windows long, size long, runs binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mixed(np.arange(1, 257))


def _values(codes: np.ndarray) -> np.ndarray:
    return _LETTERS[codes] if codes.dtype == np.uint8 else _mixed(codes.astype(np.uint64) + np.uint64(1))


def _hashes(values: np.ndarray, width: int, base) -> np.ndarray:
    """A hash of each run of ``width`` values: a polynomial, by doubling."""
    power = lambda n: values.dtype.type(pow(int(base), n, 1 << 8 * values.dtype.itemsize))
    now, at, out, have = values, 1, None, 0
    while True:
        if width & at:
            if out is None:
                out = now
            else:
                n = len(out) - at
                out = now[:n] * power(have) + out[at:]
            have += at
        at *= 2
        if at > width:
            return out
        half = at // 2
        now = now[:-half] * power(half) + now[half:]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    at = 1
    while at * 2 <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    rest = width - at
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in a row, and the offsets of the texts: bytes if all are ASCII, code points otherwise."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if not len(raw) or raw.max() < 128:
        return raw, offsets - offsets[0]
    every = texts.to_pylist()
    return np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _planes(x: np.ndarray) -> bytes:
    """Differences of numbers, first bytes together, then second ones: they pack well."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _numbers(raw: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())


def _cut(codes: np.ndarray, offsets: np.ndarray, columns: list[np.ndarray], em: int, bins: int) -> Iterator[tuple[int, int, int, bytes]]:
    """bin, windows, size, value: the runs of windows of one bin."""
    m = min(em, max(3, em // 4 + 1))
    last = len(codes) - em + 1
    for low in range(0, max(last, 0), RANGE):
        high = min(last, low + RANGE)
        piece = codes[low : high + em - 1]
        small = _mixed(_hashes(_values(piece), m, _BASE64)) >> np.uint64(32)
        least = _least(small.astype(np.uint32), em - m + 1)
        of = (((least * _BASE32) >> np.uint32(8)) % np.uint32(bins)).astype(np.uint16)
        # A text's last windows would reach into the next text; a text may lie in several ranges.
        first, final = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        for end in offsets[max(first, 0) + 1 : final + 1 + em]:
            of[max(end - em + 1 - low, 0) : max(end - low, 0)] = _NONE
        begin = np.unique(np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, offsets[max(first, 0) + 1 : final] - low]))
        count = np.diff(np.concatenate([begin, [len(of)]]))
        kept = of[begin] != _NONE
        begin, count = begin[kept], count[kept]
        order = np.argsort(of[begin], kind="stable")
        begin, count = begin[order], count[order]
        if not len(begin):
            continue
        owner = of[begin]
        start = begin + low
        text = np.searchsorted(offsets, start, "right") - 1
        head = start == offsets[text]
        left = codes[np.where(head, start, start - 1)]
        lengths = count + em - 1
        letters = codes[_spans(start, lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])
        own = [c[text] for c in columns]
        border = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            parts = [_planes(x[a:b].astype(np.int64)) for x in (count, *own)]
            raw = b"".join([*parts, head[a:b].tobytes(), left[a:b].tobytes(), letters[at[a] : at[b]].tobytes()])
            packed = pa.compress(raw, codec="zstd", asbytes=True)
            value = (b - a).to_bytes(4, "little") + bytes([codes.itemsize]) + packed
            yield int(owner[a]), int(count[a:b].sum()), len(raw), value


def _uncut(value: bytes, size: int, columns: int, em: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each run, columns, whether it is a beginning, the character before, all characters."""
    n, item = int.from_bytes(value[:4], "little"), value[4]
    raw = np.frombuffer(pa.decompress(value[5:], size, codec="zstd"), np.uint8)
    numbers = [_numbers(raw[8 * n * k : 8 * n * (k + 1)], n) for k in range(columns + 1)]
    at = 8 * n * (columns + 1)
    kind = np.uint8 if item == 1 else np.uint32
    rest = raw[at + n :].view(kind) if item == 1 else np.frombuffer(raw[at + n :].tobytes(), kind)
    return numbers[0], numbers[1:], raw[at : at + n].astype(bool), rest[:n], rest[n:]


class _Shared:
    """Shared windows of a part of a bin: rows in order of windows; ``first`` begins each window's rows, ``who`` are places of ids in ``ids``, ``before`` is the character before, -1 at a beginning."""

    def __init__(self, first, who, before, ids, columns, texts):
        self.first, self.who, self.before, self.ids, self.columns, self.texts = first, who, before, ids, columns, texts

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """window, id's place: each once, in order."""
        window = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.who))))
        key = np.unique(window * len(self.ids) + self.who)
        return key // max(len(self.ids), 1), key % max(len(self.ids), 1)


def _shared(values: list[tuple[bytes, int]], windows: int, columns: int, em: int) -> Iterator[_Shared]:
    """Windows of a bin that occur twice or more, in rounds of bounded numbers of windows."""
    rounds = -(-windows // ROUND)
    for r in range(rounds):
        found, at, runs = [], 0, 0
        for value, size in values:
            count, own, head, left, letters = _uncut(value, size, columns, em)
            if len(letters) < em:
                continue
            begin = np.cumsum(count + em - 1) - (count + em - 1)
            place = _spans(begin, count)
            run = np.repeat(np.arange(len(count)), count)
            h = _mixed(_hashes(_values(letters), em, _BASE64))[place]
            before = np.where(place > begin[run], letters[np.maximum(place - 1, 0)].astype(np.int64), np.where(head, -1, left.astype(np.int64))[run])
            if rounds > 1:
                kept = np.flatnonzero((h & np.uint64(0xFFFF)) % np.uint64(rounds) == r)
                place, run, h, before = place[kept], run[kept], h[kept], before[kept]
            found.append((h, place + at, run + runs, before, own, letters))
            at, runs = at + len(letters), runs + len(count)
        if not found:
            continue
        h, place, run, before = (np.concatenate([f[k] for f in found]) for k in range(4))
        own = [np.concatenate([f[4][k] for f in found]) for k in range(columns)]
        wide = any(f[5].itemsize > 1 for f in found)
        letters = np.concatenate([f[5].astype(np.uint32) if wide else f[5] for f in found])
        del found
        # Most windows are alone: what is alone in a table of counts needs no sorting.
        bits = max(8, int(4 * len(h)).bit_length())
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        maybe = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
        del slot
        maybe = maybe[np.argsort(h[maybe], kind="stable")]
        h = h[maybe]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        several = ~new | np.append(~new[1:], False)
        maybe, new = maybe[several], new[several]
        if not len(maybe):
            continue
        place, run, before = place[maybe], run[maybe], before[maybe]
        texts = np.lib.stride_tricks.sliding_window_view(letters, em)
        group = np.cumsum(new) - 1
        leader = place[new]
        same = np.concatenate([(texts[place[a : a + OUT]] == texts[leader[group[a : a + OUT]]]).all(1) for a in range(0, len(place), OUT)])
        if not same.all():  # equal hashes of unequal texts: texts themselves tell them apart
            exact = np.ascontiguousarray(texts[place]).view(f"V{em * letters.itemsize}").ravel()
            _, group = np.unique(exact, return_inverse=True)
            order = np.argsort(group, kind="stable")
            place, run, before, group = place[order], run[order], before[order], group[order]
            new = np.append(True, group[1:] != group[:-1])
        ids, rank = np.unique(own[0], return_inverse=True)
        one = np.zeros(len(ids), np.int64)
        one[rank] = np.arange(len(rank))
        yield _Shared(np.flatnonzero(new), rank[run], before, ids, [c[one] for c in own[1:]], texts[place[new]])


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of characters as strings."""
    n, em = rows.shape
    if rows.itemsize > 1:
        return pa.array([bytes(r).decode("utf-32-le", "surrogatepass") for r in np.ascontiguousarray(rows)], pa.string())
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * em).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows)))


def bins_of(sequences: DataFrame) -> int:
    """Bins for the planner's size of the input; as many as shuffle partitions if it knows none."""
    size = int(str(sequences._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 42
    return max(1, min(BINS, size // BIN_BYTES + 1 if known else int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _binned(sequences: DataFrame, em: int, columns: list[str], bins: int) -> DataFrame:
    """The runs of all sequences, a bin a partition."""
    source = sequences.where(F.col("sid").isNotNull()).select("seq", *(F.col(c).cast("long") for c in ("sid", *columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = _codes(batch.column(0))
            own = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(columns) + 1)]
            rows, held = [], 0
            for row in _cut(codes, offsets, own, em, bins):
                rows.append(row)
                held += len(row[3])
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bin", "windows", "size", "runs"])

    return source.mapInArrow(run, _RUNS).repartitionById(bins, F.col("bin"))


def _each_bin(batches: Iterator[pa.RecordBatch], columns: int, em: int) -> Iterator[_Shared]:
    held: dict[int, list] = {}
    for batch in batches:
        for b, windows, size, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(b, []).append((windows, size, value))
    for b in sorted(held):
        rows = held.pop(b)
        yield from _shared([(v, s) for _, s, v in rows], sum(w for w, _, _ in rows), columns, em)


def shared_windows(sequences: DataFrame, em: int, members: bool = False) -> DataFrame:
    """kmer, n: each window of em characters that two sequences or more have, and how many do; or kmer, sid for each of these."""
    schema = T.StructType([T.StructField("kmer", T.StringType()), T.StructField("sid" if members else "n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _each_bin(batches, 1, em):
            window, who = s.members()
            n = np.bincount(window, minlength=len(s.first))
            if members:
                kept = np.flatnonzero(n[window] > 1)
                for a in range(0, len(kept), OUT):
                    part = kept[a : a + OUT]
                    yield pa.RecordBatch.from_arrays([_strings(s.texts[window[part]]), pa.array(s.ids[who[part]], pa.int64())], schema.names)
            else:
                kept = np.flatnonzero(n > 1)
                for a in range(0, len(kept), OUT):
                    yield pa.RecordBatch.from_arrays([_strings(s.texts[kept[a : a + OUT]]), pa.array(n[kept[a : a + OUT]], pa.int64())], schema.names)

    return _binned(sequences, em, [], bins_of(sequences)).mapInArrow(run, schema)


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed((ids >> BLOCK_BITS).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _once(start: np.ndarray, size: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Places of the groups of unlike members; members in order are equal if their sums of hashes are, which is checked."""
    h = _mixed(members)
    total = np.add.reduceat(h, start) if len(start) else np.zeros(0, np.uint64)
    _, first, inverse = np.unique(total + _mixed(size), return_index=True, return_inverse=True)
    of = first[inverse]
    alike = size == size[of]
    both = np.flatnonzero(alike & (of != np.arange(len(of))))
    unlike = members[_spans(start[both], size[both])] != members[_spans(start[of[both]], size[of[both]])]
    wrong = np.bincount(np.repeat(np.arange(len(both)), size[both]), weights=unlike, minlength=len(both)) > 0
    drop = np.zeros(len(of), bool)
    drop[both[~wrong]] = True
    return np.flatnonzero(~drop)


def _matches(s: _Shared) -> int:
    """Left-maximal matches: pairs of occurrences in two sequences, less those that follow the same character."""
    window = np.repeat(np.arange(len(s.first)), np.diff(np.append(s.first, len(s.who))))
    inner = s.before >= 0
    w, who, before = window[inner], s.who[inner], s.before[inner]
    return (_squares(window) - _squares(window, s.who) - _squares(w, before) + _squares(w, who, before)) // 2


def _squares(*keys: np.ndarray) -> int:
    """The sum of squares of how often each combination occurs."""
    order = np.lexsort(keys)
    if not len(order):
        return 0
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return int((np.diff(np.append(at, len(order))) ** 2).sum())


def _packed(sizes: np.ndarray, who: np.ndarray, ids: np.ndarray, columns: list[np.ndarray]) -> tuple[int, bytes]:
    """size, value: groups of places of ids; an id and its columns are kept once."""
    seen, place = np.unique(who, return_inverse=True)
    raw = b"".join(_planes(x.astype(np.int64)) for x in (sizes, place, ids[seen], *(c[seen] for c in columns)))
    return len(raw), b"".join(n.to_bytes(8, "little") for n in (len(sizes), len(who), len(seen))) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(value: bytes, size: int, columns: int) -> list[np.ndarray]:
    """sizes, places, ids, columns."""
    sizes, members, seen = (int.from_bytes(value[8 * k : 8 * k + 8], "little") for k in range(3))
    raw, at, out = np.frombuffer(pa.decompress(value[24:], size, codec="zstd"), np.uint8), 0, []
    for n in (sizes, members, *[seen] * (columns + 1)):
        out.append(_numbers(raw[at : at + 8 * n], n))
        at += 8 * n
    return out


def _groups(sequences: DataFrame, em: int, columns: list[str], bins: int, blocks: int) -> DataFrame:
    """block, matches, size, groups: groups that link all pairs, once for each block that has members; a bin's matches are in a row without groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _each_bin(batches, len(columns) + 1, em):
            low, high = np.minimum.reduceat(s.before, s.first), np.maximum.reduceat(s.before, s.first)
            kept = np.flatnonzero((low != high) | (low < 0))
            size = np.diff(np.append(s.first, len(s.who)))
            rows = _spans(s.first[kept], size[kept])
            if not len(rows):
                continue
            s = _Shared(np.cumsum(size[kept]) - size[kept], s.who[rows], s.before[rows], s.ids, s.columns, s.texts[:0])
            yield _batch([(0, _matches(s), 0, b"")])
            window, who = s.members()
            n = np.bincount(window, minlength=len(s.first))
            inside = n[window] > 1
            who, n = who[inside], n[n > 1]
            start = np.cumsum(n) - n
            once = _once(start, n, who)
            who, n = who[_spans(start[once], n[once])], n[once]
            start = np.cumsum(n) - n
            sent = np.unique(_block(s.ids, blocks)[who] * len(n) + np.repeat(np.arange(len(n)), n))
            block, group = sent // max(len(n), 1), sent % max(len(n), 1)
            held = np.cumsum(n[group])
            a = 0
            while a < len(group):
                b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + 4 * OUT, "right")))
                b = min(b, int(np.searchsorted(block, block[a], "right")))
                flat = who[_spans(start[group[a:b]], n[group[a:b]])]
                yield _batch([(int(block[a]), 0, *_packed(n[group[a:b]], flat, s.ids, s.columns))])
                a = b

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "matches", "size", "groups"])

    return _binned(sequences, em, columns, bins).mapInArrow(run, "block int, matches long, size long, groups binary").repartitionById(blocks, F.col("block"))


def _partners(batches: Iterator[pa.RecordBatch], columns: int, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each id of the block: its place, the places of larger ids that it shares a group with, all ids, their columns."""
    sizes, owners, places, tables, at = [], [], [], [[] for _ in range(columns + 1)], 0
    for batch in batches:
        for block, size, value in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if value:
                n, place, *table = _unpacked(value, size, columns)
                sizes.append(n)
                owners.append(np.full(len(n), block))
                places.append(place + at)
                at += len(table[0])
                for held, x in zip(tables, table, strict=True):
                    held.append(x)
    if not sizes:
        return
    n, owner = np.concatenate(sizes), np.concatenate(owners)
    table = [np.concatenate(t) for t in tables]
    ids, one, rank = np.unique(table[0], return_index=True, return_inverse=True)
    own = [t[one] for t in table[1:]]
    who = np.concatenate([rank[p] for p in places])
    del table, tables, places
    start = np.cumsum(n) - n
    once = _once(start, n, who)
    who, n, owner = who[_spans(start[once], n[once])].astype(np.int32), n[once], owner[once]
    end = np.repeat(np.cumsum(n), n)
    mine = np.flatnonzero((_block(ids, blocks)[who] == np.repeat(owner, n)) & (np.arange(len(who)) + 1 < end))
    mine = mine[np.argsort(who[mine], kind="stable")]
    first = np.append(np.flatnonzero(np.diff(who[mine], prepend=-1)), len(mine)).tolist()
    mark = np.zeros(len(ids), bool)
    lows, highs = (mine + 1).tolist(), end[mine].tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        place = int(who[mine[a]])
        if b - a == 1:
            found = who[lows[a] : highs[a]]
        else:
            parts = [who[lows[k] : highs[k]] for k in range(a, b)]
            if 64 * sum(map(len, parts)) < len(ids):
                found = np.unique(np.concatenate(parts))
            else:
                for p in parts:
                    mark[p] = True
                found = np.flatnonzero(mark[place:]) + place
                mark[found] = False
        yield place, found, ids, own


def linked_pairs(sequences: DataFrame, em: int, columns: list[str] | None = None, cutoff: int | None = None, bins: int | None = None) -> DataFrame:
    """id1 < id2, each pair once, that share a window of em characters, with each side's whole-number columns as <column>1 and <column>2; with a cutoff, pairs of too unlike ``len`` are left out.

    Each sid stands for one sequence if there are columns or a cutoff.
    """
    given = list(columns or [])
    carried = given if cutoff is None or "len" in given else [*given, "len"]
    bins = bins or bins_of(sequences)
    blocks = max(1, min(BLOCKS, bins))
    schema = T.StructType([T.StructField(f"{c}{k}", T.LongType()) for c in ("id", *given) for k in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for place, found, ids, own in _partners(batches, len(carried), blocks):
            if cutoff is not None:
                length = own[carried.index("len")]
                mine, theirs = length[place], length[found]
                found = found[np.minimum(mine, theirs) * 100 >= cutoff * np.maximum(mine, theirs)]
            for a in range(0, len(found), OUT):
                held.append((place, found[a : a + OUT]))
                total += len(held[-1][1])
                if total >= OUT:
                    yield batch(held, ids, own)
                    held, total = [], 0
        if held:
            yield batch(held, ids, own)

    def batch(held: list, ids: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        one = np.repeat(np.array([p for p, _ in held]), [len(f) for _, f in held])
        two = np.concatenate([f for _, f in held])
        return pa.RecordBatch.from_arrays([pa.array(c[side]) for c in (ids, *own[: len(given)]) for side in (one, two)], schema.names)

    return _groups(sequences, em, carried, bins, blocks).mapInArrow(run, schema)


def match_counts(sequences: DataFrame, em: int) -> DataFrame:
    """matches, pairs: left-maximal matches of em characters or more, and the distinct pairs that have one; no pair leaves its task."""
    bins = bins_of(sequences)
    blocks = max(1, min(BLOCKS, bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = 0

        def seen():
            nonlocal matches
            for batch in batches:
                matches += sum(batch.column(1).to_pylist())
                yield batch

        pairs = sum(len(found) for _, found, _, _ in _partners(seen(), 0, blocks))
        yield pa.RecordBatch.from_arrays([pa.array([matches]), pa.array([pairs])], ["matches", "pairs"])

    zero = F.lit(0).cast("long")
    counts = _groups(sequences, em, [], bins, blocks).mapInArrow(run, "matches long, pairs long")
    return counts.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("matches", "pairs")))


#: Entries of a table of counts in a task; characters of a right side that is sent to all tasks.
TABLE, SENT = 1 << 20, 1 << 22


def window_counts(sequences: DataFrame, k: int, alphabet: str) -> DataFrame:
    """kmer, size: how often each window of k characters occurs, those outside the alphabet too. A task counts its own, so no row is made for a window."""
    letters = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
    cells = len(letters) ** k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells if cells <= TABLE else 0, np.int64)
        for batch in batches:
            codes, offsets = _codes(batch.column(0))
            for low in range(0, max(len(codes) - k + 1, 0), RANGE):
                high = min(len(codes) - k + 1, low + RANGE)
                piece = codes[low : high + k - 1]
                good = np.ones(high - low, bool)
                first, final = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
                for end in offsets[max(first, 0) + 1 : final + 1 + k]:
                    good[max(end - k + 1 - low, 0) : max(end - low, 0)] = False
                number = np.zeros(high - low, np.int64)
                rest = good
                if len(counts):
                    digit = np.full(max(int(piece.max()), int(letters.max())) + 1, cells, np.int64)
                    digit[letters] = np.arange(len(letters))
                    placed = digit[piece]
                    for i in range(k):
                        number = number * len(letters) + placed[i : i + high - low]
                    counts += np.bincount(number[good & (number < cells)], minlength=cells)
                    rest = good & (number >= cells)
                if rest.any():
                    kind, n = np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece, k)[rest]).view(f"V{k * piece.itemsize}").ravel(), return_counts=True)
                    yield _counted(np.frombuffer(kind.tobytes(), piece.dtype).reshape(-1, k), n)
        seen = np.flatnonzero(counts)
        digits = np.stack([seen // len(letters) ** (k - 1 - i) % len(letters) for i in range(k)], axis=1) if len(seen) else np.zeros((0, k), np.int64)
        yield _counted(letters[digits], counts[seen])

    def _counted(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_strings(rows.astype(np.uint8) if len(rows) and rows.max() < 128 else rows), pa.array(n, pa.int64())], ["kmer", "size"])

    return sequences.select("seq").mapInArrow(run, "kmer string, size long").groupBy("kmer").agg(F.sum("size").alias("size"))


def found_in(left: DataFrame, right: DataFrame, em: int) -> DataFrame | None:
    """left_id, right_id, each once, of sequences that share a window of em characters, if the right side has SENT characters at most (else None): it is sent to all tasks."""
    size = right.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.count(F.lit(1))).first()
    if sum(size) > SENT:
        return None
    known = right.select("sid", F.coalesce("seq", F.lit("")).alias("seq")).toArrow().combine_chunks()
    texts, offsets = _codes(pa.array(known.column("seq").to_pylist(), pa.string()))
    texts = texts.astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = max(len(texts) - em + 1, 0)
    places = np.flatnonzero(owner[:last] == owner[em - 1 : em - 1 + last]) if last else np.zeros(0, np.int64)
    h = _mixed(_hashes(_values(texts), em, _BASE64))[places] if last else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    bits = max(16, int(16 * len(h)).bit_length())
    table = left.sparkSession.sparkContext.broadcast((h[order], places[order], owner, texts, known.column("sid").to_pylist()))
    schema = T.StructType([T.StructField("left_id", left.schema["sid"].dataType), T.StructField("right_id", right.schema["sid"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, places, owner, texts, sids = table.value
        some = np.zeros(1 << bits, bool)
        some[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        theirs = np.lib.stride_tricks.sliding_window_view(texts, em) if len(texts) >= em else None
        for batch in batches:
            codes, offsets = _codes(batch.column(1))
            got = []
            for low in range(0, max(len(codes) - em + 1, 0) if len(h) else 0, RANGE // 8):
                high = min(len(codes) - em + 1, low + RANGE // 8)
                piece = codes[low : high + em - 1]
                own = _mixed(_hashes(_values(piece), em, _BASE64))
                at = np.flatnonzero(some[(own >> np.uint64(64 - bits)).astype(np.int64)])
                a, b = (np.searchsorted(h, own[at], side) for side in ("left", "right"))
                start, place = np.repeat(at + low, b - a), places[_spans(a, b - a)]
                text = np.searchsorted(offsets, start, "right") - 1
                inside = start + em <= offsets[text + 1]
                start, place, text = start[inside], place[inside], text[inside]
                if len(start):
                    mine = np.lib.stride_tricks.sliding_window_view(codes, em)
                    same = np.concatenate([(mine[start[i : i + OUT]] == theirs[place[i : i + OUT]]).all(1) for i in range(0, len(start), OUT)])
                    got.append(np.unique(np.stack([text[same], owner[place[same]]], axis=1), axis=0))
            if got:
                pairs = np.unique(np.concatenate(got), axis=0)
                kind = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])).cast(kind), pa.array([sids[k] for k in pairs[:, 1].tolist()], right_kind)], ["left_id", "right_id"])

    right_kind = known.schema.field("sid").type
    return left.select("sid", "seq").mapInArrow(run, schema).distinct()
