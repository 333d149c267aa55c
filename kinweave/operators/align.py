"""Affine-gap alignment of pairs: global (nw), semi-global (sg), local (sw), with matches and lengths.

Pairs of a batch are aligned side by side: their residue codes are padded to one
length and all cells of an anti-diagonal of all pairs are one array operation,
so the interpreter's work is one step a diagonal, not a cell. Scores are 32-bit
and don't saturate.

``stats_mode``: with "carried" the matches and length of a gap go along with the
gap, so they describe one optimal path; with "neighbor" they are taken from the
neighbouring cell. Ties: diagonal, then deletion, then insertion; opening a gap
before extending one. Of equal local scores the first in row-major order counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import MATRICES, residue_codes

NEG = -(1 << 28)
#: Cells of one diagonal array (pairs times padded length of the left), and bytes of the padded codes of the right.
CELLS = 400_000
CODES = 4_000_000
#: Letters of a right side of which the part that matters is looked for first, if it is twice as long as the left.
LONG = 256
KINDS = ("nw", "sg", "sw")


class _Track:
    """Score, matches and length of one state on one diagonal."""

    __slots__ = ("s", "m", "n")

    def __init__(self, s, m, n):
        self.s, self.m, self.n = s, m, n


def _batch(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, matrix: np.ndarray, kind: str, open_: int, gap: int, carried: bool):
    """a, b: padded codes, a row a pair. Returns score, matches, length."""
    pairs, m = a.shape
    n = b.shape[1]
    wide = m + 1
    i_all = np.arange(wide)
    rows = np.arange(pairs)

    def border(length):
        return 0 if kind != "nw" or length == 0 else -open_ - (length - 1) * gap

    def track():
        return _Track(np.full((pairs, wide), NEG, np.int32), np.zeros((pairs, wide), np.int32), np.zeros((pairs, wide), np.int32))

    # States of this diagonal and the ones before: of each only the cells inside the band and its borders are ever read,
    # so the arrays are used in turn and never cleared.
    h, h1, h2 = track(), track(), track()
    dd, d1, ii, i1 = track(), track(), track(), track()
    h1.s[:, 0] = 0
    floor = 0 if kind == "sw" else NEG
    best = _Track(np.full(pairs, floor, np.int64), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64))
    place = np.full(pairs, np.iinfo(np.int64).max)

    def offer(which, score, matches, length, order):
        better = (score > best.s[which]) | ((score == best.s[which]) & (order < place[which]))
        at = which[better]
        best.s[at], best.m[at], best.n[at], place[at] = score[better], matches[better], length[better], order[better]

    if kind == "nw":
        none = (la == 0) | (lb == 0)
        longest = np.maximum(la, lb)
        best.s[none] = np.where(longest[none] == 0, 0, -open_ - (longest[none] - 1) * gap)
    elif kind == "sg":
        best.s[(la == 0) | (lb == 0)] = 0

    for d in range(1, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        if d <= n:
            h.s[:, 0], h.m[:, 0], h.n[:, 0], dd.s[:, 0] = border(d), 0, 0, NEG
        if d <= m:
            h.s[:, d], h.m[:, d], h.n[:, d], ii.s[:, d] = border(d), 0, 0, NEG
        if low <= high:
            now, up = slice(low, high + 1), slice(low - 1, high)
            ca = a[:, low - 1 : high].astype(np.intp)
            cb = b[:, d - high - 1 : d - low][:, ::-1]
            # Deletion from above, insertion from the left.
            for state, before, at in ((dd, d1, up), (ii, i1, now)):
                opened, extended = h1.s[:, at] - open_, before.s[:, at] - gap
                opens = opened >= extended
                state.s[:, now] = np.where(opens, opened, extended)
                if carried:
                    state.m[:, now] = np.where(opens, h1.m[:, at], before.m[:, at])
                    state.n[:, now] = np.where(opens, h1.n[:, at], before.n[:, at]) + 1
                else:
                    state.m[:, now] = h1.m[:, at]
                    state.n[:, now] = h1.n[:, at] + 1
            diagonal = h2.s[:, up] + matrix[ca, cb]
            s = np.maximum(np.maximum(diagonal, dd.s[:, now]), ii.s[:, now])
            from_diagonal, from_above = diagonal == s, dd.s[:, now] == s
            mm = np.where(from_diagonal, h2.m[:, up] + (ca == cb), np.where(from_above, dd.m[:, now], ii.m[:, now]))
            nn = np.where(from_diagonal, h2.n[:, up] + 1, np.where(from_above, dd.n[:, now], ii.n[:, now]))
            if kind == "sw":
                dead = s <= 0
                s, mm, nn = np.where(dead, 0, s), np.where(dead, 0, mm), np.where(dead, 0, nn)
            h.s[:, now], h.m[:, now], h.n[:, now] = s, mm, nn
            if kind == "sw":
                i = i_all[low : high + 1]
                valid = (i[None, :] <= la[:, None]) & (d - i[None, :] <= lb[:, None])
                masked = np.where(valid, s, -1)
                k = masked.argmax(1)
                top = masked[rows, k]
                which = np.flatnonzero(top > 0)
                k = k[which]
                offer(which, top[which].astype(np.int64), mm[which, k], nn[which, k], (low + k).astype(np.int64))
            else:
                last = np.flatnonzero((la + lb == d) & (la > 0) & (lb > 0)) if kind == "nw" else np.flatnonzero((d - la >= 1) & (d - la <= lb) & (la > 0))
                if len(last):
                    at = la[last]
                    if kind == "nw":
                        best.s[last], best.m[last], best.n[last] = h.s[last, at], h.m[last, at], h.n[last, at]
                    else:
                        offer(last, h.s[last, at].astype(np.int64), h.m[last, at], h.n[last, at], la[last] + (d - la[last]))
                if kind == "sg":
                    side = np.flatnonzero((d - lb >= 1) & (d - lb < la) & (lb > 0))
                    if len(side):
                        at = d - lb[side]
                        offer(side, h.s[side, at].astype(np.int64), h.m[side, at], h.n[side, at], at.astype(np.int64))
        h, h1, h2 = h2, h, h1
        dd, d1, ii, i1 = d1, dd, i1, ii
    return best.s, best.m, best.n


def scores_of(matrix: str | np.ndarray) -> np.ndarray:
    """A matrix by name, or as it is."""
    if isinstance(matrix, str):
        if matrix not in MATRICES:
            raise ValueError(f"no such matrix: {matrix}")
        matrix = MATRICES[matrix]
    return np.asarray(matrix).astype(np.int32)


def _batches(order: list[int], la: list[int], lb: list[int]) -> Iterator[list[int]]:
    """Runs of pairs whose padded arrays are bounded on both sides; a single pair may exceed the bounds."""
    own: list[int] = []
    widest = longest = 0
    for k in order:
        wide, long = max(widest, la[k] + 1), max(longest, lb[k])
        if own and ((len(own) + 1) * wide > CELLS or (len(own) + 1) * long > CODES):
            yield own
            own, wide, long = [], la[k] + 1, lb[k]
        own.append(k)
        widest, longest = wide, long
    if own:
        yield own


def _trimmed(a: np.ndarray, b: np.ndarray, matrix: np.ndarray, open_: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of both that the best local alignment lies in: the same alignment is found there, with the same ties.

    Scores alone come row by row, the long right side at once (a gap along it is a
    running maximum, as opening a gap in a gap never gains). They give the cell in
    which the alignment ends. It can't reach back further than its own letters and
    the gaps that the letters of the left can pay for.
    """
    steps = np.arange(len(b) + 1, dtype=np.int32) * gap
    profile = matrix[:, b] if len(b) < CELLS else None
    h, down = np.zeros(len(b) + 1, np.int32), np.full(len(b) + 1, NEG, np.int32)
    best = i_end = j_end = 0
    for i, x in enumerate(a.tolist(), 1):
        down = np.maximum(h - open_, down - gap)
        now = np.zeros(len(b) + 1, np.int32)
        np.maximum(h[:-1] + (matrix[x][b] if profile is None else profile[x]), down[1:], out=now[1:])
        np.maximum(now, 0, out=now)
        reach = np.maximum.accumulate(now + steps)
        np.maximum(now[1:], reach[:-1] - steps[:-1] - open_, out=now[1:])
        h = now
        top = int(h.max())
        if top > best:
            best, i_end, j_end = top, i, int(h.argmax())
    most = int(np.maximum(matrix.max(1)[a[:i_end]], 0).sum())
    return a[:i_end], b[max(0, j_end - i_end - (most - best) // gap - 1) : j_end]


def align_lists(left: list[str | None], right: list[str | None], kind: str = "sw", matrix: str | np.ndarray = "blosum62", open_: int = 10, gap: int = 1, stats_mode: str = "carried") -> np.ndarray:
    """Rows of score, matches, length."""
    if kind not in KINDS or stats_mode not in ("carried", "neighbor"):
        raise ValueError(f"no such alignment: {kind}, {stats_mode}")
    scores = scores_of(matrix)
    codes = residue_codes().astype(np.int8)
    code = lambda s: codes[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
    a, b = list(map(code, left)), list(map(code, right))
    if kind == "sw" and stats_mode == "carried" and open_ >= gap > 0:
        for k in range(len(a)):
            if len(b[k]) >= LONG and len(b[k]) >= 2 * len(a[k]):
                a[k], b[k] = _trimmed(a[k], b[k], scores, open_, gap)
    out = np.zeros((len(a), 3), np.int64)
    # Like lengths of the right side together, so that a long one doesn't pad many short ones.
    order = sorted(range(len(a)), key=lambda k: (len(a[k]).bit_length(), len(b[k]).bit_length(), len(a[k]), len(b[k])))
    for own in _batches(order, [len(x) for x in a], [len(x) for x in b]):
        la, lb = (np.array([len(x[k]) for k in own], np.int64) for x in (a, b))
        pad = len(scores) - 1
        pa_, pb = np.full((len(own), la.max()), pad, np.int8), np.full((len(own), lb.max()), pad, np.int8)
        for r, k in enumerate(own):
            pa_[r, : la[r]], pb[r, : lb[r]] = a[k], b[k]
        out[own] = np.column_stack(_batch(pa_, pb, la, lb, scores, kind, open_, gap, stats_mode == "carried"))
    return out


_FIELDS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("score", "matches", "length")])


def align_pairs(pairs: DataFrame, kind: str = "sw", matrix: str | np.ndarray = "blosum62", open_: int = 10, gap: int = 1, stats_mode: str = "carried") -> DataFrame:
    """pairs with seq1 and seq2 replaced by score, matches, length. Filters belong below this step: it is a barrier for the optimizer."""
    if kind not in KINDS:
        raise ValueError(f"no such alignment: {kind}")
    scores = scores_of(matrix)
    stay = [c for c in pairs.columns if c not in ("seq1", "seq2", "score", "matches", "length")]
    source = pairs.select(*stay, "seq1", "seq2")
    schema = T.StructType([*(source.schema[c] for c in stay), *_FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                got = align_lists(part.column(len(stay)).to_pylist(), part.column(len(stay) + 1).to_pylist(), kind, scores, open_, gap, stats_mode)
                columns = [part.column(i) for i in range(len(stay))] + [pa.array(got[:, k], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def spread_by_cost(pairs: DataFrame, partitions: int) -> DataFrame:
    """pairs (with cost, written: they are read twice) dealt into about so many partitions of like cost, the costliest first.

    Pairs whose costs have the same number of binary digits share partitions, in
    proportion to the cost of all of them: a sum for each of 64 classes is all that
    is known of the pairs, and inside a class costs differ by less than a factor of
    two.
    """
    kind = F.length(F.bin(F.greatest(F.col("cost"), F.lit(1))))
    sums = {r["k"]: float(r["c"]) for r in pairs.groupBy(kind.alias("k")).agg(F.sum(F.col("cost").cast("double") + 1).alias("c")).collect()}
    total, at, place = sum(sums.values()), 0, F.lit(0)
    for k in sorted(sums, reverse=True):
        own = max(1, round(partitions * sums[k] / total))
        place = F.when(kind == k, at + F.pmod(F.xxhash64("id1", "id2"), F.lit(own))).otherwise(place)
        at += own
    return pairs.repartitionById(max(1, at), place.cast("int"))


_TABLE = "id1 long, id2 long, i int, j int, score int, matches int, length int"


def alignment_tables(pairs: DataFrame, kind: str = "sw", matrix: str | np.ndarray = "blosum62", open_: int = 10, gap: int = 1) -> DataFrame:
    """The whole table of each pair (id1, id2, seq1, seq2) for diagnosis: i, j, score, matches, length of every cell, borders too. Gap states carry their own counts."""
    if kind not in KINDS:
        raise ValueError(f"no such alignment: {kind}")
    scores = scores_of(matrix)

    def cells(a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int, int]]]:
        edge = lambda k: (0 if kind != "nw" or k == 0 else -open_ - (k - 1) * gap, 0, 0)
        none = (NEG, 0, 0)
        rows = [[edge(j) for j in range(len(b) + 1)]]
        down = [none] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            above, row, right = rows[-1], [edge(i)], none
            for j, y in enumerate(b, 1):
                moved = []
                for cell, state in ((above[j], down[j]), (row[j - 1], right)):
                    source, cost = (cell, open_) if cell[0] - open_ >= state[0] - gap else (state, gap)
                    moved.append((source[0] - cost, source[1], source[2] + 1))
                down[j], right = moved
                corner = above[j - 1]
                straight = (corner[0] + int(scores[x, y]), corner[1] + int(x == y), corner[2] + 1)
                best = max((straight, down[j], right), key=lambda c: c[0])  # the first of equals
                row.append((0, 0, 0) if kind == "sw" and best[0] <= 0 else best)
            rows.append(row)
        return rows

    def run(batches):
        codes = residue_codes()
        code = lambda s: codes[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
        for batch in batches:
            for row in batch.to_pylist():
                out = [(row["id1"], row["id2"], i, j, *c) for i, line in enumerate(cells(code(row["seq1"]), code(row["seq2"]))) for j, c in enumerate(line)]
                kinds = [pa.int64()] * 2 + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _TABLE.split(", ")])

    return pairs.select("id1", "id2", "seq1", "seq2").mapInArrow(run, _TABLE)
