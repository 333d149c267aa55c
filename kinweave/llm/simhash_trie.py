"""SimHash near-duplicates by a binary trie self-join (operator 8).

Fingerprints that differ in at most ``budget`` bits are linked; a document's
class is the smallest id it reaches. Equal fingerprints are one trie leaf, so a
group of copies is one row from the first aggregate on.

The join walks pairs of trie nodes level by level. A pair carries the number of
bits in which its two prefixes differ; it splits into child pairs, and is
dropped once that number exceeds the budget. Nodes are ranges of a sorted array,
and all pairs of a level are split at once.

Over a cluster the trie is walked in groups: fingerprints that agree on one of
``budget + 1`` parts of the bits (a link within the budget leaves one part
untouched). A group that holds more than ``group_cap`` fingerprints is dealt
again, by the parts of its remaining bits, until all are small; as fingerprints
are distinct, that ends, and nothing is dropped. A task walks its groups in
batches of bounded size and returns a spanning forest of the links it finds, so
a dense group costs rows in proportion to its members, not to its pairs.

Defined results: a null, empty or blank text has fingerprint zero and links like
any other; rows with a null id take part, their class is the smallest id that
isn't null, null if there is none; repeated rows stay, with one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, forget, texts, written
from .graph import components

BUDGET = 3
SHINGLE = 3
SEED = 42
GROUP_CAP = 8192
#: Fingerprints walked at once, and pairs of nodes split at once.
BATCH = 65_536
FRONTIER = 400_000
_ONES = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 16_384):
        own = words[low : low + 16_384 + shingle - 1]
        line = b" ".join(own)
        ends = np.cumsum([len(w) + 1 for w in own])
        starts = [0, *ends[: len(own) - shingle].tolist()]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Adds fp, the fingerprint as a signed long."""

    def make():
        def compute(values: list) -> list[list]:
            return [np.array([fingerprint(v, shingle, seed) for v in values], np.uint64).view(np.int64).tolist()]

        return compute

    return append_columns(df, make, [("fp", T.LongType())], keep=keep)


def parts(mask: int, count: int) -> list[int]:
    """The bits outside mask, dealt into count runs of as equal length as can be."""
    free = [b for b in reversed(range(64)) if not mask >> b & 1]
    runs = np.array_split(np.array(free, np.int64), min(count, len(free)) or 1)
    return [sum(1 << int(b) for b in run) for run in runs]


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root: positions) of the links inside each group. values: unsigned, sorted and distinct in each group; starts: where groups start."""
    n = len(values)
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum(values >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)])
        return ones[depth]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    roots = np.arange(n)

    def settle() -> None:
        nonlocal roots, held
        everything = [*found, (np.arange(n), roots)]
        roots = local_roots(n, *(np.concatenate(x) for x in zip(*everything, strict=True)))
        found.clear()
        held = 0

    bounds = np.append(starts, n)
    large = np.flatnonzero(np.diff(bounds) > 1)
    lo, hi = bounds[large], bounds[large + 1]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > frontier:
            cut = len(al) // 2
            stack += [(depth, *(x[:cut] for x in (al, ah, bl, bh, err))), (depth, *(x[cut:] for x in (al, ah, bl, bh, err)))]
            continue
        size = (ah - al) * (bh - bl)
        few = (size <= 16) | (depth >= 64)
        if few.any():  # a few leaves: compare them at once
            k = size[few]
            owner = np.repeat(np.arange(len(k)), k)
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            wide = (bh - bl)[few][owner]
            x, y = al[few][owner] + nth // wide, bl[few][owner] + nth % wide
            near = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            if near.any():
                found.append((x[near], y[near]))
                held += int(near.sum())
                if held > 4 * frontier:
                    settle()
            al, ah, bl, bh, err = (x[~few] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        c = ones_before(depth)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        cross = al != bl
        children = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            tuple(x[cross] for x in (am, ah, bl, bm, err + 1)),
        ]
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*children, strict=True))
        go = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        if go.any():
            stack.append((depth + 1, *(x[go] for x in (a0, a1, b0, b1, e))))
    settle()
    member = np.flatnonzero(roots != np.arange(n))
    return member, roots[member]


def _walk(batch: int, budget: int):
    """Groups of (mask, value, fp), which come sorted, into links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            fp = rows[:, 2]
            order = np.lexsort((fp.view(np.uint64), rows[:, 1], rows[:, 0]))
            rows, fp = rows[order], fp[order]
            new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
            u, v = trie_links(fp.view(np.uint64), np.flatnonzero(new), budget)
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

        for b in batches:
            rest = np.concatenate([rest, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])])
            if len(rest) >= batch:
                last = (rest[:, :2] != rest[-1, :2]).any(1)
                keep = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if keep:
                    yield links(np.ascontiguousarray(rest[:keep]))
                    rest = rest[keep:]
        if len(rest):
            yield links(np.ascontiguousarray(rest))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, budget: int = BUDGET, group_cap: int = GROUP_CAP, batch: int = BATCH) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect whatever is within the budget."""
    todo = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    masks = {0}
    found: DataFrame | None = None
    while True:
        split = {m: [_signed(m | p) for p in parts(m, budget + 1)] for m in masks}
        dealt = F.create_map(*(x for m, next_masks in split.items() for x in (F.lit(_signed(m)), F.array(*map(F.lit, next_masks)))))
        rows = todo.select("fp", F.explode(dealt[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        masks = {x & _ONES for own in split.values() for x in own}
        hot = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_cap).select("mask", "value")
        hot = written(hot, "hot-groups")
        any_hot = bool(hot.take(1))
        cool = rows.join(hot, ["mask", "value"], "left_anti") if any_hot else rows
        sorted_rows = cool.repartition("mask", "value").sortWithinPartitions("mask", "value")
        now = sorted_rows.mapInArrow(_walk(batch, budget), "u long, v long")
        found = now if found is None else found.unionByName(now)
        if not any_hot:
            return found
        todo = rows.join(hot, ["mask", "value"], "left_semi").select("mask", "fp")


def near_duplicates(df: DataFrame, budget: int = BUDGET, group_cap: int = GROUP_CAP, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: a row for each row of documents."""
    docs = written(fingerprints(texts(df), ["doc_id"], shingle), "fingerprints")
    leaves = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "leaves")
    found = written(links(leaves.select("fp"), budget, group_cap).distinct(), "links")
    roots = components(found)
    rooted = leaves.join(roots, leaves["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    forget(leaves, found)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> "F.Column":
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
