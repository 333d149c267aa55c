"""Self-joins that make candidate pairs, and scopes of duplicate removal.

Pairs of sequences with a common substring of ``em`` characters come from runs
of windows and groups of ids (``shared``). Occurrences that count once for each
maximal match come from an equality join on k-mers with positions, where the
characters before both starts differ or one start is the beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alphabet import filter_out
from ..functions.combin import all_pairs, binomial, rank_pair, unrank_pair
from ..functions.scoring import length_filter, pair_cost
from ..plans.tables import numbered, written
from .kmers import distinct_kmers, distinct_with_left, with_left
from .shared import bins_of, found_in, linked_pairs, shared_windows


def _self_join(rows: DataFrame, on: str | list[str], residual: Column | None = None) -> DataFrame:
    """rows joined with itself on columns, as a and b, with a.sid < b.sid."""
    keys = [on] if isinstance(on, str) else on
    a, b = rows.alias("a"), rows.alias("b")
    condition = F.col("a.sid") < F.col("b.sid")
    for k in keys:
        condition = condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, condition if residual is None else condition & residual)


def common_substring_pairs(sequences: DataFrame, em: int, cutoff: int | None = None) -> DataFrame:
    """Distinct id1 < id2 that share a substring of em characters; with a cutoff, length ratios too low for an edge are left out in the join.

    Where a cutoff applies and a sid has several sequences, windows of all of them
    are joined: any common substring has a left-maximal one that begins at or before
    it, so the join lets through left-maximal windows only.
    """
    if cutoff is None or _sids_once(sequences):
        return linked_pairs(sequences, em, cutoff=cutoff)
    rows = distinct_with_left(sequences, em)
    maximal = (F.col("a.left") != F.col("b.left")) | (F.col("a.left") == "$")
    maximal = maximal & length_filter(F.col("a.len"), F.col("b.len"), cutoff)
    return _self_join(rows, "kmer", maximal).select(F.col("a.sid").alias("id1"), F.col("b.sid").alias("id2")).distinct()


def _sids_once(sequences: DataFrame) -> bool:
    return sequences.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("sid is not null and n > 1").isEmpty()


def common_substring_pairs_with(sequences: DataFrame, em: int, columns: list[str]) -> DataFrame:
    """common_substring_pairs with each side's whole-number columns as <column>1 and <column>2. They travel with the ids, so pairs aren't joined to the sequences, unless a sid has several."""
    if _sids_once(sequences):
        return linked_pairs(sequences, em, columns)
    return with_sequences(common_substring_pairs(sequences, em), sequences, columns)


def maximal_starts(sequences: DataFrame, em: int, skip: list[str] | None = None, window: int | None = None) -> DataFrame:
    """sid, pid, kmer, left for each window of em characters; with skip patterns, windows whose first ``window`` characters match one are left out."""
    out = with_left(sequences, em)
    return out.where(~filter_out(F.substring("kmer", 1, window or em), skip)) if skip else out


def maximal_matches(sequences: DataFrame, em: int, skip: list[str] | None = None, window: int | None = None) -> DataFrame:
    """id1, pos1, id2, pos2: starts of left-maximal matches of at least em characters, a row for each occurrence."""
    rows = maximal_starts(sequences, em, skip, window)
    left = (F.col("a.left") != F.col("b.left")) | (F.col("a.pid") == 1) | (F.col("b.pid") == 1)
    return _self_join(rows, "kmer", left).select(F.col("a.sid").alias("id1"), F.col("a.pid").alias("pos1"), F.col("b.sid").alias("id2"), F.col("b.pid").alias("pos2"))


def match_groups(sequences: DataFrame, em: int) -> DataFrame:
    """kmer, sid: for each window of em characters that two sequences or more share, these sequences.

    All pairs of sequences with a common substring of em characters lie together in
    one group or more, and every pair of a group has one, so the groups hold the
    same links as the pairs in space that is linear in the windows: text that a
    million sequences share is a million rows, not their square.
    """
    return shared_windows(sequences, em, members=True)


def sequence_classes(sequences: DataFrame) -> DataFrame:
    """sid, class: sequences of equal letters have one class, the smallest of their sids."""
    keyed = sequences.select("sid", F.sha2("seq", 256).alias("digest"))
    least = keyed.groupBy("digest").agg(F.min("sid").alias("class"))
    return keyed.join(least, "digest").select("sid", "class")


def class_pairs(sequences: DataFrame, members: DataFrame, em: int, cutoff: int | None = None) -> DataFrame:
    """class1, class2, links: pairs of classes with a common substring of em characters, and the pairs of members that each stands for.

    Copies are compared once: a class is its representative in the join, and a class
    of several members of em characters or more is linked with itself.
    """
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    alone = sequences.join(sizes.select(F.col("class").alias("sid"), "n"), "sid")
    inside = alone.where((F.col("n") > 1) & (F.col("len") >= em)).select(F.col("sid").alias("class1"), F.col("sid").alias("class2"), F.shiftright(F.col("n") * (F.col("n") - 1), 1).alias("links"))
    across = linked_pairs(alone, em, ["n"], cutoff, bins_of(sequences)).select(F.col("id1").alias("class1"), F.col("id2").alias("class2"), (F.col("n1") * F.col("n2")).alias("links"))
    return inside.unionByName(across)


def _extended(seeds: list, one: bytes, two: bytes, em: int) -> int:
    """The longest match that starts at one of the seeds; a step doubles while both texts agree, so work follows the match."""
    best = em
    for s in seeds:
        a, b = s["pos1"] - 1, s["pos2"] - 1
        most = min(len(one) - a, len(two) - b)
        if most <= best or one[a : a + best] != two[b : b + best]:
            continue
        low, step = best, 64
        while low < most and one[a + low : a + low + step] == two[b + low : b + low + step] and low + step <= most:
            low, step = low + step, 2 * step
        high = min(most, low + step)
        while low < high:  # one[a:a+low] agrees; is there more?
            mid = (low + high + 1) // 2
            if one[a + low : a + mid] == two[b + low : b + mid]:
                low = mid
            else:
                high = mid - 1
        best = low
    return best


def longest_matches(sequences: DataFrame, em: int) -> DataFrame:
    """id1, id2, longest: the longest common substring of each pair that has one of em characters or more.

    The longest match is left-maximal, so only such windows are joined, a row a
    match and not one for each of its windows; sequences are joined to a pair once,
    and each seed is followed to the right in the texts.
    """
    import pyarrow as pa

    seeds = maximal_matches(sequences, em).groupBy("id1", "id2").agg(F.collect_list(F.struct("pos1", "pos2")).alias("seeds"))
    both = with_sequences(seeds, sequences, ["seq"]).select("id1", "id2", "seeds", "seq1", "seq2")
    schema = T.StructType([both.schema["id1"], both.schema["id2"], T.StructField("longest", T.LongType())])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                found = [_extended(s, x.encode(), y.encode(), em) for s, x, y in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.int64())], ["id1", "id2", "longest"])

    return both.mapInArrow(run, schema)


def cross_set_pairs(left: DataFrame, right: DataFrame, em: int) -> DataFrame:
    """Distinct (left_id, right_id) of two sets that share a substring of em characters. A small right side is sent to all tasks, a larger one is joined by windows."""
    found = found_in(left, right, em)
    if found is not None:
        return found
    a = distinct_kmers(left, em).alias("a")
    b = distinct_kmers(right, em).alias("b")
    return a.join(b, F.col("a.kmer") == F.col("b.kmer")).select(F.col("a.sid").alias("left_id"), F.col("b.sid").alias("right_id")).distinct()


def equal_left_pairs(sequences: DataFrame, em: int) -> DataFrame:
    """The variant that skips the tree: pairs inside buckets of em characters whose left characters are equal and not at a beginning, distinct."""
    rows = maximal_starts(sequences, em)
    same = (F.col("a.left") == F.col("b.left")) & (F.col("a.pid") > 1) & (F.col("b.pid") > 1)
    return _self_join(rows, "kmer", same).select(F.col("a.sid").alias("id1"), F.col("b.sid").alias("id2")).distinct()


def brute_force_pairs(sequences: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    """pos, id1, id2 of all pairs of n sequences numbered from 0 (or the first ones in colexicographic order), by rank instead of a nested loop."""
    return all_pairs(sequences.sparkSession, n, limit)


def numbers(sequences: DataFrame) -> DataFrame:
    """number, sid: the sids in order, numbered from 0, whatever they are; repeated ones once."""
    ordered = sequences.select("sid").where("sid is not null").distinct().repartitionByRange("sid").sortWithinPartitions("sid")
    return numbered(ordered, "number").select("number", "sid")


def all_sequence_pairs(sequences: DataFrame, limit: int | None = None) -> DataFrame:
    """pos, id1, id2 of all pairs of sequences, id1 < id2, in colexicographic order of the sids' numbers: sids may have gaps."""
    known = numbers(sequences)
    found = brute_force_pairs(sequences, known.count(), limit)
    one, two = (known.select(F.col("number").alias(f"id{k}"), F.col("sid").alias(f"sid{k}")) for k in (1, 2))
    return found.join(one, "id1").join(two, "id2").select("pos", F.col("sid1").alias("id1"), F.col("sid2").alias("id2"))


def selectivity_limit(n: int, selectivity: float) -> int:
    return int(binomial(n, 2) * selectivity + 0.5)


def probe_pairs(sequences: DataFrame, probes: int) -> DataFrame:
    """id1, id2, probe: each of the first ``probes`` sequences by sid (id2, numbered from 0) with every sequence, itself too: a stated query set against all rows."""
    first = sequences.select(F.col("sid").alias("id2")).distinct().orderBy("id2").limit(probes)
    q = first.select("id2", (F.row_number().over(Window.orderBy("id2")) - 1).cast("long").alias("probe"))
    return sequences.select(F.col("sid").alias("id1")).join(F.broadcast(q), F.lit(True))


def with_sequences(pairs: DataFrame, sequences: DataFrame, columns: list[str] | None = None, replicate: bool = False) -> DataFrame:
    """The pairs with each side's columns as <column>1 and <column>2: two equality joins, after duplicates are gone. ``replicate`` sends all sequences to all tasks; the caller knows their size."""
    names = columns or ["seq", "len"]
    source = F.broadcast(sequences) if replicate else sequences
    one = source.select(F.col("sid").alias("id1"), *(F.col(c).alias(f"{c}1") for c in names))
    two = source.select(F.col("sid").alias("id2"), *(F.col(c).alias(f"{c}2") for c in names))
    return pairs.join(one, "id1").join(two, "id2")


def tiles(pairs: DataFrame, block: int) -> DataFrame:
    """Adds tile: -1 - b for pairs inside block b of the ids, else the rank of the two blocks."""
    a, b = F.floor(F.col("id1") / block), F.floor(F.col("id2") / block)
    return pairs.withColumn("tile", F.when(a == b, -1 - a).otherwise(rank_pair(F.least(a, b), F.greatest(a, b))))


def tile_blocks(tile: Column) -> tuple[Column, Column]:
    low, high = unrank_pair(F.greatest(tile, F.lit(0)))
    return F.when(tile < 0, -1 - tile).otherwise(low), F.when(tile < 0, -1 - tile).otherwise(high)


def _block_sizes(sequences: DataFrame, block: int) -> DataFrame:
    return sequences.groupBy(F.floor(F.col("sid") / block).alias("blk")).agg(F.count(F.lit(1)).alias("n"))


def possible_per_tile(sequences: DataFrame, block: int) -> DataFrame:
    """tile, possible for every tile: n(n-1)/2 inside a block, the product across two. Tiles are ranks of block numbers, joined to the sizes, so blocks aren't joined by a nested loop."""
    sizes = _block_sizes(sequences, block)
    inside = sizes.select((-1 - F.col("blk")).alias("tile"), F.shiftright(F.col("n") * (F.col("n") - 1), 1).alias("possible"))
    last = sizes.agg(F.max("blk")).first()[0]
    every = all_pairs(sequences.sparkSession, 0 if last is None else last + 1)
    return inside.unionByName(_with_sizes(every.select(F.col("pos").alias("tile"), F.col("id1").alias("low"), F.col("id2").alias("high")), sizes))


def _with_sizes(across: DataFrame, sizes: DataFrame) -> DataFrame:
    one, two = sizes.select(F.col("blk").alias("low"), F.col("n").alias("n1")), sizes.select(F.col("blk").alias("high"), F.col("n").alias("n2"))
    return across.join(one, "low").join(two, "high").select("tile", (F.col("n1") * F.col("n2")).alias("possible"))


def tile_counts(sequences: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """tile, tiles, possible, generated: a row for each tile that has pairs, and one with a null tile for all others together, so rows follow the pairs and not the square of the blocks."""
    sizes = _block_sizes(sequences, block)
    found = written(tiles(pairs, block).groupBy("tile").agg(F.count(F.lit(1)).alias("generated")), "tiles")
    low, high = tile_blocks(F.col("tile"))
    inside = found.where("tile < 0").join(sizes.select((-1 - F.col("blk")).alias("tile"), F.shiftright(F.col("n") * (F.col("n") - 1), 1).alias("possible")), "tile").select("tile", "possible")
    across = _with_sizes(found.where("tile >= 0").select("tile", low.alias("low"), high.alias("high")), sizes)
    some = found.join(inside.unionByName(across), "tile").select("tile", F.lit(1).cast("long").alias("tiles"), "possible", "generated")
    zero = F.lit(0).cast("long")
    whole = sizes.agg(F.count(F.lit(1)).alias("b"), F.coalesce(F.sum("n"), zero).alias("s"))
    seen = some.agg(F.count(F.lit(1)).alias("t"), F.coalesce(F.sum("possible"), zero).alias("p"))
    rest = whole.join(seen, F.lit(True)).select(
        F.lit(None).cast("long").alias("tile"), (F.shiftright(F.col("b") * (F.col("b") + 1), 1) - F.col("t")).alias("tiles"),
        (F.shiftright(F.col("s") * (F.col("s") - 1), 1) - F.col("p")).alias("possible"), zero.alias("generated"),
    )
    return some.unionByName(rest)


def canonical(pairs: DataFrame) -> DataFrame:
    """id1 < id2; pairs of an id with itself go."""
    rest = [c for c in pairs.columns if c not in ("id1", "id2")]
    return pairs.where("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), *rest)


def deduplicate(pairs: DataFrame, scope: str, tile: str | None = None) -> DataFrame:
    """Distinct pairs in a scope: none, global, tile or file (a column), partition (each task its own, no shuffle; memory holds a bounded number of pairs)."""
    if scope == "none":
        return pairs
    if scope in ("global", "process"):
        return pairs.select("id1", "id2").distinct()
    if scope in ("tile", "file"):
        return pairs.dropDuplicates([tile or scope, "id1", "id2"])
    if scope == "partition":
        ordered = pairs.select("id1", "id2").sortWithinPartitions("id1", "id2")
        return ordered.mapInArrow(_drop_neighbours, ordered.schema)
    raise ValueError(f"no such scope: {scope}")


def _drop_neighbours(batches):
    """Sorted pairs without repeats; across batches only the last pair is kept."""
    import numpy as np
    import pyarrow as pa

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.append(last != (x[0], y[0]), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        last = (x[-1], y[-1])
        yield b.filter(pa.array(new))


def unseen(pairs: DataFrame, history: DataFrame) -> DataFrame:
    return pairs.join(history.select("id1", "id2"), ["id1", "id2"], "left_anti")


def distinct_by_file(pairs: DataFrame) -> DataFrame:
    """Each file's pairs once, in canonical order."""
    return canonical(pairs).dropDuplicates(["file", "id1", "id2"])


def file_duplicates(pairs: DataFrame) -> DataFrame:
    """For each file: pairs, distinct pairs, removed, ratio."""
    distinct = canonical(pairs).groupBy("file", "id1", "id2").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("file").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("kept")).withColumn("removed", F.col("pairs") - F.col("kept")).withColumn("ratio", F.col("removed") / F.col("pairs"))


def sorted_by_range(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in global order by id ranges."""
    return pairs.select("id1", "id2").distinct().repartitionByRange("id1").sortWithinPartitions("id1", "id2")


def with_cost(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("cost", pair_cost(F.col("len1"), F.col("len2")))


def by_size(sizes: DataFrame) -> DataFrame:
    """Buckets by size, the smallest first."""
    return sizes.orderBy("size", "kmer")


def by_length(sequences: DataFrame, descending: bool = True) -> DataFrame:
    """Sequences by length, then sid."""
    return sequences.orderBy(F.col("len").desc() if descending else F.col("len"), "sid")


def by_cost(pairs: DataFrame) -> DataFrame:
    """Largest first."""
    return pairs.orderBy(F.col("cost").desc(), "id1", "id2")
