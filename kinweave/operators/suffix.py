"""Suffix tables for diagnosis: sorted suffixes with common-prefix lengths and left characters, and the tree that they make.

No suffix is ever a string of its own: suffixes are ranked by their first WIDTH
characters, then by pairs of ranks of twice the width, until no two are alike
(rank doubling). So rows are of bounded size, and a sequence of L letters takes L
rows a round and log2(L / WIDTH) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import numbered, written

SENTINEL = "$"
#: Characters of a suffix that the first round sorts by; the shown ones are among them.
WIDTH = 32
_SHOWN = 20


def packed_offsets(sequences: DataFrame, block: int = 4096) -> DataFrame:
    """sid, begin, end: the place of each sequence in the buffer of all, each with a sentinel behind it.

    Lengths are summed in blocks of ids, so the only window over everything is
    over the blocks' sums.
    """
    size = F.col("len").cast("long") + 1
    rows = sequences.select("sid", size.alias("size"), F.floor(F.col("sid") / block).alias("blk"))
    inside = rows.withColumn("before", F.sum("size").over(Window.partitionBy("blk").orderBy("sid")) - F.col("size"))
    blocks = rows.groupBy("blk").agg(F.sum("size").alias("total"))
    blocks = blocks.select("blk", (F.sum("total").over(Window.orderBy("blk")) - F.col("total")).alias("base"))
    begin = F.col("base") + F.col("before")
    return inside.join(blocks, "blk").select("sid", begin.alias("begin"), (begin + F.col("size") - 1).alias("end"))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two short strings begin with alike."""
    shorter = F.least(F.length(a), F.length(b))
    differs = F.transform(F.sequence(F.lit(1), shorter + 1), lambda i: F.when(i > shorter, True).otherwise(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.array_position(differs, True) - 1).cast("long")


def _heads(sequences: DataFrame) -> DataFrame:
    """sid, pos (0-based), head: each suffix's first WIDTH characters, fewer at the end, and the character before it."""
    from .kmers import _placed

    padded = F.concat(F.lit(SENTINEL), F.col("seq"), F.lit(SENTINEL * WIDTH))
    rows = _placed(sequences.where(F.col("len") > 0), padded, F.col("len") + 1 + WIDTH, WIDTH + 1)
    # The last window begins at the end sentinels: it is no suffix.
    whole = rows.withColumn("head", F.rtrim(F.substring("window", 2, WIDTH), F.lit(SENTINEL))).where(F.col("head") != "")
    return whole.select("sid", (F.col("pid") - 1).alias("pos"), "head", F.substring("window", 1, 1).alias("bwt"))


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with rank: how many have a smaller key. Equal keys are counted before anything is sorted."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    ordered = written(counts.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "keys")
    inside = ordered.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_c"))
    totals = ordered.groupBy("_part").agg(F.sum("_c").alias("_t"))
    bases = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_base"))
    ranks = inside.join(F.broadcast(bases), "_part").select(*(F.col(k).alias(f"_{k}") for k in key), (F.col("_base") + F.col("_upto")).alias("rank"), "_c")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(ranks, same).drop(*(f"_{k}" for k in key))


def _levels(sequences: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The suffixes with their heads, and for each width a table of sid, pos, rank; the last one has no equal ranks but those of equal suffixes."""
    heads = written(_heads(sequences), "heads")
    longest = sequences.agg(F.max("len")).first()[0] or 0
    now = written(_ranked(heads, ["head"]).select("sid", "pos", "rank", "_c"), "ranks")
    out, width = [(WIDTH, now)], WIDTH
    while width < longest and not now.where("_c > 1").isEmpty():
        later = now.select("sid", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        # A suffix that ends before is smaller than any that goes on.
        both = now.select("sid", "pos", F.col("rank").alias("first")).join(later, ["sid", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
        now = written(_ranked(both, ["first", "next"]).select("sid", "pos", "rank", "_c"), "ranks")
        width *= 2
        out.append((width, now))
    return heads, out


def suffix_table(sequences: DataFrame) -> DataFrame:
    """idx, sa, lcp, bwt, t, sid, pos (0-based), suffix: all suffixes in order; lcp with the suffix before.

    Suffixes end at their sequence, so common prefixes are clamped there; equal
    suffixes are in the order of sid. A common prefix is the sum of the widths at
    which both suffixes, moved on by what they share already, have equal ranks,
    from the widest down, and of what their heads share.
    """
    heads, levels = _levels(sequences)
    last = levels[-1][1].select("sid", "pos", "rank")
    ordered = last.repartitionByRange("rank", "sid", "pos").sortWithinPartitions("rank", "sid", "pos")
    order = written(numbered(ordered, "idx").select("idx", "sid", "pos"), "order")
    before = order.select((F.col("idx") + 1).alias("idx"), F.col("sid").alias("sid0"), F.col("pos").alias("pos0"))
    pairs = order.join(before, "idx", "left").withColumn("lcp", F.lit(0).cast("long"))
    for width, ranks in reversed(levels[:-1] if len(levels) > 1 else []):
        one, two = (ranks.select(F.col("sid").alias(f"s{k}"), F.col("pos").alias(f"p{k}"), F.col("rank").alias(f"r{k}"), *([F.col("_c").alias("many")] if k else [])) for k in (0, 1))
        reached = pairs.join(two, (F.col("sid") == F.col("s1")) & (F.col("pos") + F.col("lcp") == F.col("p1")), "left")
        reached = reached.join(one, (F.col("sid0") == F.col("s0")) & (F.col("pos0") + F.col("lcp") == F.col("p0")), "left")
        # Equal ranks are equal heads; one that is shorter than the width ends there and is told apart below.
        whole = (F.col("r0") == F.col("r1")) & (F.col("pos") + F.col("lcp") + width <= F.col("l1")) & (F.col("pos0") + F.col("lcp") + width <= F.col("l0"))
        lens = sequences.select(F.col("sid").alias("n1"), F.col("len").alias("l1")), sequences.select(F.col("sid").alias("n0"), F.col("len").alias("l0"))
        reached = reached.join(lens[0], F.col("sid") == F.col("n1")).join(lens[1], F.col("sid0") == F.col("n0"), "left")
        pairs = reached.select("idx", "sid", "pos", "sid0", "pos0", (F.col("lcp") + F.when(F.coalesce(whole, F.lit(False)), width).otherwise(0)).alias("lcp"))
    a = heads.select(F.col("sid").alias("s1"), F.col("pos").alias("p1"), F.col("head").alias("h1"))
    b = heads.select(F.col("sid").alias("s0"), F.col("pos").alias("p0"), F.col("head").alias("h0"))
    near = pairs.join(a, (F.col("sid") == F.col("s1")) & (F.col("pos") + F.col("lcp") == F.col("p1")), "left")
    near = near.join(b, (F.col("sid0") == F.col("s0")) & (F.col("pos0") + F.col("lcp") == F.col("p0")), "left")
    with_lcp = near.select("idx", "sid", "pos", (F.col("lcp") + common_prefix(F.col("h1"), F.col("h0"))).alias("lcp"))
    shown = with_lcp.join(heads, ["sid", "pos"]).join(packed_offsets(sequences), "sid")
    return shown.select("idx", (F.col("begin") + F.col("pos")).alias("sa"), "lcp", "bwt", F.substring("head", 1, 1).alias("t"), "sid", "pos", F.substring("head", 1, _SHOWN).alias("suffix"))


def check_suffix_table(table: DataFrame, sequences: DataFrame) -> DataFrame:
    """missing, repeated, unordered, wrong_lcp: suffixes that the table lacks or has twice, neighbours that aren't in order where their common prefix ends, and prefixes that differ before its end."""
    from .kmers import slide

    starts = slide(sequences, 1).select("sid", (F.col("pid") - 1).alias("pos"))
    counts = table.groupBy("sid", "pos").agg(F.count(F.lit(1)).alias("n"))
    missing = starts.join(counts, ["sid", "pos"], "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))
    letters = slide(sequences, 1).select("sid", (F.col("pid") - 1).alias("pos"), F.col("kmer").alias("letter"))
    before = table.select((F.col("idx") + 1).alias("idx"), F.col("sid").alias("sid0"), F.col("pos").alias("pos0"))
    pairs = table.select("idx", "sid", "pos", "lcp").join(before, "idx")
    one = letters.select(F.col("sid").alias("s1"), F.col("pos").alias("p1"), F.col("letter").alias("x1"))
    two = letters.select(F.col("sid").alias("s0"), F.col("pos").alias("p0"), F.col("letter").alias("x0"))
    ends = pairs.join(one, (F.col("sid") == F.col("s1")) & (F.col("pos") + F.col("lcp") == F.col("p1")), "left")
    ends = ends.join(two, (F.col("sid0") == F.col("s0")) & (F.col("pos0") + F.col("lcp") == F.col("p0")), "left")
    # The suffix before is the smaller one: it ends, or its letter is smaller; equal suffixes are in the order of sid.
    fine = F.when(F.col("x0").isNull(), F.col("x1").isNotNull() | (F.col("sid0") < F.col("sid"))).otherwise(F.coalesce(F.col("x0") < F.col("x1"), F.lit(False)))
    order = ends.agg(F.count_if(~fine).alias("unordered"))
    inner = pairs.where("lcp > 0").join(one, (F.col("sid") == F.col("s1")) & (F.col("pos") + F.col("lcp") - 1 == F.col("p1")), "left")
    inner = inner.join(two, (F.col("sid0") == F.col("s0")) & (F.col("pos0") + F.col("lcp") - 1 == F.col("p0")), "left")
    wrong = inner.agg(F.count_if(~F.coalesce(F.col("x0") == F.col("x1"), F.lit(False))).alias("wrong_lcp"))
    return missing.join(order, F.lit(True)).join(wrong, F.lit(True))


def tree_nodes(sequences: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """node, depth, fanout: the inner nodes of the tree of all suffixes but its root. A node is a string that goes on in two ways or more; ends of sequences are ways of their own.

    Every node is the common prefix of two neighbours, so strings are named by the
    hash of that prefix, cut from the sequence where it lies, and only its own
    neighbours' prefixes count. A node's children are one more than the neighbours
    that share just its string.
    """
    found = table if table is not None else suffix_table(sequences)
    at = found.where("lcp > 0").groupBy("sid").agg(F.collect_list(F.struct("pos", "lcp")).alias("at")).join(sequences.select("sid", "seq"), "sid")
    cut = F.transform("at", lambda p: F.struct(F.sha2(F.substring(F.col("seq"), (p["pos"] + 1).cast("int"), p["lcp"].cast("int")), 256).alias("node"), p["lcp"].alias("depth")))
    each = at.select(F.explode(cut).alias("x")).select("x.node", "x.depth")
    return each.groupBy("node", "depth").agg((F.count(F.lit(1)) + 1).alias("fanout"))


def tree_stats(sequences: DataFrame) -> DataFrame:
    """Leaves, inner nodes (the root not counted), their mean and greatest depth, and their mean fanout."""
    nodes = tree_nodes(sequences)
    leaves = sequences.agg(F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("n_leaves"))
    inner = nodes.agg(F.count(F.lit(1)).alias("n_inner"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("most_depth"), F.avg("fanout").alias("mean_fanout"), F.max("fanout").alias("most_fanout"))
    return leaves.join(inner, F.lit(True))


def by_depth(nodes: DataFrame) -> DataFrame:
    """Nodes by depth, the deepest first, as a tree is worked off from below."""
    return nodes.orderBy(F.col("depth").desc(), "node")


def tree_dump(sequences: DataFrame) -> DataFrame:
    """idx, bwt, sid, pid (1-based), suffix: the leaves of the tree in order."""
    return suffix_table(sequences).select("idx", "bwt", "sid", (F.col("pos") + 1).alias("pid"), "suffix")


def bucket_boundaries(sequences: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers, the boundaries that common prefixes under k make among sorted suffixes."""
    from .kmers import slide

    return slide(sequences, k).agg(F.countDistinct("kmer").alias("n_buckets"))
