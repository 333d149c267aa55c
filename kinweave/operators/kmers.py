"""k-mer windows, buckets and their refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, bucket_index, filter_out
from ..plans.tables import written
from .shared import window_counts


#: Starts in a block. A substring is found by walking from the beginning, so windows are cut from blocks, not from the whole sequence.
BLOCK = 64


def _blocks(seq: Column, length: Column, width: int) -> Column:
    """Pieces of a sequence that hold the windows of BLOCK starts each."""
    last = F.floor((length - width) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct((c * BLOCK).alias("base"), F.substring(seq, c * BLOCK + 1, F.lit(BLOCK + width - 1)).alias("text")))


def windows(seq: Column, length: Column, width: int) -> Column:
    """An array of all windows of width characters, for sequences of width characters or more."""
    inside = lambda b: F.transform(F.sequence(F.lit(1), F.length(b["text"]) - width + 1), lambda i: F.substring(b["text"], i, F.lit(width)))
    return F.flatten(F.transform(_blocks(seq, length, width), inside))


def _placed(sequences: DataFrame, seq: Column, length: Column, width: int) -> DataFrame:
    """sid, pid, window. Blocks are rows first and starts second, so windows are cut in generated code from short strings."""
    blocks = sequences.select("sid", F.explode(_blocks(seq, length, width)).alias("b")).select("sid", "b.base", "b.text")
    starts = blocks.select("sid", "base", "text", F.explode(F.sequence(F.lit(1), F.length("text") - width + 1)).alias("i"))
    return starts.select("sid", (F.col("base") + F.col("i")).cast("long").alias("pid"), F.substring("text", F.col("i"), F.lit(width)).alias("window"))


def slide(sequences: DataFrame, k: int, skip: list[str] | None = None) -> DataFrame:
    """sid, pid (1-based), kmer for every window of k characters; windows that match a skip pattern are left out."""
    out = _placed(sequences.where(F.col("len") >= k), F.col("seq"), F.col("len"), k).withColumnRenamed("window", "kmer")
    return out.where(~filter_out(F.col("kmer"), skip)) if skip else out


def distinct_kmers(sequences: DataFrame, k: int, also: list[str] | None = None) -> DataFrame:
    """sid, len (and further columns), kmer once for each sequence; repeats go before the rows are made, so no shuffle is needed."""
    return sequences.where(F.col("len") >= k).select("sid", "len", *(also or []), F.explode(F.array_distinct(windows(F.col("seq"), F.col("len"), k))).alias("kmer"))


def with_left(sequences: DataFrame, k: int, sentinel: str = "$") -> DataFrame:
    """sid, pid, kmer and the character before it, the sentinel at the beginning."""
    led = F.concat(F.lit(sentinel), F.col("seq"))
    out = _placed(sequences.where(F.col("len") >= k), led, F.col("len") + 1, k + 1)
    return out.select("sid", "pid", F.substring("window", 2, k).alias("kmer"), F.substring("window", 1, 1).alias("left"))


def distinct_with_left(sequences: DataFrame, k: int, sentinel: str = "$") -> DataFrame:
    """sid, len, kmer, left once for each sequence. They are one string until they are distinct: strings are told apart by hash, structs by comparing all."""
    led = F.concat(F.lit(sentinel), F.col("seq"))
    rows = sequences.where(F.col("len") >= k).select("sid", "len", F.explode(F.array_distinct(windows(led, F.col("len") + 1, k + 1))).alias("w"))
    return rows.select("sid", "len", F.substring("w", 2, k).alias("kmer"), F.substring("w", 1, 1).alias("left"))


def suffixes(sequences: DataFrame) -> DataFrame:
    """All suffix starts in one bucket: sid, pid, bid 0, k 0."""
    return slide(sequences, 1).select("sid", "pid", F.lit(0).cast("long").alias("bid"), F.lit(0).alias("k"))


def bucketed(sequences: DataFrame, k: int, skip: list[str] | None = None, alphabet: str = LETTERS) -> DataFrame:
    """sid, pid, bid, k, kmer."""
    return slide(sequences, k, skip).select("sid", "pid", bucket_index(F.col("kmer"), k, alphabet).alias("bid"), F.lit(k).alias("k"), "kmer")


def bucket_sizes(windows: DataFrame, owners: int | None = None) -> DataFrame:
    """kmer, k, size of each bucket (and its owner among so many)."""
    out = windows.groupBy("kmer").agg(F.count(F.lit(1)).alias("size")).withColumn("k", F.length("kmer"))
    if owners:
        out = out.withColumn("owner", F.pmod(F.xxhash64("kmer"), F.lit(owners)))
    return out


def counted(sequences: DataFrame, k: int, skip: list[str] | None = None) -> DataFrame:
    """kmer, size of each bucket of windows, counted where the texts are read; windows that match a skip pattern are left out."""
    out = window_counts(sequences, k, LETTERS)
    return out.where(~filter_out(F.col("kmer"), skip)) if skip else out


def moments(column: str | Column) -> list[Column]:
    """Count, mean, sum of squared deviations, sample deviation, sum, least and largest of a column."""
    c = F.col(column) if isinstance(column, str) else column
    n = F.count(c)
    return [
        n.alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * n).alias("m2"), F.stddev_samp(c).alias("stddev"),
        F.sum(c.cast("long")).alias("sum"), F.min(c).alias("least"), F.max(c).alias("most"),
    ]


def bucket_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(*moments("size"))


def refine(sequences: DataFrame, k: int, em: int, cutoff: float, skip: list[str] | None = None, max_rounds: int = 64) -> DataFrame:
    """sid, pid, kmer, k: buckets over mean + cutoff * deviation (of the first buckets) are dealt again by one more character, up to em - 1.

    A suffix that is too short for its new bucket drops out. A round with no
    large bucket is the last; each counts its buckets once.
    """
    first = slide(sequences, k, skip)
    stats = bucket_sizes(first).agg(F.avg("size").alias("mean"), F.stddev_samp("size").alias("sd")).first()
    limit = (stats["mean"] or 0) + cutoff * (stats["sd"] or 0)
    done = None
    now = first
    for at in range(k, em):
        sizes = bucket_sizes(now)
        large = sizes.where(F.col("size") > limit).select("kmer")
        if at + 1 >= em or not max_rounds or large.isEmpty():
            break
        large = written(large, "large-buckets")
        fine = now.join(large, "kmer", "left_anti").select("sid", "pid", "kmer")
        done = fine if done is None else done.unionByName(fine)
        hot = now.join(large, "kmer", "left_semi").select("sid", "pid")
        longer = sequences.select("sid", "seq", "len").join(hot, "sid").where(F.col("pid") + at <= F.col("len"))
        now = written(longer.select("sid", "pid", F.substring("seq", F.col("pid").cast("int"), F.lit(at + 1)).alias("kmer")), "refined")
        max_rounds -= 1
    out = now.select("sid", "pid", "kmer") if done is None else done.unionByName(now.select("sid", "pid", "kmer"))
    return out.withColumn("k", F.length("kmer"))
