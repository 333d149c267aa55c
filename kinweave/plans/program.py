"""The whole program: a configuration and a FASTA file in, an edge table, statistics and a log out."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import length_cutoff, length_filter, pair_cost
from ..operators import kmers, pairs
from ..sources.fasta import database_stats, file_size, outside_alphabet, read_fasta
from ..sources.pairs import write_edges
from ..sources.params import Params, echo, load
from . import pipeline
from .tables import written

#: Sequences of up to so many bytes are sent to all tasks if the configuration replicates them; MemorySequences may lower it.
REPLICATED = 256 << 20


@dataclass
class Outcome:
    """The edges (written), the statistics by section, and the log."""

    edges: DataFrame
    stats: dict[str, dict] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)


class _Clock:
    """Times steps and logs them."""

    def __init__(self, log: list[str]):
        self.log, self.began, self.took = log, time.time(), {}

    def step(self, name: str) -> None:
        now = time.time()
        self.took[name] = now - self.began
        self.log.append(f"{name}: {now - self.began:.3f} s")
        self.began = now


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def run(spark: SparkSession, config: str | Params, fasta: str, out: str | None = None) -> Outcome:
    """Reads the configuration and the sequences, finds candidate pairs, aligns them, and writes what the configuration asks for below ``out``.

    edges/: CSV of id1, id2, a, b, c (OutputToDisk; all aligned pairs with
    OutputAll). stats/: the statistics as JSON (PrintStats). log/: the
    configuration and what each step took.

    Sequences with letters outside the alphabet are an error for the strategies
    that make buckets of windows, as their numbers would be undefined. MemoryWorker
    has no use: tasks spill to disk.
    """
    params = (config if isinstance(config, Params) else load(spark, config)).checked()
    done = Outcome(spark.createDataFrame([], pipeline.EDGES), log=[echo(params)])
    clock = _Clock(done.log)
    size = file_size(spark, fasta)
    sequences = written(read_fasta(spark, fasta), "sequences")
    stats = done.stats
    replicate = not params.DistributeSequences and size <= min(params.MemorySequences, REPLICATED)
    stats["database"] = {**_row(database_stats(sequences)), "file_bytes": size, "replicated": replicate}
    clock.step("read")
    tree = params.strategy not in ("bruteforce", "iterator", "counter")
    if tree and (bad := outside_alphabet(sequences, params.letters).limit(1).collect()):
        raise ValueError(f"sequence {bad[0]['sid']} has letters outside the alphabet: {bad[0]['letters'][:20]}")
    if tree and params.PrintStats:
        k, em = params.SlideWindowSize, params.ExactMatchLength
        stats["buckets"] = _row(kmers.bucket_stats(kmers.bucket_sizes(kmers.slide(sequences, k, params.SkipPrefixes or None))))
        refined = kmers.refine(sequences, k, em, params.BucketCutoff, params.SkipPrefixes or None)
        stats["refined_buckets"] = _row(kmers.bucket_stats(refined.groupBy("kmer").agg(F.count(F.lit(1)).alias("size"))))
        clock.step("buckets")
    found = written(pipeline.candidates(sequences, params), "candidates")
    clock.step("candidates")
    if params.PrintStats:
        distinct = found.agg(F.count(F.lit(1)).alias("checked"), F.countDistinct("id1", "id2").alias("returned"))
        stats["duplicates"] = {**_row(distinct), "scope": params.dedup}
        tiled = pairs.tile_counts(sequences, found.select("id1", "id2").distinct(), params.SuffixArrayBlockSize).where("tile is not null")
        arrays = _row(tiled.agg(F.count(F.lit(1)).alias("arrays"), F.coalesce(F.sum("generated"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("possible"), F.lit(0)).alias("possible")))
        stats["arrays"] = {**arrays, "suffixes": stats["database"]["n_chars"], "build_seconds": clock.took["candidates"]}
        clock.step("tiles")
    stats["alignments"] = _align(done, found, sequences, params, replicate, clock)
    stats["seconds"] = dict(clock.took)
    if out:
        _write(spark, done, params, out.rstrip("/"))
    return done


def _align(done: Outcome, found: DataFrame, sequences: DataFrame, params: Params, replicate: bool, clock: _Clock) -> dict:
    """Aligns the pairs once, keeps what is to be written, and counts."""
    cutoff = length_cutoff(params.AlignOverLongerSequence, params.MatchSimilarity)
    l1, l2 = F.col("len1"), F.col("len2")
    passes = (length_filter(l1, l2, cutoff) if params.UseLengthFilter else F.lit(True)) & F.lit(params.PerformAlignments)
    cells = lambda which: F.coalesce(F.sum(F.when(which, pair_cost(l1, l2))), F.lit(0))
    counts = _row(pairs.with_sequences(found, sequences, ["len"], replicate).agg(
        F.count_if(passes).alias("align_counts"), F.count_if(~passes).alias("align_skipped"), cells(passes).alias("work"), cells(~passes).alias("work_skipped"),
    ))
    clock.step("count")
    edge_counts = 0
    if params.PerformAlignments:
        spark = sequences.sparkSession
        dealt = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        aligned = pipeline.aligned_pairs(found, sequences, params, replicate=replicate, partitions=4 * dealt)
        edged = pipeline.with_edges(aligned, params).select("id1", "id2", "a", "b", "c", "is_edge")
        done.edges = written(edged if params.OutputAll else edged.where("is_edge"), "edges")
        edge_counts = done.edges.where("is_edge").count()
    clock.step("align")
    seconds = clock.took["align"]
    return {"edge_counts": edge_counts, **counts, "align_seconds": seconds, "cells_per_second": counts["work"] / seconds if seconds else None}


def _write(spark: SparkSession, done: Outcome, params: Params, out: str) -> None:
    if params.OutputToDisk:
        write_edges(done.edges, f"{out}/edges")
    if params.PrintStats:
        spark.createDataFrame([(json.dumps(done.stats, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/stats")
    spark.createDataFrame([(x,) for x in done.log], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/log")
