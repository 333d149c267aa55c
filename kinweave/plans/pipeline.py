"""From sequences to the edge table: candidates, filters, alignment, edges, statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import MATRICES, edge_ratios, is_edge, length_cutoff, length_filter, max_length, pair_cost, self_of_longer, self_score
from ..operators.align import align_pairs, spread_by_cost
from ..operators.pairs import all_sequence_pairs, canonical, common_substring_pairs, deduplicate, equal_left_pairs, maximal_matches, probe_pairs, with_sequences
from ..sources.pairs import read_pairs
from ..sources.params import Params
from .tables import written


EDGES = "id1 long, id2 long, a double, b double, c double, is_edge boolean"


def candidates(sequences: DataFrame, params: Params) -> DataFrame:
    """id1, id2 by the configured strategy. The scope of duplicates is as configured: with none, a pair comes as often as it has maximal matches.

    The iterator and the counter deal out the same pairs as brute force, the
    dynamic and hybrid trees those of the tree, and arrays in place of trees find
    the same matches; they differ in scheduling, which is the cluster's here.
    """
    if params.strategy in ("bruteforce", "iterator", "counter"):
        return all_sequence_pairs(sequences).select("id1", "id2")
    if params.SkipTree and params.SlideWindowSize == params.ExactMatchLength:
        return equal_left_pairs(sequences, params.ExactMatchLength)
    if params.SkipPrefixes or params.dedup == "none":
        found = maximal_matches(sequences, params.ExactMatchLength, params.SkipPrefixes or None, params.SlideWindowSize).select("id1", "id2")
        return deduplicate(found, params.dedup)
    return common_substring_pairs(sequences, params.ExactMatchLength)


def aligned_pairs(pairs: DataFrame, sequences: DataFrame, params: Params, stats_mode: str = "carried", replicate: bool = False, partitions: int | None = None) -> DataFrame:
    """Alignment of pairs that the length filter lets through, with cost and the longer sequence's length and self score; with ``partitions``, pairs are dealt by cost first."""
    matrix = MATRICES[params.Matrix.lower()]
    scored = sequences.withColumn("self", self_score(F.col("seq"), matrix))
    both = with_sequences(pairs, scored, ["seq", "len", "self"], replicate)
    if params.UseLengthFilter:
        both = both.where(length_filter(F.col("len1"), F.col("len2"), length_cutoff(params.AlignOverLongerSequence, params.MatchSimilarity)))
    if partitions:
        both = spread_by_cost(written(both.withColumn("cost", pair_cost(F.col("len1"), F.col("len2"))), "costed"), partitions)
    out = align_pairs(both, params.kind, matrix, -params.Open, -params.Gap, stats_mode)
    l1, l2 = F.col("len1"), F.col("len2")
    return out.select("id1", "id2", "score", "matches", "length", max_length(l1, l2).alias("max_len"), self_of_longer(l1, l2, F.col("self1"), F.col("self2")).alias("self_score"), pair_cost(l1, l2).alias("cost"))


def with_edges(aligned: DataFrame, params: Params) -> DataFrame:
    """Adds a, b, c and is_edge."""
    args = [F.col(c) for c in ("score", "matches", "length", "max_len", "self_score")]
    a, b, c = edge_ratios(*args)
    edge = is_edge(*args, params.AlignOverLongerSequence, params.MatchSimilarity, params.OptimalScoreOverSelfScore)
    return aligned.select("*", a.alias("a"), b.alias("b"), c.alias("c"), edge.alias("is_edge"))


def edges(sequences: DataFrame, params: Params) -> DataFrame:
    """id1, id2, a, b, c, is_edge: edges only, unless OutputAll; none if PerformAlignments is off."""
    if not params.PerformAlignments:
        return sequences.sparkSession.createDataFrame([], EDGES)
    found = with_edges(aligned_pairs(candidates(sequences, params), sequences, params), params).select("id1", "id2", "a", "b", "c", "is_edge")
    return found if params.OutputAll else found.where("is_edge")


def align_stats(pairs: DataFrame, sequences: DataFrame, params: Params) -> DataFrame:
    """Edges, alignments, skipped pairs, cells and skipped cells."""
    lens = with_sequences(pairs, sequences, ["len"])
    passes = length_filter(F.col("len1"), F.col("len2"), length_cutoff(params.AlignOverLongerSequence, params.MatchSimilarity)) if params.UseLengthFilter else F.lit(True)
    aligns = passes & F.lit(params.PerformAlignments)
    cost = pair_cost(F.col("len1"), F.col("len2"))
    zero = F.lit(0).cast("long")
    work = lens.agg(
        F.count_if(aligns).alias("align_counts"), F.count_if(~aligns).alias("align_skipped"),
        F.coalesce(F.sum(F.when(aligns, cost)), zero).alias("work"), F.coalesce(F.sum(F.when(~aligns, cost)), zero).alias("work_skipped"),
    )
    if params.PerformAlignments:
        n_edges = with_edges(aligned_pairs(pairs, sequences, params), params).agg(F.count_if("is_edge").alias("edge_counts"))
    else:
        n_edges = work.select(zero.alias("edge_counts"))
    return n_edges.join(work, F.lit(True))


def edges_of_files(spark: SparkSession, path: str, sequences: DataFrame, params: Params, suffix: str = "*") -> DataFrame:
    """id1, id2, a, b, c, is_edge of the pairs in binary pair files, each pair once: edges only, unless OutputAll."""
    pairs = deduplicate(canonical(read_pairs(spark, path, suffix).select("id1", "id2")), "global")
    found = with_edges(aligned_pairs(pairs, sequences, params), params).select("id1", "id2", "a", "b", "c", "is_edge")
    return found if params.OutputAll else found.where("is_edge")


def features(sequences: DataFrame, probes: int, params: Params) -> DataFrame:
    """A row for each sequence: for each of the first ``probes`` sequences, by sid, coverage, identity and relative score, and Homologous if any is an edge, else Not.

    Every sequence is aligned with every probe, itself too, whatever their lengths:
    the length filter doesn't apply. A ratio with divisor 0 is null, and so are the
    columns of probes beyond the last sequence.
    """
    probed = probe_pairs(sequences, probes)
    aligned = aligned_pairs(probed, sequences, replace(params, UseLengthFilter=False))
    found = with_edges(aligned, params).join(probed, ["id1", "id2"])
    ratio = lambda c: F.round(F.first(c), 9)
    wide = found.groupBy("id1").pivot("probe", list(range(probes))).agg(ratio("a").alias("alen_maxlen"), ratio("b").alias("ndig_alen"), ratio("c").alias("score_sscore"))
    flag = found.groupBy("id1").agg(F.bool_or("is_edge").alias("edge"))
    label = F.when(F.coalesce("edge", F.lit(False)), "Homologous").otherwise("Not").alias("class")
    every = sequences.select(F.col("sid").alias("id1")).join(wide, "id1", "left").join(flag, "id1", "left")
    return every.select(F.col("id1").alias("id"), *(c for c in wide.columns if c != "id1"), label)
