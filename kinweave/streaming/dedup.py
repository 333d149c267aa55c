"""Pairs as a stream: a pair is passed on when it is first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import canonical
from ..sources.fasta import from_column


def first_seen(pairs: DataFrame, event_time: str | None = None, delay: str = "1 hour", bounded: bool = False) -> DataFrame:
    """Each pair once. State older than the delay by event time is dropped, so it stays bounded; without an event time it holds every pair, which the caller must allow by saying that the input is bounded."""
    ordered = canonical(pairs)
    if event_time:
        return ordered.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id1", "id2"])
    _allow(bounded)
    return ordered.dropDuplicates(["id1", "id2"])


def _allow(bounded: bool) -> None:
    if not bounded:
        raise ValueError("name the event time, so that old state can go, or say that the stream is bounded")


def read_pair_stream(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2 from Parquet files as they arrive."""
    return spark.readStream.schema("id1 long, id2 long").parquet(path)


def sequence_stream(stream: DataFrame, sid: str, text: str) -> DataFrame:
    return from_column(stream, sid, text)


def contamination_stream(stream: DataFrame, reference: DataFrame, em: int) -> DataFrame:
    """sid of arriving sequences that share a substring of em characters with a static set: a stream-static join on k-mers, without state.

    A sequence's distinct k-mers are looked up where it is, so it is passed on once
    for each of them that is known; ``contaminated`` gives each sid once.
    """
    from ..operators.kmers import distinct_kmers

    known = distinct_kmers(reference, em).select("kmer").distinct()
    return distinct_kmers(stream, em).join(known, "kmer").select("sid")


def contaminated(stream: DataFrame, reference: DataFrame, em: int, event_time: str | None = None, delay: str = "1 hour", bounded: bool = False) -> DataFrame:
    """contamination_stream with each sid once, under the rule for state of first_seen. An event time must be a column of the stream."""
    from ..operators.kmers import distinct_kmers

    known = distinct_kmers(reference, em).select("kmer").distinct()
    if event_time:
        timed = stream.withWatermark(event_time, delay)
        hits = distinct_kmers(timed, em, [event_time]).join(known, "kmer").select("sid", event_time)
        return hits.dropDuplicatesWithinWatermark(["sid"]).select("sid")
    _allow(bounded)
    return contamination_stream(stream, reference, em).dropDuplicates(["sid"])


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows by window and key; late rows are dropped after the delay."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
