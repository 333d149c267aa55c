"""Pair tables in files: fixed binary records, and edges as CSV."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 9


def _int32(at: int) -> F.Column:
    """A little-endian signed 32-bit number of the column ``record``."""
    reversed_hex = F.concat(*(F.hex(F.substring("record", at + i, 1)) for i in (3, 2, 1, 0)))
    value = F.conv(reversed_hex, 16, 10).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("long")


#: Files of up to so many bytes are rows of the binary file source; a larger one is read in splits of records.
WHOLE_FILE = 256 << 20


def read_pairs(spark: SparkSession, path: str, suffix: str = "*", whole_file: int = WHOLE_FILE) -> DataFrame:
    """id1, id2, file of nine-byte records (two little-endian 32-bit numbers and a line end).

    The binary file source gives a file a row, which is cut in place. A large file
    is read as records of fixed length instead, in as many splits as it has blocks.
    What follows the last whole record is left out.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    found = _cut_files(listed.where(F.col("length") <= whole_file))
    for r in listed.where(F.col("length") > whole_file).select("path").collect():
        records = spark.sparkContext.binaryRecords(r["path"], RECORD).mapPartitions(_unpacked)
        found = found.unionByName(spark.createDataFrame(records, "id1 long, id2 long").withColumn("file", F.lit(r["path"])))
    return found


def _unpacked(records: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    while own := b"".join(itertools.islice(records, 1 << 16)):
        fields = np.frombuffer(own, [("a", "<i4"), ("b", "<i4"), ("end", "u1")])
        yield from zip(fields["a"].tolist(), fields["b"].tolist(), strict=True)


def _cut_files(listed: DataFrame) -> DataFrame:
    files = listed.select("path", "content")
    starts = F.sequence(F.lit(0), F.floor(F.length("content") / RECORD).cast("int") - 1)
    cut = files.where(F.length("content") >= RECORD).select("path", F.explode(F.transform(starts, lambda i: F.substring(F.col("content"), i * RECORD + 1, F.lit(RECORD)))).alias("record"))
    return cut.select(_int32(1).alias("id1"), _int32(5).alias("id2"), F.col("path").alias("file"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Nine-byte records, a file a partition, through Spark's committer: eight bytes and the writer's line end."""

    def little(name: str) -> F.Column:
        digits = F.right(F.lpad(F.hex(F.col(name).cast("long")), 16, "0"), F.lit(8))
        return F.concat(*(F.substring(digits, 1 + 2 * i, 2) for i in (3, 2, 1, 0)))

    # A binary value cast to a string keeps its bytes, and the text writer writes them as they are.
    pairs.select(F.unhex(F.concat(little("id1"), little("id2"))).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, with_label: bool = False) -> None:
    """id1,id2,a,b,c without a header; the label Edge or NotAnEdge if asked for."""
    columns = ["id1", "id2", "a", "b", "c"]
    out = edges.select(*columns, *([F.when(F.col("is_edge"), "Edge").otherwise("NotAnEdge").alias("label")] if with_label else []))
    out.write.mode("overwrite").csv(path)


def write_costs(pairs: DataFrame, path: str, lengths: bool = False) -> None:
    """id1, id2, the lengths if asked for, and cells, tab-separated. Pairs are aligned side by side, so none has a time of its own."""
    pairs.select("id1", "id2", *(["len1", "len2"] if lengths else []), "cost").write.mode("overwrite").option("sep", "\t").csv(path)
