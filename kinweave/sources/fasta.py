"""FASTA files and text columns as sequence tables (sid, id, seq, len)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import normalized
from ..plans.tables import numbered

SCHEMA = "sid long, id string, seq string, len int"


def read_fasta(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Records start at '>' after a line end. The id keeps its '>'; sequence lines are joined without white space; headers without a sequence give no row.

    Files are split at record borders by the reader, so a file needs no single
    task. sid follows the order of records in a file.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    if check:
        first = spark.read.text(path).limit(1).collect()
        if first and not first[0]["value"].startswith(">"):
            raise ValueError(f"{path} doesn't begin with '>'")
    record = F.regexp_replace("value", "^>", "")
    cut = F.instr(record, "\n")
    head = F.when(cut > 0, F.substring(record, F.lit(1), cut - 1)).otherwise(record)
    body = F.when(cut > 0, F.substring(record, cut + 1, F.length(record))).otherwise("")
    parsed = raw.select(F.concat(F.lit(">"), F.regexp_replace(head, r"\s+$", "")).alias("id"), F.regexp_replace(body, r"\s", "").alias("seq")).where(F.length("seq") > 0)
    return number_rows(parsed)


def number_rows(rows: DataFrame) -> DataFrame:
    """sid, id, seq, len: consecutive sids in the order of the splits of the files and of their rows: a file's records keep their order; of several files, the larger ones may come first."""
    return numbered(rows, "sid", stable=True).select("sid", "id", "seq", F.length("seq").alias("len"))


def from_column(df: DataFrame, sid: str, text: str | Column) -> DataFrame:
    """Sequences of the letters of a text column; null texts are empty sequences."""
    seq = F.coalesce(normalized(F.col(text) if isinstance(text, str) else text), F.lit(""))
    return df.select(F.col(sid).cast("long").alias("sid"), F.concat(F.lit(">"), F.col(sid).cast("string")).alias("id"), seq.alias("seq")).withColumn("len", F.length("seq"))


def database_stats(sequences: DataFrame) -> DataFrame:
    return sequences.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.max(F.col("len").cast("long")), F.lit(0)).alias("longest"),
    )


def write_fasta(sequences: DataFrame, path: str) -> None:
    """id and sequence on a line each, in part files, in sid order inside each."""
    sequences.sortWithinPartitions("sid").select(F.concat_ws("\n", "id", "seq").alias("value")).write.mode("overwrite").text(path)


def outside_alphabet(sequences: DataFrame, alphabet: str) -> DataFrame:
    """sid and the letters of a sequence that the alphabet lacks, for those that have any."""
    letters = F.translate("seq", alphabet, "")
    return sequences.select("sid", letters.alias("letters")).where("letters <> ''")


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files that a path names."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return int(files.agg(F.sum("length")).first()[0] or 0)
