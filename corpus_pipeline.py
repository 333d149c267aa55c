"""A corpus pipeline of five stages, each of which works on all rows that the one before it kept.

Language identification drops what it rejects, toxicity drops what it predicts
toxic, SimHash keeps the row with the smallest id of each class, the secret scan
replaces what it finds in the texts, packing returns pieces of sequences.
All but the last return the columns of documents; further columns of the input
stay, whatever their names. Stages keep repeated rows apart (near_dedup alone
drops copies), read very long texts whole, and give an empty table for an empty
one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import language_zstd, packing, secret_scan, simhash_trie, toxicity_fm
from kinweave.llm.common import append_columns, forget, pick, table, written

#: Names that the stages use for themselves while they run.
_OWN = "_kinweave_"
#: So many hashes of rows (16 MB) are broadcast at most.
BROADCAST_IDS = 2_000_000


def _judged(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], drop: F.Column) -> DataFrame:
    """docs without the rows that a narrow operator's verdict drops, with the columns of docs. judge: gets docs under names of our own, and that of the text."""
    names = docs.columns
    own = [f"{_OWN}{i}" for i in range(len(names))]
    text = own[names.index("text")]
    got = judge(docs.toDF(*own), text)
    return got.where(~F.coalesce(drop, F.lit(False))).select(*(F.col(c).alias(n) for c, n in zip(own, names, strict=True)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier doesn't reject. It rejects null and empty texts and those without a letter; null ids and languages only matter for what it learns."""
    train = pick(docs, "doc_id", "text", "lang").where(language_zstd.crc_mod(F.col("doc_id"), 4) != 2)
    samples = language_zstd.learn(train)
    return _judged(docs, lambda d, text: language_zstd.classify(d, samples, text=text), F.col("rejected"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows not predicted toxic. Null and empty texts score as the bias does, so they stay; rows without an id have no label and are scored like any other."""
    labelled = toxicity_fm.labelled_terms(docs, table(spark, sf_dir, "labels"))
    model = toxicity_fm.learn(labelled)
    forget(labelled)
    return _judged(docs, lambda d, text: toxicity_fm.score(d, model, text=text), F.col("predicted") == 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the least by (doc_id, hash of the row), with null ids last.

    Classes are those of rows, so rows of one id that hold unrelated texts stand
    each for their own. Rows are told apart by their hash alone: two that share it
    are the same row, or both stay if one of them does. Up to BROADCAST_IDS hashes
    of rows that go are broadcast, so the texts aren't shuffled; beyond, both sides
    are shuffled by hash.
    """
    key = f"{_OWN}row"
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    classes = simhash_trie.near_duplicates(keyed.select(rank.alias("doc_id"), "text"))
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    rows = written(classes.groupBy(F.col("doc_id.row").alias(key)).agg(stays.alias("stays"), F.count(F.lit(1)).alias("n")), "stay")

    def some(which: str) -> tuple[DataFrame, int]:
        found = rows.where(which).select(key)
        n = found.count()
        return (F.broadcast(found) if n <= BROADCAST_IDS else found), n

    gone, _ = some("not stays")
    again, n_again = some("stays and n > 1")  # rows that are there several times
    kept = keyed.join(gone, key, "left_anti")
    if n_again:
        once = kept.join(again, key, "left_semi").dropDuplicates(docs.columns)
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with what the scan finds replaced by its kind, and n_chars as it is then; a null text stays null, with n_chars null."""
    found = append_columns(
        docs,
        _redactor,
        [("text", docs.schema["text"].dataType)],
    ).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def _redactor() -> Callable[[list], list[list]]:
    return lambda values: [[v if v is None else secret_scan.redact(v, secret_scan.scan(v)[1]) for v in values]]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of all rows; a null or empty text is one piece, of the closing id alone. Rows of one id have pieces of their own."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", pack)]

#: Learned models and tokenizers aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
