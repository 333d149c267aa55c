"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that isn't used yet, in the shared folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/kinweave-{os.getpid()}"
    return f"{folder.rstrip('/')}/kinweave-{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: no lineage before it, and whole after an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kinweave_path = path
    return table


def numbered(rows: DataFrame, name: str, stable: bool = False) -> DataFrame:
    """rows with a column of consecutive numbers from 0, in the order of partitions and of rows in them.

    Each partition's first number is the sum of the counts before it: a table of a
    row a partition, which is joined by broadcast and never reaches the driver. The
    rows are written with their places first, as they may come out of other
    partitions the next time, and files are not read in the order in which they
    were written; ``stable`` says that they are read from files that stay.
    """
    tagged = rows.withColumn("_m", F.monotonically_increasing_id())
    tagged = tagged if stable else written(tagged, "numbered")
    part = F.shiftright("_m", 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    number = (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, number).drop("_m", "_p", "_before")


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_kinweave_path", None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key over all cores, if it comes from fewer files than there are cores: a file of one row group is one task, whatever it holds. A large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)
