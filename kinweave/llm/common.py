"""Helpers shared by the corpus operators.

Rows go through Python with ``mapInArrow`` in slices of bounded size, so that
the Python objects alive at any time are those of one slice, whatever the size
of a partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of text, that a slice holds at most (a longer single text is a slice of its own).
SLICE_ROWS = 2048
SLICE_BYTES = 4 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; a clashing name (another case, a repeated name) is passed over.

    The first column spelled as asked wins, then the first that differs by case only.
    """
    have = df.columns
    low = [c.lower() for c in have]
    at = [have.index(n) if n in have else low.index(n.lower()) for n in names]
    if len(set(low)) == len(low):
        return df.select(*(F.col(_quoted(have[i])).alias(n) for i, n in zip(at, names, strict=True)))
    flat = df.toDF(*(f"_c{i}" for i in range(len(have))))
    return flat.select(*(F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *others: str) -> DataFrame:
    """doc_id and text (and other columns) of documents."""
    return pick(df, "doc_id", "text", *others)


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of at most SLICE_ROWS rows and about SLICE_BYTES of text."""
    column = batch.column(text_at)
    n = batch.num_rows
    start = 0
    size = 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, k in enumerate(lengths):
        if i > start and (i - start >= SLICE_ROWS or size + k > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    if n > start:
        yield batch.slice(start, n - start)


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[list]]],
    fields: list[tuple[str, T.DataType]],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """df with further columns computed from one text column, partition by partition, without a shuffle.

    ``make()`` runs once in each task and returns a function from a list of
    texts (None for null) to one list for each new column. ``keep`` names the
    input columns that stay (all by default); an input column that has the name
    of a new one is replaced by it. Rows keep their order.
    """
    small_batches(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    names_in = df.columns
    at = lambda name: names_in.index(name) if name in names_in else [c.lower() for c in names_in].index(name.lower())
    stay_at = [i for i in (range(len(names_in)) if keep is None else map(at, keep)) if names_in[i].lower() not in new]
    # Names by place: a name that clashes with another can't be looked up.
    flat = df.toDF(*(f"_{i}" for i in range(len(names_in))))
    sent_at = stay_at if at(text) in stay_at else [*stay_at, at(text)]
    through = flat.select(*(F.col(f"_{i}") for i in sent_at))
    where = sent_at.index(at(text))
    schema = T.StructType([df.schema[i] for i in stay_at] + [T.StructField(n, t) for n, t in fields])
    kinds = [_arrow(t) for _, t in fields]
    names = [schema[i].name for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, where):
                made = compute(part.column(where).to_pylist())
                columns = [part.column(i) for i in range(len(stay_at))] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return through.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Rows and bytes of the batches that go between the JVM and Python; a task holds a few of them.
BATCH_ROWS = 2000
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that a task's memory doesn't follow the length of its texts. A smaller setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = _bytes(spark.conf.get(key))
        if have <= 0 or have > _bytes(str(most)):
            spark.conf.set(key, most)


def _bytes(value: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", str(value).strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit]


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def crc_text(value: str) -> int:
    return zlib.crc32(value.encode())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; outside a cluster a folder of our own if that is unset."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/kinweave-{os.getpid()}"
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, and is whole after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kinweave-{name}-{uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kinweave_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_kinweave_path", None):
            jvm = t.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
