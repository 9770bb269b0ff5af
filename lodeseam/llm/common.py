"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import deleted, shared_dir, written  # noqa: F401

#: Texts that a Python worker holds as objects at one time, in bytes.
CHUNK_BYTES = 4 << 20
#: Bytes after which Spark closes a batch of rows for a Python worker. Its own bound, 64 MB, is held by executor and worker.
BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader holds at one time; with texts its own 4096 make arrays of tens of MB, which spread the heap.
READ_ROWS = 512
#: Labels whose crc32(doc_id as text) is divisible by this are kept apart from every fit.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the tables, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """From now on the session closes batches for Python workers at BATCH_BYTES and reads Parquet by READ_ROWS; lower bounds stay.

    Spark reads both when a plan runs, so they cannot be bound to a DataFrame. A row is never cut.
    """
    to_workers, read = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(to_workers))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(to_workers, str(BATCH_BYTES))
    if int(spark.conf.get(read)) > READ_ROWS:
        spark.conf.set(read, str(READ_ROWS))


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `most` bytes; one row at least, however long."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Gives the system what Arrow's pool and the C library hold on to: workers stay for other tasks, some of them idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column as UTF-8 bytes."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of the pickled value; pickle.loads(x.value) in a task gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, most_bytes: int) -> list[tuple[int, bytes, int]]:
    """A bounded sample (doc_id, text, label 0 or 1): at most `most` documents of a label and `most_bytes` of whole texts.

    In the order of a hash of the id, without the labels kept apart; of several labels of a document the largest counts.
    """
    usable = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids: dict[int, int] = {}
    for label in (0, 1):
        ids |= {r.doc_id: label for r in usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    if not ids:
        return []
    spark = docs.sparkSession
    own = docs.select("doc_id", "text").where("text IS NOT NULL")
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    sizes: dict[int, int] = {}
    for r in own.join(wanted, "doc_id", "left_semi").select("doc_id", F.octet_length("text").alias("n")).collect():
        sizes[r.doc_id] = max(r.n, sizes.get(r.doc_id, 0))
    taken, total = [], 0
    for i in sorted(sizes, key=lambda i: (zlib.crc32(b"%d" % i), i)):
        if total + sizes[i] <= most_bytes:
            taken.append(i)
            total += sizes[i]
    if not taken:
        return []
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in taken], "doc_id long"))
    rows = {r.doc_id: r.text for r in own.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(i, rows[i].encode(), ids[i]) for i in taken if i in rows]
