"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not a rerun of
    what produced them, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def free(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more. Only what
    has been read by a finished job may go: a plan that is still to run reads
    the files."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod ``modulus``; a null id counts as
    the empty text (remainder 0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def text_batches(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose ``column`` holds about ``max_bytes``
    (one row at least), so that work on long texts stays bounded."""
    array = batch.column(column)
    if not len(array):
        return
    sizes = pc.binary_length(array).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > max_bytes:
            yield start, i
            start, total = i, 0
        total += size
    yield start, len(sizes)


def parted(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, see :func:`text_batches`; Arrow's
    unused memory is handed back at the end, as workers are kept for later
    stages."""
    for batch in batches:
        for a, b in text_batches(batch, column):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


#: Rows up to which a stored table of a few numbers a row is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored ``df`` of a few numbers a row, marked for broadcast if it has
    at most ``rows`` rows (counted from the files' footers); beyond that it is
    left to Spark, which shuffles both sides. The result is the same."""
    return F.broadcast(df) if df.count() <= rows else df
