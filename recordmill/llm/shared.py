"""Storage that driver and executors share, and bounded reading of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.sources.scratch import shared_dir

#: Text bytes that an operator turns into Python objects at a time.
SLICE_BYTES = 8 << 20
#: Rows of some dozens of bytes that are joined by broadcasting them; more are joined by shuffle.
BROADCAST = 200_000
#: A key is hot from one of so many rows on, which so many keys can be at most; and never below so many rows.
HOT_SHARE, HOT_ROWS = 10_000, 200


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(rows: DataFrame) -> DataFrame:
    """Rows to broadcast if a count shows that they are few; as they are otherwise."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def with_hot(rows: DataFrame, by_key: DataFrame, key: str, total: int, count: str = "rows") -> DataFrame:
    """An inner join of so many rows with a table of one row a key, which has each key's number of rows.

    Hot keys, of which there are at most HOT_SHARE, are joined by broadcasting them, so that no key's rows meet in
    one task; the rest is joined by shuffle.
    """
    least = max(HOT_ROWS, total // HOT_SHARE + 1)
    hot = by_key.where(F.col(count) >= least).drop(count)
    cold = by_key.where(F.col(count) < least).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def lean(run: Callable) -> Callable:
    """The same over batches, but what a task has freed goes back to the system, not to the next task of its worker."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library than glibc
                pass

    return tidy


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where the column's text passes the limit; one longer text makes a slice of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(column).to_pylist()
