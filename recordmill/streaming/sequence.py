"""The event log as a streaming source whose offsets are sequence numbers.

A log is a folder of Parquet folders, one for each append, named by the first number in it. Numbers rise without end, so
a folder's range ends where the next begins and only the last one's files are looked into.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from recordmill.sources.records import with_positions

#: The digits of a folder's first number, so that names are in the order of numbers.
DIGITS = 19


@dataclass
class Piece(InputPartition):
    """A file of the log and the numbers wanted from it: over low, up to high."""

    file: str
    low: int
    high: int


class EventLog(DataSource):
    """format("event_log"): options path (of the log) and seq (the column of numbers; "seq" if left out).

    A batch takes all numbers past its cursor, a task for each file. A cursor past the log's end starts over, so a log
    that was begun anew is replayed; one that has grown past the cursor again can't be told from the old one. A folder
    that is being written isn't seen.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        raise ValueError("event_log needs a schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SequenceReader(self.options["path"], schema, self.options.get("seq", "seq"))


class SequenceReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, seq: str):
        self.path, self.schema, self.seq = path, schema, seq

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        fs, folders = self.folders()
        for first, folder in reversed(folders):  # the last one that holds rows
            ends = [end for f in files(fs, folder) if (end := self.greatest(fs, f)) is not None]
            if ends:
                return {"seq": max(ends)}
        return {"seq": 0}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        high = end["seq"]
        low = start["seq"] if start["seq"] <= high else 0
        if low == high:
            return []
        fs, folders = self.folders()
        nexts = [first for first, _ in folders[1:]] + [None]
        wanted = [folder for (first, folder), after in zip(folders, nexts) if first <= high and (after is None or after > low + 1)]
        return [Piece(f, low, high) for folder in wanted for f in files(fs, folder)]

    def read(self, partition: Piece) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = opened(self.path)
        number, wanted = ds.field(self.seq), to_arrow_schema(self.schema)
        rows = ds.dataset(partition.file, filesystem=fs, format="parquet")
        for batch in rows.to_batches(columns=wanted.names, filter=(number > partition.low) & (number <= partition.high)):
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()

    def folders(self) -> tuple:
        """The first number and the place of each folder of the log, in order."""
        import pyarrow.fs as pfs

        fs, place = opened(self.path)
        found = fs.get_file_info(pfs.FileSelector(place, allow_not_found=True))
        named = [(i.base_name.removeprefix("from="), i.path) for i in found if i.type == pfs.FileType.Directory and i.base_name.startswith("from=")]
        return fs, sorted((int(n), p) for n, p in named if n.isdigit())

    def greatest(self, fs, file: str) -> int | None:
        """The greatest number of a file, by its footer; by its column where the footer doesn't tell."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        with fs.open_input_file(file) as opened_file:
            parquet = pq.ParquetFile(opened_file)
            meta = parquet.metadata
            if not meta.num_rows:
                return None
            at = meta.schema.names.index(self.seq)
            each = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            if all(s is not None and s.has_min_max for s in each):
                return max(s.max for s in each)
            return pc.max(parquet.read([self.seq])[self.seq]).as_py()


def opened(path: str) -> tuple:
    """The file system of a path and the path in it."""
    import pyarrow.fs as pfs

    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


def files(fs, folder: str) -> list[str]:
    import pyarrow.fs as pfs

    return sorted(i.path for i in fs.get_file_info(pfs.FileSelector(folder)) if i.base_name.endswith(".parquet"))


def append(events: DataFrame, path: str, *order: str, seq: str = "seq") -> int:
    """Number events after what the log holds and add them as one folder, whole or not at all; the log's new end.

    One writer at a time: a second one finds the folder's name taken, and fails.
    """
    spark = events.sparkSession
    last = end(spark, path, seq)
    staged, final = f"{path}/_staging-{uuid.uuid4().hex}", f"{path}/from={last + 1:0{DIGITS}d}"
    with_positions(events, *order, name=seq, start=last + 1).write.parquet(staged)
    rows = spark.read.parquet(staged).agg(F.max(seq)).first()[0]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if rows is None:
        fs.delete(place(staged), True)
        return last
    if fs.exists(place(final)) or not fs.rename(place(staged), place(final)):
        raise OSError(f"another writer added {final}")
    return rows


def end(spark: SparkSession, path: str, seq: str = "seq") -> int:
    """The greatest number in the log, by its last folder alone; 0 for none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    names = [n for n in names if n.startswith("from=")]
    return spark.read.parquet(f"{path}/{names[-1]}").agg(F.max(seq)).first()[0] if names else 0


def clear(spark: SparkSession, path: str) -> None:
    """Begin the log anew."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, path: str, schema: StructType, seq: str = "seq") -> DataFrame:
    """The log as a stream."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").schema(schema).option("path", path).option("seq", seq).load()
