"""The event log as a stream: cursors are checkpoints, repeats keep the first event, sinks append whole batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recordmill.sources.records import with_positions
from recordmill.sources.scratch import shared_dir


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Events from Parquet files as they come; a time without zone becomes an instant, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(path)
    naive = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return events.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else events


def without_repeats(events: DataFrame, *key: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first event of each key.

    With the column of an event's time, keys are forgotten once they are so late, and what is kept stays bounded;
    a repeat that comes later still passes again. Without it every key is kept for good, so that none passes twice.
    """
    if time is None:
        return events.dropDuplicates(list(key))
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def first_keeper(path: str, order: str, *key: str, kept: int = 1000) -> Callable[[DataFrame, int], None]:
    """A consumer that writes order, first and repeat of each event: first is the number of the first event with its key
    (for which nulls are equal), repeat whether that is another one; a repeat comes with what it repeats.

    The state is a table of keys and their first events, a folder for each batch, of which the last so many are looked
    into and the rest is deleted: it is bounded, and a key that comes after that is first again. A batch that is tried
    again reads the folders before its own and replaces that, so each event is written once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        text = F.concat_ws("\x1e", *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in key))
        keyed = batch.select(F.col(order), F.sha2(text, 256).alias("key"))
        own = keyed.groupBy("key").agg(F.min(order).alias("own"))
        if old := numbered(spark, f"{path}/firsts", number - kept, number):
            known = spark.read.parquet(*old).groupBy("key").agg(F.min("first").alias("known"))
            own = own.join(known, "key", "left")
        else:
            own = own.withColumn("known", F.lit(None).cast("long"))
        firsts = own.select("key", F.coalesce("known", "own").cast("long").alias("first"), F.col("known").isNull().alias("new"))
        firsts.where("new").select("key", "first").write.mode("overwrite").parquet(f"{path}/firsts/batch={number}")
        found = keyed.join(firsts, "key").select(order, "first", (F.col("first") != F.col(order)).alias("repeat"))
        found.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        for gone in numbered(spark, f"{path}/firsts", 0, number - kept):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return handle


def numbered(spark: SparkSession, path: str, low: int, high: int) -> list[str]:
    """The folders of the batches from low up to, not with, high."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return [f"{path}/{n}" for n in sorted(names) if n.startswith("batch=") and low <= int(n[6:]) < high]


def batches_with_first(events: DataFrame, order: str, key: list[str], batches: int = 4) -> DataFrame:
    """A table of events read as a stream in so many batches of its order: what first_keeper() says of each event."""
    spark = events.sparkSession
    path = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}"
    low, high = events.agg(F.min(order), F.max(order)).first()
    step = 1 if low is None else (high - low) // batches + 1
    for i in range(batches):  # the log grows, and the consumer takes up where its cursor is
        if low is not None:
            events.where(F.col(order).between(low + i * step, low + (i + 1) * step - 1)).write.parquet(f"{path}/log/batch={i}")
            source = read(spark, f"{path}/log/batch=*", events.schema)
            start(source, first_keeper(path, order, *key), f"{path}/cursor").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(order, "first", "repeat") if low is not None else spark.createDataFrame([], f"{order} long, first long, repeat boolean")


def start(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch to a consumer; its cursor moves only when the batch is done."""
    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def appender(path: str, *order: str) -> Callable[[DataFrame, int], None]:
    """A consumer that numbers a batch after what the log holds and appends it, each batch once."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        root = fs_path.getParent()
        last = 0
        if fs.exists(root) and fs.listStatus(root):
            done = spark.read.parquet(path).where(F.col("batch") < number)
            last = done.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = with_positions(batch, *order, name="seq", start=last + 1)
        numbered.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def counts(events: DataFrame, time: str = "ts", span: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Extension: events of each kind and time window, by event time with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, span), "event_type").agg(F.count("*").alias("n"))
