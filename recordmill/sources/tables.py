"""A store of records as one Parquet table, partitioned by source and slot and sorted by path within.

A slot is the first hexadecimal digit of a record's file name, or _ for other names: 17 at most for a source. A
source or a scope prunes partitions, and a path's beginning row groups, as it comes to the scan as bounds. A batch is
read and joined once: the plan that writes the touched partitions to a staging folder observes the counters, which
decide whether they are published or dropped; no other partition is written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.operators import ingest
from recordmill.sources.records import InputError
from recordmill.sources.scratch import shared_dir

PARTITIONS = ("source", "slot")


def slot_of(path: Column) -> Column:
    first = F.lower(F.left(F.element_at(F.split(path, "/"), -1), F.lit(1)))
    return F.when(first.rlike("^[0-9a-f]$"), first).otherwise("_")


def write(records: DataFrame, root: str) -> None:
    """Write records (source, path and more) as a store; ranges of source, slot and path, so that a large source is many files."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.withColumn("slot", slot_of(F.col("path")))
    rows.repartitionByRange(parts, *PARTITIONS, "path").sortWithinPartitions(*PARTITIONS, "path").write.partitionBy(*PARTITIONS).parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The whole store. Partition names are text, whatever they look like."""
    found = spark.read.parquet(root).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in PARTITIONS else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(root)


def scan(spark: SparkSession, root: str, source: str | None = None, scope: str | None = None) -> DataFrame:
    """The records of a source, or whose paths begin with a scope, by filters that reach partitions and row groups."""
    found = read(spark, root)
    if source is not None:
        found = found.where(F.col("source") == source)
    at = (scope or "").lstrip("/")
    if at:
        folders = at.split("/")
        if folders[0] == "memories" and len(folders) > 2:
            found = found.where(F.col("source") == folders[1])
            if len(folders) == 3 and folders[2]:
                found = found.where(F.col("slot") == (folders[2][0].lower() if folders[2][0].lower() in "0123456789abcdef" else "_"))
        elif folders[0] == "memories" and len(folders) == 2:
            found = found.where(F.col("source").startswith(folders[1]))
        elif len(folders) > 1:
            found = found.where(F.col("source") == folders[0])
        found = found.where(F.col("path").startswith(at) & (F.col("path") >= at) & (F.col("path") <= at + "\U0010ffff"))
    return found


@dataclass(frozen=True)
class Ingested:
    """What a batch did: its counters, whether the guard held it back, and the slots that were replaced."""

    counters: dict[str, int]
    blocked: bool
    slots: tuple[str, ...]


def take_in(spark: SparkSession, root: str, source: str, batch: DataFrame, mode: str = "upsert", complete: bool = True, forgotten: DataFrame | None = None, key: str = "id", content: str = "sha", allow_removal: bool = False) -> Ingested:
    """Take a source's batch into the store. batch: the table's columns without source and slot, one row a key.

    The touched slots are those of the batch's paths, or all of the source where a snapshot or forgotten keys may remove
    records elsewhere. The staged partitions are put in place one after another by renaming; a batch that breaks off there
    is taken in again to the same end.
    """
    if mode not in ("upsert", "snapshot"):
        raise InputError("mode is upsert or snapshot")
    stored = read(spark, root).where(F.col("source") == source)
    names = [c for c in stored.columns if c not in PARTITIONS]
    new = batch.select(*names).withColumn("slot", slot_of(F.col("path")))
    if mode == "upsert" and forgotten is None:
        touched = [r["slot"] for r in new.select("slot").distinct().collect()]  # 17 at most
        stored = stored.where(F.col("slot").isin(touched)) if touched else stored.where("false")
    row = F.struct(*names, "slot")
    both = new.select(key, F.col(content).alias("new"), F.lit(True).alias("in_batch"), row.alias("new_row")).join(stored.select(key, F.col(content).alias("old"), F.lit(True).alias("in_store"), row.alias("old_row")), key, "full_outer")
    gone = F.lit(None).cast("boolean").alias("gone")
    both = both.select("*", gone) if forgotten is None else both.join(forgotten.select(key).distinct().withColumn("gone", F.lit(True)), key, "left")
    both = both.withColumn("action", ingest.action_of(mode, complete))
    seen = Observation()
    both = both.observe(seen, *(F.count_if(F.col("action") == n).alias(n) for n in ingest.ACTIONS))
    kept = F.when(F.col("action").isin("added", "updated"), F.col("new_row")).when(F.col("action").isin("unchanged", "kept"), F.col("old_row"))
    staged = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/staged"
    rows = both.select(kept.alias("r")).where("r IS NOT NULL").select("r.*", F.lit(source).alias("source"))
    rows.sortWithinPartitions("slot", "path").write.partitionBy(*PARTITIONS).parquet(staged)
    counts = {n: int(seen.get[n]) for n in ingest.ACTIONS}
    blocked = mode == "snapshot" and complete and not allow_removal and ingest.blocked(counts)
    slots = () if blocked else publish(spark, staged, root, source, None if mode == "snapshot" or forgotten is not None else touched)
    folder(spark, staged)[0].delete(folder(spark, staged)[1], True)
    return Ingested(counts, blocked, slots)


def folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def publish(spark: SparkSession, staged: str, root: str, source: str, touched: list[str] | None) -> tuple[str, ...]:
    """Put the staged slots of a source in the place of its old ones; a touched slot that has no records left goes."""
    def slots_in(path: str) -> set[str]:
        fs, place = folder(spark, path)
        return {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(place) if "=" in s.getPath().getName()} if fs.exists(place) else set()

    name = escaped(spark, source)
    ready, old = slots_in(f"{staged}/source={name}"), slots_in(f"{root}/source={name}")
    done = sorted((old if touched is None else old & set(touched)) | ready)
    for slot in done:
        fs, place = folder(spark, f"{root}/source={name}/slot={slot}")
        fs.delete(place, True)
        if slot in ready:
            fs.mkdirs(place.getParent())
            if not fs.rename(folder(spark, f"{staged}/source={name}/slot={slot}")[1], place):
                raise InputError(f"slot {slot} of {source} couldn't be put in place")
    spark.catalog.refreshByPath(root)
    return tuple(done)


def escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as its folder has it."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
