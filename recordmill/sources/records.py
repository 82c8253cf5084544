"""Records: views over tables, trees of JSON files, batches, logs and tombstones."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions import values as V
from recordmill.sources.scratch import shared_dir

#: Columns of a search target: the record's own fields and where it is kept.
CORE = ("path", "ref", "source", "kind", "id", "title", "text")


class InputError(ValueError):
    """A batch or argument that can't be taken as it is."""


def record_view(rows: DataFrame, source: Column, record_id: Column, title: Column, text: Column, *more: str) -> DataFrame:
    """Rows of any table as records; kind is memory, or the singular of an authored source."""
    id_ = record_id.cast("string")
    kind = F.when(source.isin(*V.AUTHORED), F.rtrim(source, F.lit("s"))).otherwise("memory")
    return rows.select(V.record_path(source, id_).alias("path"), F.concat(source, F.lit(":"), id_).alias("ref"), source.alias("source"), kind.alias("kind"), id_.alias("id"), title.alias("title"), text.alias("text"), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return record_view(rows, F.col("source"), F.col("doc_id"), F.concat(F.lit("document "), F.col("doc_id")), F.col("text"), "doc_id", "lang", "n_chars")


def line_of(df: DataFrame) -> Column:
    """The record as the line of JSON that searches look at."""
    names = [c for c in ("id", "kind", "ref", "source", "text", "title") if c in df.columns]
    return F.to_json(F.struct(*names))


#: Files that a scan takes at most, and folders below its root.
MOST_FILES, DEEPEST = 100_000, 64


def read_tree(spark: SparkSession, root: str, suffix: str = "json", most_bytes: int = 64 << 20) -> DataFrame:
    """path (below the root), size, modified and text of each file; larger files come with a null text.

    Contents of larger files aren't read: the filter on length reaches the reader, and their rows come from a listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    below = below_root(F.col("path"), root)
    small = files.where(F.col("length") <= most_bytes).select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    large = files.where(F.col("length") > most_bytes).select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("text"))
    return small.unionByName(large).where(F.size(F.split("path", "/")) <= DEEPEST)


def list_tree(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """Paths below the root and lengths, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}" if suffix != "*" else "*").load(root)
    return files.select(below_root(F.col("path"), root).alias("path"), "length")


def checked_count(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The files, if they are no more than a scan may take."""
    if files.select("path").limit(most + 1).count() > most:
        raise InputError(f"more than {most} files")
    return files


def below_root(path: Column, root: str) -> Column:
    """A file's path after its root, whatever scheme both are written with; the first place where the root stands."""
    bare = F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:/*", "/")
    base = "/" + re.sub("^[a-z][a-z0-9+.-]*:/*", "/", root).strip("/") + "/"
    return F.regexp_replace(bare, f"^.*?{_quoted(base)}", "")


def write_tree(records: DataFrame, root: str, path: str = "path", line: str = "line") -> None:
    """Each record as a file of its own below the root; each is written beside its place and then moved there, so that
    readers see whole files only. Tasks may be tried again: the same file is written again."""

    def run(rows) -> None:
        for r in rows:
            place = Path(root) / r[path]
            place.parent.mkdir(parents=True, exist_ok=True)
            replace_file(place, (r[line] + "\n").encode())

    records.select(path, line).foreachPartition(run)


def replace_file(place: Path, data: bytes) -> None:
    """Write a file whole or not at all: beside its place, flushed, then moved over it, its folder flushed too."""
    beside = place.with_name(f".{place.name}.{os.getpid()}.new")
    try:
        with open(beside, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, place)
    finally:
        beside.unlink(missing_ok=True)
    flush_folder(place.parent)


def flush_folder(folder: Path) -> None:
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def delete_file(place: Path) -> bool:
    """Remove a file and the folders that it leaves empty, up to the store's own; whether there was one."""
    if not place.exists():
        return False
    place.unlink()
    flush_folder(place.parent)
    return True


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "") + "\\E"


def strict_json(text: Column) -> Column:
    """The value as VARIANT; null for duplicate keys, NaN and anything that isn't JSON."""
    return F.try_parse_json(text)


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Split decoded rows from problems: doc (VARIANT) and problem (null if sound)."""
    doc = strict_json(F.col(text))
    return df.withColumn("doc", doc).withColumn("problem", F.when(F.col("doc").isNull(), F.lit("not strict JSON")).when(~F.schema_of_variant("doc").startswith("OBJECT"), F.lit("not an object")))


def canonical(value: object) -> str:
    """Sorted keys, compact, finite numbers; the bytes that are kept and hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def canonical_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add line: the canonical form of each JSON text, null for what isn't strict JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(decode(t))
        except (InputError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(t) for t in batch.column(text).to_pylist()], pa.string())], [*batch.schema.names, "line"])

    found = df.drop("line")
    return found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", line string")


def batches_of(df: DataFrame, text: str = "batch", *keep: str) -> DataFrame:
    """The records of each batch, a row each: the kept columns, record (canonical JSON), missing (null: complete; -1:
    unknown) and problem. A batch that can't be taken is one row with a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, records, missing, problems = [], [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                try:
                    found, lacks = parse_batch((t or "").encode())
                    rows = [(canonical(r).rstrip("\n"), lacks, None) for r in found]
                except InputError as error:
                    rows = [(None, None, str(error))]
                for record, lacks, problem in rows:
                    at.append(i)
                    records.append(record)
                    missing.append(lacks)
                    problems.append(problem)
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(records, pa.string()), pa.array(missing, pa.int64()), pa.array(problems, pa.string())], [*keep, "record", "missing", "problem"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(text, *keep).mapInArrow(run, f"{fields}record string, missing long, problem string")


def decode(text: str) -> object:
    """Strict JSON: no duplicate keys and no NaN or infinities."""

    def pairs(found):
        out = dict(found)
        if len(out) < len(found):
            raise InputError("duplicate key")
        return out

    def refuse(name):
        raise InputError(f"{name} is not JSON")

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    except json.JSONDecodeError as error:
        raise InputError(str(error)) from error


def parse_batch(data: bytes, most_bytes: int = 16 << 20) -> tuple[list[dict], int | None]:
    """The records of a batch and how many it says are missing (None: it is complete; -1: unknown).

    A batch is an array, an envelope {"records": [...], "incomplete": ...}, one object, or an object a line. Other keys
    of an envelope are left aside; null is complete.
    """
    if len(data) > most_bytes:
        raise InputError("batch is too large")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise InputError("batch is not UTF-8") from error
    if not text.strip():
        return [], None
    missing = None
    try:
        whole = decode(text)
    except InputError:
        lines = [line for line in text.splitlines() if line.strip()]
        if len(lines) < 2:
            raise
        whole = [decode(line) for line in lines]
    if isinstance(whole, dict) and "records" in whole:
        state = False if whole.get("incomplete") is None else whole["incomplete"]
        if isinstance(state, dict):
            missed = state.get("missed")
            if set(state) != {"missed"} or type(missed) is not int or missed < 0:
                raise InputError("incomplete takes true, false or {missed: n}")
            missing = missed or None  # none missed is a complete batch
        elif type(state) is not bool:
            raise InputError("incomplete takes true, false or {missed: n}")
        elif state:
            missing = -1
        whole = whole["records"]
    elif isinstance(whole, dict):
        whole = [whole]
    if not isinstance(whole, list) or not all(isinstance(r, dict) for r in whole):
        raise InputError("a batch holds objects")
    return whole, missing


def forgotten_ids(text: str) -> list[str]:
    """Ids of a tombstone file: a line each, without blank lines and # comments."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def with_positions(df: DataFrame, *order: Column | str, name: str = "pos", start: int = 1) -> DataFrame:
    """Number all rows in an order without bringing them into one task: ranges, then the counts of ranges before.

    The ranges are written once and numbered from what was written, so that a lost stage can't cut them elsewhere.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/ranged"
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).write.parquet(path)
    ranged = spark.read.parquet(path)
    firsts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("part", "first", before.alias("before"))  # a row for each range
    number = (F.col("before") + F.col("place") - F.col("first") + start).alias(name)
    return ranged.join(F.broadcast(firsts), "part").select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != name), number)


def with_running(df: DataFrame, value: Column, *order: Column | str, name: str = "running", start: int = 0) -> DataFrame:
    """Add the sum of a value over all rows up to each, in an order, without bringing them into one task.

    As in with_positions(), ranges are written once; each is summed by itself, after the sums of the ranges before.
    Rows that are equal in the order are summed in some order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/ranged"
    ranged = df.select(F.struct("*").alias("row"), value.alias("value"), F.struct(*order).alias("order")).repartitionByRange(parts, "order").sortWithinPartitions("order")
    ranged.select("row", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).write.parquet(path)
    ranged = spark.read.parquet(path)
    sums = ranged.groupBy("part").agg(F.sum("value").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("before"))  # a row for each range
    own = F.sum("value").over(W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    found = ranged.withColumn("own", own).join(F.broadcast(sums), "part")
    return found.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != name), (F.col("before") + F.col("own") + start).alias(name))
