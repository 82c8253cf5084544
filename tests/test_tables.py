"""The store as a partitioned table: what scans read, and what batches write."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordmill.operators import ingest
from recordmill.sources import tables


def rows_of(spark, *rows):
    df = spark.createDataFrame(list(rows), "source string, id string, sha string")
    return df.withColumn("path", F.concat(F.lit("memories/"), "source", F.lit("/"), F.sha2("id", 256), F.lit(".json")))


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    tables.write(rows_of(spark, *((s, f"{s}-{i}", "old") for s in ("a", "b", "1e5") for i in range(60))), path)
    return path


def files(root):
    return {str(p.relative_to(root.removeprefix("file://"))): p.stat().st_mtime_ns for p in Path(root.removeprefix("file://")).rglob("*.parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, root):
    found = tables.scan(spark, root, scope="memories/a/3")
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(source" in plan and "(source" in plan and "StringStartsWith(path,memories/a/3)" in plan and "GreaterThanOrEqual(path,memories/a/3)" in plan
    assert {r.path[:12] for r in found.collect()} == {"memories/a/3"}
    assert found.count() == tables.read(spark, root).where("path like 'memories/a/3%'").count() > 0
    assert tables.scan(spark, root, "1e5").count() == 60 and tables.scan(spark, root, scope="memories/").count() == 180


def test_a_batch_writes_only_what_it_touches(spark, root):
    before = files(root)
    batch = rows_of(spark, ("a", "a-1", "new"), ("a", "a-2", "old"), ("a", "a-new", "new")).drop("source")
    done = tables.take_in(spark, root, "a", batch)
    slots = {r.slot for r in batch.select(tables.slot_of(F.col("path")).alias("slot")).collect()}
    assert set(done.slots) == slots and not done.blocked
    assert done.counters["added"] == 1 and done.counters["updated"] == 1 and done.counters["unchanged"] == 1 and done.counters["removed"] == 0
    after = files(root)
    untouched = [f for f in before if not any(f.startswith(f"source=a/slot={s}/") for s in slots)]
    assert len(untouched) > 30 and all(after[f] == before[f] for f in untouched)
    held = {r.id: r.sha for r in tables.read(spark, root).where("source = 'a'").collect()}
    assert len(held) == 61 and held["a-1"] == "new" and held["a-new"] == "new" and held["a-3"] == "old"


def test_snapshots_guard_and_forget(spark, root):
    batch = rows_of(spark, *(("a", f"a-{i}", "old") for i in range(20))).drop("source")
    before = files(root)
    done = tables.take_in(spark, root, "a", batch, "snapshot")
    assert done.blocked and files(root) == before and done.counters["removed"] == 40
    done = tables.take_in(spark, root, "a", batch, "snapshot", complete=False, forgotten=spark.createDataFrame([("a-3",), ("a-50",), ("zz",)], "id string"))
    assert (done.counters["removed"], done.counters["kept"], done.counters["unchanged"]) == (2, 39, 19)
    done = tables.take_in(spark, root, "a", batch, "snapshot", allow_removal=True)
    assert {r.id for r in tables.read(spark, root).where("source = 'a'").collect()} == {f"a-{i}" for i in range(20)}
    tables.take_in(spark, root, "a", batch.where("false"), "snapshot", allow_removal=True)
    assert tables.read(spark, root).count() == 120


def test_verdict_is_the_guards(spark):
    for counts in ((0, 0, 3, 7, 0, 0), (1, 0, 4, 6, 0, 0), (0, 0, 0, 3, 0, 0), (2, 0, 0, 2, 0, 0), (0, 0, 0, 0, 0, 0), (0, 1, 1, 5, 9, 3), (5, 0, 0, 20, 0, 0)):
        actions = [(i, n) for n, k in zip(ingest.ACTIONS, counts) for i in range(k)]
        df = spark.createDataFrame(actions, "id long, action string")
        assert ingest.guard(df).first()["blocked"] == ingest.blocked(dict(zip(ingest.ACTIONS, counts)))
