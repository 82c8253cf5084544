"""Taking in batches: what is new, changed, gone or forgotten, and whether a removal is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.sources.records import InputError


def without_forgotten(batch: DataFrame, forgotten: DataFrame, key: str = "id") -> DataFrame:
    return batch.join(forgotten, key, "left_anti")


def forgotten_stored(stored: DataFrame, forgotten: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(forgotten, key, "left_semi")


def diff(batch: DataFrame, stored: DataFrame, forgotten: DataFrame | None = None, mode: str = "upsert", complete: bool = True, key: str = "id", content: str = "sha") -> DataFrame:
    """key and action of each record: added, updated, unchanged, removed, forgotten or kept.

    One full outer join on the key. In a complete snapshot what the batch lacks is removed; otherwise only what
    is forgotten. Forgotten records of the batch are not taken.
    """
    if mode not in ("upsert", "snapshot"):
        raise InputError("mode is upsert or snapshot")
    new = batch.select(key, F.col(content).alias("new"), F.lit(True).alias("in_batch"))
    old = stored.select(key, F.col(content).alias("old"), F.lit(True).alias("in_store"))
    both = new.join(old, key, "full_outer")
    if forgotten is not None:
        both = both.join(forgotten.select(key).distinct().withColumn("gone", F.lit(True)), key, "left")
    else:
        both = both.withColumn("gone", F.lit(None).cast("boolean"))
    return both.select(key, action_of(mode, complete).alias("action"))


ACTIONS = ("added", "updated", "unchanged", "removed", "forgotten", "kept")


def action_of(mode: str, complete: bool) -> Column:
    """What becomes of a key, from in_batch, in_store, gone (forgotten), and its new and old content."""
    return (
        F.when(F.col("gone") & F.col("in_store").isNotNull(), "removed")
        .when(F.col("gone"), "forgotten")
        .when(F.col("in_store").isNull(), "added")
        .when(F.col("in_batch").isNull(), F.lit("removed" if mode == "snapshot" and complete else "kept"))
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged")
        .otherwise("updated")
    )


def blocked(counts: dict[str, int]) -> bool:
    """The guard's verdict from counters: a snapshot that leaves nothing, or drops over half of ten or more."""
    existing = counts["updated"] + counts["unchanged"] + counts["removed"] + counts["kept"]
    return existing > 0 and (counts["added"] + existing == counts["removed"] or existing >= 10 and 2 * counts["removed"] > existing)


def counters(actions: DataFrame) -> DataFrame:
    """One row of how many records each action has."""
    return actions.agg(*(F.count_if(F.col("action") == n).alias(n) for n in ACTIONS))


def guard(actions: DataFrame) -> DataFrame:
    """existing, removed, surviving and blocked: a snapshot that leaves nothing, or drops over half of ten or more."""
    c = counters(actions)
    existing = F.col("updated") + F.col("unchanged") + F.col("removed") + F.col("kept")
    surviving = F.col("added") + existing - F.col("removed")
    blocked = (existing > 0) & ((surviving == 0) | ((existing >= 10) & (2 * F.col("removed") > existing)))
    return c.select(existing.alias("existing"), F.col("removed"), surviving.alias("surviving"), blocked.alias("blocked"))


def commit(batch: DataFrame, actions: DataFrame, path: str, number: int, key: str = "id", allow_removal: bool = False) -> DataFrame:
    """Add a batch's changes to a store's log of changes: new and changed records whole, removed ones by key.

    What a batch leaves alone isn't written again. A number is written once; the same batch tried again is refused
    by the folder that it made. The guard's verdict comes first.
    """
    if not allow_removal and guard(actions).first()["blocked"]:
        raise InputError("the snapshot removes too many records")
    done = actions.where(F.col("action").isin("added", "updated", "removed")).select(key, F.col("action") == "removed")
    done.toDF(key, CHANGE).join(batch, key, "left").write.mode("errorifexists").parquet(f"{path}/batch={number}")
    return counters(actions)


#: The column of a change log that marks what is gone.
CHANGE = "_removed"


def current(changes: DataFrame, key: str = "id") -> DataFrame:
    """The records that a log of changes leaves: each key's latest, without those that are removed."""
    fields = [c for c in changes.columns if c not in (key, CHANGE, "batch")]
    latest = changes.groupBy(key).agg(F.max_by(F.struct(CHANGE, *fields), "batch").alias("r"))
    return latest.where(~F.col(f"r.{CHANGE}")).select(key, *(F.col("r").getField(c).alias(c) for c in fields))


def compact(changes: DataFrame, path: str, key: str = "id") -> None:
    """Write what a log leaves as the first batch of a log of its own."""
    current(changes, key).withColumn(CHANGE, F.lit(False)).write.mode("errorifexists").parquet(f"{path}/batch=0")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows share."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
