"""Reviews: what is due, dated ahead, or has newer evidence; and validation of a whole store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import values as V
from recordmill.operators import graph


def is_future(ts: Column, now: str) -> Column:
    """Whether a time is past now; a date alone is so from the day after now's on."""
    return F.coalesce(F.when(F.length(ts) == 10, ts > F.lit(now[:10])).otherwise(V.ts_key(ts) > V.ts_key(F.lit(now))), F.lit(False))


def is_due(updated: Column, stale_after: Column, now: str) -> Column:
    """Whether a note is past its time to live: whole days, a duration, or a date or time.

    Without a date, days and durations are due. A date alone counts from its midnight. Values that are none of
    these, or durations over 100 years, are compared as text.
    """
    at = F.to_timestamp(F.lit(now))
    start = F.coalesce(F.try_to_timestamp(V.normalize_date(updated)), V.zoned(updated))
    days = F.when(stale_after.rlike("^[0-9]+$"), stale_after.cast("int"))
    seconds = V.duration_seconds(stale_after)
    limit = F.coalesce(F.try_to_timestamp(V.normalize_date(stale_after)), V.zoned(stale_after))
    return F.coalesce(
        F.when(days.isNotNull(), start.isNull() | (F.datediff(at, start) >= days))
        .when(seconds.isNotNull(), start.isNull() | (F.unix_micros(at) >= F.unix_micros(start) + (seconds * 1000000).cast("long")))
        .when(limit.isNotNull(), at >= limit)
        .otherwise(F.lit(now) >= stale_after),
        F.lit(False),
    )


def evidence(sources: Column) -> Column:
    """The latest of the times at which sources were retrieved, dates as their end."""
    return F.array_max(F.transform(sources, lambda s: F.struct(V.ts_key(s["retrieved"]).alias("key"), s["retrieved"].alias("raw"))))["raw"]


def stale(notes: DataFrame, linked: DataFrame, others: DataFrame, now: str) -> DataFrame:
    """ref, reasons, newer_count and newer of notes that need a look. notes: ref, status, updated, stale_after.

    Deprecated notes take no part. Reasons come in a fixed order; rows are not sorted here.
    """
    live = notes.where(F.coalesce(F.col("status") != "deprecated", F.lit(True))).withColumn("ts", V.ts_key(F.col("updated")))
    found = graph.newer(live.where("ts is not null").select("ref", "ts"), linked, others)
    all_ = live.join(found, "ref", "left")
    reasons = F.array_compact(
        F.array(
            F.when(is_future(F.col("updated"), now), "future_updated"),
            F.when(F.col("stale_after").isNotNull() & is_due(F.col("updated"), F.col("stale_after"), now), "due"),
            F.when(F.col("newer_count") > 0, "newer_evidence"),
        )
    )
    out = all_.select("ref", reasons.alias("reasons"), F.coalesce("newer_count", F.lit(0)).alias("newer_count"), "newer")
    return out.where(F.size("reasons") > 0)


def ordered(stale_rows: DataFrame) -> DataFrame:
    """Most reasons first, then most newer evidence, then by ref."""
    return stale_rows.orderBy(F.desc(F.size("reasons")), F.desc("newer_count"), "ref")


def open_actions(notes: DataFrame) -> DataFrame:
    """Draft actions, latest first."""
    return notes.where("kind = 'action' and status = 'draft'").orderBy(F.desc(V.ts_key(F.col("updated"))), F.desc("ref"))


def rows(stale_rows: DataFrame, actions: DataFrame) -> DataFrame:
    """A review as one table: section (stale or action_open), ref, reasons, newer_count and newer."""
    ref = F.col("ref").cast("string").alias("ref")
    first = stale_rows.select(F.lit("stale").alias("section"), ref, "reasons", "newer_count", "newer")
    return first.unionByName(actions.select(F.lit("action_open").alias("section"), ref), allowMissingColumns=True)


def problems(*found: DataFrame) -> DataFrame:
    """Problems (kind, ref, msg) of all checks, each message once; messages are told apart by a 128-bit hash."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(F.xxhash64("msg").alias("a"), F.xxhash64(F.lit(1), "msg").alias("b")).agg(F.min(F.struct("kind", "ref", "msg")).alias("first")).select("first.*")


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def validate(records: DataFrame, links: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Problems of a store: repeated ids, malformed links, links to nothing, and anchors that aren't there.

    records: ref, source, id; links: ref, to, kind, anchor, authored; targets: to; anchors: to, anchor.
    Only authored notes' links are looked up; all links' shapes are checked.
    """
    again = records.groupBy("source", "id").agg(F.count("*").alias("n"), F.min("ref").alias("ref")).where("n > 1")
    again = again.select(F.lit("duplicate_id").alias("kind"), "ref", F.concat(F.lit("duplicate id "), "source", F.lit(":"), "id").alias("msg"))
    shape = links.withColumn("p", V.link_problem(F.col("kind"), F.col("to"), F.col("anchor"))).where("p != ''")
    shape = shape.select(F.lit("link").alias("kind"), "ref", F.concat("ref", F.lit(": "), "p", F.lit(" link "), "to").alias("msg"))
    looked = links.where("authored and kind in ('note', 'record')")
    gone = graph.broken(looked, targets).select(F.lit("broken_link").alias("kind"), "ref", F.concat("ref", F.lit(": missing "), "to").alias("msg"))
    anchor = graph.missing_anchors(looked, anchors).join(targets.select("to").distinct(), "to", "left_semi")
    anchor = anchor.select(F.lit("missing_anchor").alias("kind"), "ref", F.concat("ref", F.lit(": no #"), "anchor", F.lit(" in "), "to").alias("msg"))
    return problems(again, shape, gone, anchor)
