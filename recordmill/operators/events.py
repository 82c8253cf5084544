"""The event log: order, cursors, rules, repeats, the kept tail, schedules and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.sources.records import InputError

# Fixed values of the log: what is kept, and how failures are held back.
KEEP_LINES, KEEP_BYTES = 1000, 4 << 20
COMPACT_BYTES, COMPACT_EVERY = 8 << 20, 200
BACKOFF_FIRST, BACKOFF_DOUBLINGS, BACKOFF_CAP = 60, 10, 3600


def after_cursor(events: DataFrame, cursor: int, seq: str = "seq") -> DataFrame:
    """Events past a cursor; a cursor past the log's end starts over.

    The log's end is looked up first, so that the filter is one with a number, which reaches the scan.
    """
    latest = events.agg(F.max(seq)).first()[0]  # one number
    return events.where(F.col(seq) > (0 if latest is not None and 0 < latest < cursor else cursor))


def merge_cursor(stored: Column, target: Column, disk: Column) -> Column:
    """The cursor to keep when another writer may have moved it.

    A target past the log's end (disk) isn't taken, as it would skip events; where the log was cut below what was stored the
    target starts over; else the cursor never goes back.
    """
    return F.when(target > disk, stored).when(disk < stored, target).otherwise(F.greatest(stored, target))


def first_of_repeats(events: DataFrame, *key: str, seq: str = "event_id") -> DataFrame:
    """The earliest event of each key; combined before the shuffle."""
    return events.groupBy(*key).agg(F.min(seq).alias(seq))


def head_match(kind: Column, source: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether any rule (kind, source; empty matches all) matches."""
    found = F.lit(False)
    for k, s in rules:
        found = found | ((F.lit(True) if not k else kind == k) & (F.lit(True) if not s else source == s))
    return found


def rule_filter(rules: list[tuple[str, str, Column | None]], kind: Column, source: Column) -> Column:
    """Whether any rule's head matches and its filter, if it has one, is true; null and errors count as false."""
    found = F.lit(False)
    for k, s, where in rules:
        head = head_match(kind, source, [(k, s)])
        found = found | (head if where is None else head & F.coalesce(where, F.lit(False)))
    return found


def rules_of_heads(events: DataFrame, rules: DataFrame, kind: str, source: str) -> DataFrame:
    """_kind, _source, filter, n and first: how many rules with this filter match the events of a kind and source, and the
    least of them. rules: rule, kind, source (empty ones match all) and filter (empty: none).

    Events are reduced to their distinct heads first; each asks for its own kind and source, with either or both open,
    by one equality join with the rules counted by theirs.
    """
    heads = events.select(F.col(kind).alias("_kind"), F.col(source).alias("_source")).distinct()
    open_ = F.lit("")
    ways = [(F.col("_kind"), F.col("_source")), (F.col("_kind"), open_), (open_, F.col("_source")), (open_, open_)]
    asked = heads.select("*", F.explode(F.array_distinct(F.array(*(F.struct(k.alias("kind"), s.alias("source")) for k, s in ways)))).alias("way")).select("_kind", "_source", "way.kind", "way.source")
    counted = rules.groupBy("kind", "source", "filter").agg(F.count("*").alias("n"), F.min("rule").alias("first"))
    return asked.join(counted, ["kind", "source"]).groupBy("_kind", "_source", "filter").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


#: Different filters that a table of rules may have; each becomes a branch of one expression.
MOST_FILTERS = 500


def rule_matches(events: DataFrame, rules: DataFrame, compiled: Callable[[str], Column] | None = None, kind: str = "kind", source: str = "source", key: str = "event_id") -> DataFrame:
    """key, n and first: how many rules of a table match each event, and the least of them; events without any are left out.

    compiled makes a condition of a filter's text. Rules that share kind, source and filter are one row of the join, so an
    event meets as many rows as its head's rules have filters, never the rules themselves.
    """
    rules = rules.select("rule", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("source", F.lit("")).alias("source"), (F.coalesce("filter", F.lit("")) if "filter" in rules.columns else F.lit("")).alias("filter"))
    found = rules_of_heads(events, rules, kind, source)
    texts = [r["filter"] for r in rules.where("filter != ''").select("filter").distinct().limit(MOST_FILTERS + 1).collect()]
    if len(texts) > MOST_FILTERS:
        raise InputError(f"more than {MOST_FILTERS} different filters")
    holds = F.when(F.col("filter") == "", True)
    for text in sorted(texts):
        holds = holds.when(F.col("filter") == text, F.coalesce(compiled(text), F.lit(False)))
    both = events.join(found, F.col(kind).eqNullSafe(F.col("_kind")) & F.col(source).eqNullSafe(F.col("_source")))
    return both.where(holds).groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def tail(events: DataFrame, lines: int, order: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc(order)).limit(lines)


def compacted(events: DataFrame, size: Column, lines: int = KEEP_LINES, budget: int = KEEP_BYTES, order: str = "event_id") -> DataFrame:
    """The newest events that fit the lines and, summed from the newest, the bytes. The limit bounds the window."""
    newest = events.orderBy(F.desc(order)).limit(lines).withColumn("_size", size)
    running = F.sum("_size").over(W.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return newest.withColumn("_sum", running).where(F.col("_sum") <= budget).drop("_size", "_sum")


def compaction_due(seq: int, size: int) -> bool:
    """Whether the log is compacted after an event: it is large, or the event is one of every so many past the first."""
    return size > COMPACT_BYTES or (seq > KEEP_LINES and seq % COMPACT_EVERY == 0)


def keep_newest(rows: DataFrame, n: int, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def backoff_seconds(failures: Column, cap: Column | int = BACKOFF_CAP) -> Column:
    """How long to wait after so many failures in a row."""
    held = F.least(F.lit(BACKOFF_FIRST) * F.pow(F.lit(2), F.least(failures - 1, F.lit(BACKOFF_DOUBLINGS))), F.lit(cap) if isinstance(cap, int) else cap)
    return F.when(failures > 0, held).otherwise(0).cast("long")


def schedule_due(now: Column, anchor: Column, every: Column | int) -> Column:
    """Due without an anchor, or when so many seconds have passed."""
    return anchor.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(anchor) >= every)


def window_start(now: Column, last_success: Column, overlap: int = 0, lookback: int = 86400) -> Column:
    """Where a collection begins: a little before the last success, or a day back."""
    return F.coalesce(last_success - F.make_dt_interval(secs=F.lit(overlap)), now - F.make_dt_interval(secs=F.lit(lookback)))


def trigger(event: Column, schedule: Column) -> Column:
    return F.when(event, "event").when(schedule, "schedule").otherwise("idle")


def runs(events: DataFrame, unit: str, order: str, failed: Column) -> DataFrame:
    """runs, failures and consecutive failures (since the last success) of each unit, without a window.

    The last success is one aggregate; failures after it are counted beside it.
    """
    marked = events.select(unit, F.col(order).alias("_o"), failed.alias("_f"))
    last = marked.groupBy(unit).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("_ok"), F.count("*").alias("runs"), F.count_if("_f").alias("failures"))
    since = marked.where("_f").join(last.select(unit, "_ok"), unit).where(F.col("_ok").isNull() | (F.col("_o") > F.col("_ok"))).groupBy(unit).agg(F.count("*").alias("consecutive"))
    return last.join(since, unit, "left").select(unit, "runs", "failures", F.coalesce("consecutive", F.lit(0)).alias("consecutive"))


def due_units(units: DataFrame, states: DataFrame, taken: DataFrame, now: Column) -> DataFrame:
    """name, trigger (event, schedule, idle, held) and wait (seconds still to go) of every unit.

    units: name, every (seconds; null: no schedule) and cap; states: name, failures (in a row), last_end and
    last_scheduled, a unit without one being idle and fresh; taken: name and n, how many new events its rules take. An event
    comes before a schedule; after failures a unit is held back.
    """
    each = units.join(states.select("name", "failures", "last_end", "last_scheduled"), "name", "left").join(taken.select("name", "n"), "name", "left")
    failures = F.coalesce("failures", F.lit(0))
    pause = backoff_seconds(failures, F.coalesce("cap", F.lit(BACKOFF_CAP)))
    left = F.greatest(F.lit(0), F.coalesce(pause - (F.unix_timestamp(now) - F.unix_timestamp("last_end")), F.lit(0))).cast("long")
    due = F.col("every").isNotNull() & schedule_due(now, F.col("last_scheduled"), F.col("every"))
    ready = trigger(F.coalesce("n", F.lit(0)) > 0, due)
    return each.select("name", F.when(left > 0, "held").otherwise(ready).alias("trigger"), left.alias("wait"))


def orphans(states: DataFrame, configured: DataFrame, name: str) -> DataFrame:
    """States of units that are no longer configured."""
    return states.join(configured, name, "left_anti")
