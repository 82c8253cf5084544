"""Queries over the event log: cursors, rules, repeats, the kept tail, schedules, runs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recordmill.functions import values as V
from recordmill.operators import events as E
from recordmill.plans.jq.compiler import condition
from recordmill.plans.search_queries import read
from recordmill.sources import records
from recordmill.sources.scratch import shared_dir
from recordmill.streaming import log, sequence

NOW = "2024-06-01T00:00:00Z"
SIZE = "octet_length(props) + octet_length(event_type) + 40"


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("seq", F.col("event_id") + 1)


def events_latest_seq(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("seq").alias("latest"))


def events_after_cursor(spark, sf_dir):
    return E.after_cursor(read(spark, sf_dir, "events"), 599, "event_id").select((F.col("event_id") + 1).alias("seq"))


def cursor_reset(spark, sf_dir):
    return E.after_cursor(events(spark, sf_dir), 10**9).agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def cursor_merge(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("event_id") % 17).alias("stored"), (F.col("event_id") % 13).alias("target"), (F.col("event_id") % 11).alias("disk"))
    return rows.select("event_id", E.merge_cursor(F.col("stored"), F.col("target"), F.col("disk")).alias("cursor"))


def events_dedupe(spark, sf_dir):
    return E.first_of_repeats(events(spark, sf_dir), "event_type", "user_id", "props").select("event_id")


def event_rule_match(spark, sf_dir):
    source = F.concat(F.lit("user-"), "user_id")
    return events(spark, sf_dir).where(E.head_match(F.col("event_type"), source, [("click", ""), ("", "user-7"), ("error", "user-3")])).select("event_id")


def event_rule_filter(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("data", F.from_json("props", "k long"))
    source = F.concat(F.lit("user-"), "user_id")
    rules = [("click", "", condition(rows, ".data.k > 50")), ("", "user-7", None), ("error", "", condition(rows, '.data.k < 10 or .event_type == "none"'))]
    return rows.where(E.rule_filter(rules, F.col("event_type"), source)).select("event_id")


def rules_table(spark, sf_dir):
    """A rule for each customer: for a kind, a user, both or neither, some with a filter."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, ("click", "error", "view", "purchase"))), (F.col("c_custkey") % 4 + 1).cast("int")))
    source = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("user-"), F.col("c_custkey") % 400))
    where = F.element_at(F.array(*map(F.lit, ("", "", ".data.k > 50", ".data.k < 10 or .value > 90"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule"), kind.alias("kind"), source.alias("source"), where.alias("filter"))


def event_rules_table(spark, sf_dir):
    """Events against all rules of a table: how many match, and the first."""
    rows = events(spark, sf_dir).withColumns({"data": F.from_json("props", "k long"), "user": F.concat(F.lit("user-"), "user_id")})
    return E.rule_matches(rows, rules_table(spark, sf_dir), lambda text: condition(rows, text), "event_type", "user")


def events_stream_first(spark, sf_dir):
    """Events read as a stream in batches of their order, repeats planted late: each with the first event like it."""
    return log.batches_with_first(planted(spark, sf_dir), "event_id", ["event_type", "user_id", "k"])


def planted(spark, sf_dir):
    """All events, and every third once more at the end of the log."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    last = rows.agg(F.max("event_id").alias("m"))
    again = rows.where("event_id % 3 = 0").crossJoin(F.broadcast(last))  # one row
    return rows.unionByName(again.select((F.col("event_id") + F.col("m") + 1).alias("event_id"), "event_type", "user_id", "k"))


def events_compaction(spark, sf_dir):
    return E.compacted(events(spark, sf_dir), F.expr(SIZE), budget=30000).select("event_id")


def events_tail(spark, sf_dir):
    return E.tail(events(spark, sf_dir), 50).select("event_id")


def events_seq_assign(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "ts")
    return records.with_positions(rows, "ts", "event_id", name="seq").select("event_id", "seq")


def backoff(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("event_id") % 14).alias("failures")).distinct()
    return rows.select("failures", E.backoff_seconds(F.col("failures")).alias("wait"))


def schedule_due(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("anchor"))
    return rows.select("event_id", E.schedule_due(F.to_timestamp(F.lit(NOW)), F.col("anchor"), 86400 * 150).alias("due"))


def window_bounds(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("last"))
    return rows.select("event_id", V.show_time(E.window_start(F.to_timestamp(F.lit(NOW)), F.col("last"), 300)).alias("start"))


def due_selection(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("event_type") == "error").alias("e"), (F.col("value") > 50).alias("s"))
    return rows.select("event_id", E.trigger(F.col("e"), F.col("s")).alias("trigger"))


def run_status_rollup(spark, sf_dir):
    return E.runs(events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")


def status_orphans(spark, sf_dir):
    states = events(spark, sf_dir).select("user_id").distinct()
    return E.orphans(states, read(spark, sf_dir, "customer").where("c_custkey % 4 != 0").select(F.col("c_custkey").alias("user_id")), "user_id")


def retention_keep_n(spark, sf_dir):
    return E.keep_newest(events(spark, sf_dir), 3, "event_type", F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


def latency_stats(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.min("value").alias("min_value"), F.median("value").alias("median_value"), F.max("value").alias("max_value"))
    return rows


def emit_events(spark, sf_dir):
    """Events made from documents: all are well-formed, or none is emitted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("documents."), "lang").alias("kind"))
    bad = docs.where(~F.col("kind").rlike(V.EVENT_KIND)).limit(1).agg(F.count("*").alias("bad"))
    return docs.crossJoin(F.broadcast(bad)).where("bad = 0").select("doc_id", "kind")  # one row


def units_due(spark, sf_dir):
    """A unit for each customer: its state by the user's events, its rule the clicks past a cursor."""
    rows = events(spark, sf_dir)
    units = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 7 + 1) * 86400 * 30).alias("every"), F.when(F.col("c_custkey") % 2 == 0, 600).alias("cap"))
    failed = F.col("event_type") == "error"
    times = rows.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_end"), F.max(F.when(~failed, F.col("ts").cast("timestamp"))).alias("last_scheduled"))
    states = E.runs(rows, "user_id", "event_id", failed).join(times, "user_id").select(F.col("user_id").alias("name"), F.col("consecutive").alias("failures"), "last_end", "last_scheduled")
    taken = rows.where("event_type = 'click' and event_id % 11 = 0").groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("n"))
    # the time is the log's end, so that some units are still held back
    now = rows.agg(F.max(F.col("ts").cast("timestamp")).alias("now")).first()["now"]
    return E.due_units(units, states, taken, F.lit(now))


def events_by_seq(spark, sf_dir):
    """The log as a stream by sequence numbers: three appends, each read from the cursor on, then a log begun anew."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = f"{shared_dir(spark)}/recordmill/sequence-{uuid.uuid4().hex}"
    parts = [rows.where(F.col("event_id") % 3 == k) for k in range(3)] + [rows.where("event_id % 5 = 0")]
    fields = StructType([StructField("seq", LongType()), *rows.schema.fields])
    for number, part in enumerate(parts):
        if number == 3:
            sequence.clear(spark, f"{out}/log")
        sequence.append(part, f"{out}/log", "ts", "event_id")

        def write(batch, n, number=number):
            batch.select(F.lit(number).cast("long").alias("pass"), "seq", "event_id").write.mode("overwrite").parquet(f"{out}/read/batch={n}")

        log.start(sequence.read(spark, f"{out}/log", fields), write, f"{out}/cursor").awaitTermination()
    return spark.read.schema("pass long, seq long, event_id long").option("recursiveFileLookup", "true").parquet(f"{out}/read")


def stream_counts(spark, sf_dir):
    """The log as a stream that has ended: events of each kind, by a memory of what each batch held."""
    return read_stream(spark, sf_dir, lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")))


def read_stream(spark, sf_dir, then):
    schema = read(spark, sf_dir, "events").schema
    source = log.read(spark, f"{sf_dir}/events.parquet*", schema)
    out = f"{shared_dir(spark)}/recordmill/stream-{uuid.uuid4().hex}"
    query = log.start(log.without_repeats(source, "event_id"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/log/batch={n}"), f"{out}/cursor")
    query.awaitTermination()
    return then(spark.read.parquet(f"{out}/log"))


SQL = {
    "events_latest_seq": "SELECT max(event_id) + 1 AS latest FROM events",
    "events_after_cursor": "SELECT event_id + 1 AS seq FROM events WHERE event_id + 1 > CASE WHEN 600 > (SELECT max(event_id) + 1 FROM events) THEN 0 ELSE 600 END",
    "cursor_reset": "SELECT count(*) AS n, min(event_id) + 1 AS first FROM events",
    "event_rules_table": """WITH r AS (SELECT c_custkey AS rule, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ['click', 'error', 'view', 'purchase'][c_custkey % 4 + 1] END AS kind, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'user-' || (c_custkey % 400) END AS source, c_custkey % 4 AS f FROM customer),
e AS (SELECT event_id, event_type, 'user-' || user_id AS source, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, count(*) AS n, min(rule) AS first FROM e JOIN r ON r.kind IN ('', e.event_type) AND r.source IN ('', e.source) AND CASE f WHEN 2 THEN k > 50 WHEN 3 THEN coalesce(k, -1) < 10 OR value > 90 ELSE true END GROUP BY 1""",
    "events_stream_first": """WITH e AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events), p AS (SELECT * FROM e UNION ALL SELECT event_id + (SELECT max(event_id) FROM e) + 1, event_type, user_id, k FROM e WHERE event_id % 3 = 0)
SELECT event_id, min(event_id) OVER (PARTITION BY event_type, user_id, k) AS first, event_id > min(event_id) OVER (PARTITION BY event_type, user_id, k) AS repeat FROM p""",
    "cursor_merge": "SELECT event_id, CASE WHEN event_id % 13 > event_id % 11 THEN event_id % 17 WHEN event_id % 11 < event_id % 17 THEN event_id % 13 ELSE greatest(event_id % 17, event_id % 13) END AS cursor FROM events",
    "events_dedupe": "SELECT min(event_id) AS event_id FROM events GROUP BY event_type, user_id, props",
    "event_rule_match": "SELECT event_id FROM events WHERE event_type = 'click' OR user_id = 7 OR (event_type = 'error' AND user_id = 3)",
    "event_rule_filter": "SELECT event_id FROM events, LATERAL (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k) WHERE (event_type = 'click' AND coalesce(k > 50, false)) OR user_id = 7 OR (event_type = 'error' AND coalesce(k < 10, true))",
    "events_compaction": "SELECT event_id FROM (SELECT event_id, sum(strlen(props) + strlen(event_type) + 40) OVER (ORDER BY event_id DESC) AS s FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000)) WHERE s <= 30000",
    "events_tail": "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50",
    "events_seq_assign": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events",
    "backoff": "SELECT f AS failures, CAST(CASE WHEN f = 0 THEN 0 ELSE least(60 * (1 << least(f - 1, 10)), 3600) END AS BIGINT) AS wait FROM (SELECT DISTINCT event_id % 14 AS f FROM events)",
    "schedule_due": "SELECT event_id, event_id % 5 = 0 OR floor(epoch(TIMESTAMP '2024-06-01')) - floor(epoch(ts)) >= 12960000 AS due FROM events",
    "window_bounds": "SELECT event_id, strftime(CASE WHEN event_id % 3 != 0 THEN ts - INTERVAL 300 SECOND ELSE TIMESTAMP '2024-05-31' END, '%Y-%m-%dT%H:%M:%SZ') AS start FROM events",
    "due_selection": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'event' WHEN value > 50 THEN 'schedule' ELSE 'idle' END AS trigger FROM events",
    "run_status_rollup": """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS f, max(CASE WHEN event_type != 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ok FROM events)
        SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE f) AS failures, count(*) FILTER (WHERE f AND (ok IS NULL OR event_id > ok)) AS consecutive FROM e GROUP BY user_id""",
    "status_orphans": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 != 0)",
    "retention_keep_n": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3",
    "units_due": """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS f, max(CASE WHEN event_type != 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ok FROM events),
s AS (SELECT user_id, count(*) FILTER (WHERE f AND (ok IS NULL OR event_id > ok)) AS failures, max(ts) AS last_end, max(ts) FILTER (WHERE NOT f) AS last_scheduled FROM e GROUP BY 1),
t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 11 = 0 GROUP BY 1), w AS (SELECT floor(epoch(max(ts))) AS w FROM events),
u AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 3 != 0 THEN (c_custkey % 7 + 1) * 2592000 END AS every, CASE WHEN c_custkey % 2 = 0 THEN 600 ELSE 3600 END AS cap FROM customer),
j AS (SELECT name, every, n, last_scheduled, CAST(CASE WHEN failures > 0 THEN greatest(0, least(60 * (1 << least(failures - 1, 10)), cap) - (w - floor(epoch(last_end)))) ELSE 0 END AS BIGINT) AS wait FROM u LEFT JOIN s ON s.user_id = name LEFT JOIN t ON t.user_id = name, w)
SELECT name, CASE WHEN wait > 0 THEN 'held' WHEN n > 0 THEN 'event' WHEN every IS NOT NULL AND (last_scheduled IS NULL OR (SELECT w FROM w) - floor(epoch(last_scheduled)) >= every) THEN 'schedule' ELSE 'idle' END AS trigger, wait FROM j""",
    "events_by_seq": """SELECT event_id % 3 AS pass, row_number() OVER (ORDER BY event_id % 3, ts, event_id) AS seq, event_id FROM events
UNION ALL SELECT 3, row_number() OVER (ORDER BY ts, event_id), event_id FROM events WHERE event_id % 5 = 0""",
    "latency_stats": "SELECT event_type, min(value) AS min_value, median(value) AS median_value, max(value) AS max_value FROM events GROUP BY 1",
    "emit_events": "SELECT doc_id, 'documents.' || lang AS kind FROM documents",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        events_latest_seq, events_after_cursor, cursor_reset, cursor_merge, events_dedupe, event_rule_match, event_rule_filter, event_rules_table, events_stream_first, events_compaction, events_tail, events_seq_assign, backoff, schedule_due,
        window_bounds, due_selection, run_status_rollup, status_orphans, retention_keep_n, latency_stats, units_due, emit_events, events_by_seq, stream_counts,
    )
}
