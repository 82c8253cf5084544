"""Queries over batches and links: diffs, guards, broken links, backlinks, newer evidence, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordmill.functions import values as V
from recordmill.operators import graph, ingest, review
from recordmill.plans.search_queries import as_notes, read
from recordmill.sources import notes

NOW = "1998-06-01T00:00:00.000000Z"


def batch_and_store(spark, sf_dir):
    """A batch that overlaps a store: even documents are stored, every third comes, some with other text."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = docs.where("id % 2 = 0").select("id", V.sha256_hex(F.col("text")).alias("sha"))
    changed = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("id % 3 = 0").select("id", V.sha256_hex(changed).alias("sha")), stored


def tombstones(spark, sf_dir):
    return read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


def ingest_upsert_diff(spark, sf_dir):
    return ingest.diff(*batch_and_store(spark, sf_dir))


def ingest_counters(spark, sf_dir):
    return ingest.counters(ingest.diff(*batch_and_store(spark, sf_dir), tombstones(spark, sf_dir)))


def ingest_snapshot_diff(spark, sf_dir):
    return ingest.diff(*batch_and_store(spark, sf_dir), tombstones(spark, sf_dir), "snapshot")


def ingest_snapshot_incomplete(spark, sf_dir):
    return ingest.counters(ingest.diff(*batch_and_store(spark, sf_dir), None, "snapshot", complete=False))


def ingest_guard(spark, sf_dir):
    return ingest.guard(ingest.diff(*batch_and_store(spark, sf_dir), None, "snapshot"))


def ingest_forgotten_anti(spark, sf_dir):
    return ingest.without_forgotten(batch_and_store(spark, sf_dir)[0], tombstones(spark, sf_dir)).select("id")


def ingest_forgotten_semi(spark, sf_dir):
    return ingest.forgotten_stored(batch_and_store(spark, sf_dir)[1], tombstones(spark, sf_dir)).select("id")


def build_diff(spark, sf_dir):
    """Compiled notes against an older build that lacks some, has others, and differs in a few."""
    new = as_notes(spark, sf_dir).select(F.col("doc_id").alias("id"), V.sha256_hex(F.col("text")).alias("sha"))
    old = new.where("id % 4 != 0").select((F.col("id") + F.when(F.col("id") % 7 == 0, 1000000).otherwise(0)).alias("id"), F.when(F.col("id") % 9 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha"))
    return ingest.diff(new, old, None, "snapshot")


def duplicate_ids(spark, sf_dir):
    return ingest.duplicates(read(spark, sf_dir, "lineitem"), "l_orderkey")


def lines_as_links(spark, sf_dir):
    """Order lines as edges: typed to parts, and to suppliers untyped, some of them typed beside it."""
    rows = read(spark, sf_dir, "lineitem")
    part = rows.select(F.col("l_orderkey").alias("ref"), F.concat(F.lit("part:"), "l_partkey").alias("to"), F.lit("line").alias("kind"))
    supplier = rows.select(F.col("l_orderkey").alias("ref"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to"), F.when(F.col("l_linenumber") % 2 == 0, "ships").otherwise("").alias("kind"))
    return part.union(supplier)


def typed_link_dominance(spark, sf_dir):
    return graph.typed_dominate(lines_as_links(spark, sf_dir).distinct(), F.col("kind") != "", "ref", "to")


def missing_parts(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("to"), F.col("l_suppkey").alias("source")).distinct()
    return graph.broken(links, read(spark, sf_dir, "part").where("p_partkey % 10 != 3").select(F.col("p_partkey").alias("to")))


def broken_links(spark, sf_dir):
    return missing_parts(spark, sf_dir).select(F.col("to").alias("l_partkey")).distinct()


def broken_link_severity(spark, sf_dir):
    snapshot = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source"))
    forgotten = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("to"))
    return graph.severity(missing_parts(spark, sf_dir), snapshot, forgotten).select(F.col("to").alias("l_partkey"), F.col("source").alias("l_suppkey"), "severity")


def missing_anchors(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("to"), F.col("l_linenumber").cast("string").alias("anchor"))
    anchors = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("to"), F.explode(F.sequence(F.lit(1), F.col("p_size") % 7 + 1)).alias("n")).select("to", F.col("n").cast("string").alias("anchor"))
    return graph.missing_anchors(links, anchors).select("l_orderkey", F.col("to").alias("l_partkey"), "anchor")


def backlinks(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("to")).where("ref != to")
    return graph.backlinks(links).select(F.col("to").alias("l_partkey"), "n", F.array_join("froms", ",").alias("froms"))


def linked_set(spark, sf_dir):
    links = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("ref"), F.concat(F.lit("c"), "o_custkey").alias("to"))
    return graph.both_ways(links)


def alias_backlinks(spark, sf_dir):
    links = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("urn:customer:"), "o_custkey", F.lit("#x")).alias("to"))
    names = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey", F.lit("?q=1")).alias("identity"), F.col("c_custkey").alias("ref"))
    return graph.by_identity(links, names).select("o_orderkey", F.col("target").alias("c_custkey"))


def cross_brain_links(spark, sf_dir):
    """Links into two stores (regions) checked against the union of their catalogues."""
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("bf://r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("to"))
    links = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("bf://r"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)) % 5, F.lit("/n"), "c_nationkey").alias("to"))
    return graph.broken(links, nation).select("c_custkey", "to")


def customer_notes(spark, sf_dir):
    """Customers as notes dated by their middle order, linked with their orders."""
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("ref"), F.concat(F.lit("c"), "o_custkey").alias("cust"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    dated = orders.groupBy("cust").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    key = F.substring("cust", 2, 20).cast("long")
    notes_ = dated.select(F.col("cust").alias("ref"), F.when(key % 3 == 0, "deprecated").otherwise("draft").alias("status"), F.when(key % 2 == 0, F.col("first")).otherwise(F.col("last")).alias("updated"), F.when(key % 5 == 0, "90d").when(key % 5 == 1, "1998-01-01").when(key % 5 == 2, "400").alias("stale_after"))
    links = graph.both_ways(orders.select("ref", F.col("cust").alias("to")))
    return notes_, links, orders.select("ref", V.ts_key(F.col("day")).alias("ts"))


def newer_evidence(spark, sf_dir):
    notes_, links, others = customer_notes(spark, sf_dir)
    found = graph.newer(notes_.select("ref", V.ts_key(F.col("updated")).alias("ts")), links, others)
    return found.select("ref", "newer_count", F.array_join("newer", ",").alias("newer"))


def latest_per_ref(spark, sf_dir):
    return graph.latest(read(spark, sf_dir, "orders").withColumn("t", V.show_time(F.col("o_orderdate"))), "o_custkey", "t")


def evidence_updated(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(V.show_time(F.col("o_orderdate"))).alias("retrieved"))).alias("sources"))
    return rows.select("o_custkey", V.ts_key(review.evidence(F.col("sources"))).alias("evidence"))


def stale_due(spark, sf_dir):
    notes_, _, _ = customer_notes(spark, sf_dir)
    due = review.is_due(F.col("updated"), F.col("stale_after"), NOW)
    return notes_.where("stale_after is not null").select("ref", due.alias("due"))


def future_updated(spark, sf_dir):
    notes_, _, _ = customer_notes(spark, sf_dir)
    return notes_.where(review.is_future(F.col("updated"), NOW)).select("ref")


def review_stale(spark, sf_dir):
    found = review.stale(*customer_notes(spark, sf_dir), NOW)
    return review.ordered(found).select("ref", F.array_join("reasons", ",").alias("reasons"), "newer_count")


def actions(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.lit("action").alias("kind"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("done").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))


def review_actions(spark, sf_dir):
    return review.open_actions(actions(spark, sf_dir)).limit(50).select("ref", "updated")


def review_rows(spark, sf_dir):
    """A whole review: stale notes with their reasons, and open actions, as one table of sections."""
    return review.rows(review.stale(*customer_notes(spark, sf_dir), NOW), review.open_actions(actions(spark, sf_dir))).select("section", "ref", F.array_join("reasons", ",").alias("reasons"))


def problems_by_kind(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    short = docs.where("n_chars < 200").select(F.lit("short").alias("kind"), F.col("doc_id").cast("string").alias("ref"), F.concat(F.lit("short "), "source").alias("msg"))
    low = read(spark, sf_dir, "labels").where("quality = 0").select(F.lit("quality").alias("kind"), F.col("doc_id").cast("string").alias("ref"), F.concat(F.lit("quality "), "doc_id").alias("msg"))
    return review.histogram(review.problems(short, low))


def validate_store(spark, sf_dir):
    """A whole store's problems, with planted ones: repeated ids, bad links, lost targets and anchors."""
    docs = read(spark, sf_dir, "documents")
    recs = docs.select(F.concat("source", F.lit(":"), F.col("doc_id") % 900).alias("ref"), "source", (F.col("doc_id") % 900).cast("string").alias("id"))
    to = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("projects/gone"), F.col("doc_id") % 20, F.lit(".md"))).when(F.col("doc_id") % 10 == 1, F.lit("/abs")).otherwise(F.lit("projects/here.md"))
    links = docs.select(F.concat(F.lit("concepts/d"), "doc_id").alias("ref"), to.alias("to"), F.lit("note").alias("kind"), F.when(F.col("doc_id") % 10 == 2, "nowhere").when(F.col("doc_id") % 10 == 3, "top").otherwise("").alias("anchor"), (F.col("doc_id") % 2 == 0).alias("authored"))
    targets = spark.createDataFrame([("projects/here.md",)], "to string")
    return review.histogram(review.validate(recs, links, targets, targets.withColumn("anchor", F.lit("top"))))


def link_problems(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("memories/"), "source", F.lit("/"), F.sha2(F.col("doc_id").cast("string"), 256), F.lit(".json")).alias("rec"))
    forms = [("url", F.lit("https://x.y")), ("url", F.lit("ftp://x.y")), ("record", F.col("rec")), ("record", F.lit("memories/notes/x.json")), ("note", F.lit("projects/a.md")), ("note", F.lit("other/a.md")), ("brain", F.lit("bf://b/p/a.md")), ("brain", F.lit("bf://b"))]
    rows = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("to")) for k, t in forms))).alias("l")).select("doc_id", "l.kind", "l.to")
    return rows.withColumn("problem", V.link_problem(F.col("kind"), F.col("to"), F.lit(""))).where("problem != ''").groupBy("problem").agg(F.count("*").alias("n"))


def note_links(spark, sf_dir):
    return graph.edges(notes.compile_notes(as_notes(spark, sf_dir))).select("ref", "to", "kind", "anchor", "section")


STORE = "stored AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0), batch AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 3 = 0), gone AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1)"


def _diff(forgotten, removed):
    rule = "WHEN g.id IS NOT NULL AND s.id IS NOT NULL THEN 'removed' WHEN g.id IS NOT NULL THEN 'forgotten' " if forgotten else ""
    return f"SELECT coalesce(b.id, s.id) AS id, CASE {rule}WHEN s.id IS NULL THEN 'added' WHEN b.id IS NULL THEN '{removed}' WHEN b.sha = s.sha THEN 'unchanged' ELSE 'updated' END AS action FROM batch b FULL JOIN stored s ON b.id = s.id LEFT JOIN gone g ON g.id = coalesce(b.id, s.id)"


COUNTS = "SELECT " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ("added", "updated", "unchanged", "removed", "forgotten", "kept")) + " FROM d"
CUSTOMERS = """o AS (SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS ref, o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
n AS (SELECT k, 'c' || k AS ref, CASE WHEN k % 3 = 0 THEN 'deprecated' ELSE 'draft' END AS status, CASE WHEN k % 2 = 0 THEN min(day) ELSE max(day) END AS updated, CASE WHEN k % 5 = 0 THEN '90d' WHEN k % 5 = 1 THEN '1998-01-01' WHEN k % 5 = 2 THEN '400' END AS stale_after FROM o GROUP BY k),
w AS (SELECT n.ref, count(*) AS newer_count, array_to_string(list_slice(list_sort(list(o.ref)), 1, 5), ',') AS newer FROM n JOIN o USING (k) WHERE o.day > n.updated GROUP BY n.ref)"""
DUE = f"CASE k % 5 WHEN 0 THEN TIMESTAMP '1998-06-01' >= CAST(updated AS TIMESTAMP) + INTERVAL 90 DAY WHEN 1 THEN true WHEN 2 THEN date_diff('day', CAST(updated AS DATE), DATE '1998-06-01') >= 400 ELSE false END"
SQL = {
    "ingest_upsert_diff": f"WITH {STORE} {_diff(False, 'kept')}",
    "ingest_counters": f"WITH {STORE}, d AS ({_diff(True, 'kept')}) {COUNTS}",
    "ingest_snapshot_diff": f"WITH {STORE} {_diff(True, 'removed')}",
    "ingest_snapshot_incomplete": f"WITH {STORE}, d AS ({_diff(False, 'kept')}) {COUNTS}",
    "ingest_guard": f"WITH {STORE}, d AS ({_diff(False, 'removed')}), c AS ({COUNTS}), e AS (SELECT updated + unchanged + removed + kept AS existing, removed, added + updated + unchanged + kept AS surviving FROM c) SELECT existing, removed, surviving, existing > 0 AND (surviving = 0 OR (existing >= 10 AND removed * 2 > existing)) AS blocked FROM e",
    "ingest_forgotten_anti": f"WITH {STORE} SELECT id FROM batch WHERE id NOT IN (SELECT id FROM gone)",
    "ingest_forgotten_semi": f"WITH {STORE} SELECT id FROM stored WHERE id IN (SELECT id FROM gone)",
    "build_diff": """WITH o AS (SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000 ELSE 0 END AS id, doc_id % 9 != 0 AS same FROM documents WHERE doc_id % 4 != 0)
        SELECT coalesce(d.doc_id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' WHEN same THEN 'unchanged' ELSE 'updated' END AS action FROM documents d FULL JOIN o ON o.id = d.doc_id""",
    "duplicate_ids": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "typed_link_dominance": """WITH e AS (SELECT DISTINCT l_orderkey AS ref, 'part:' || l_partkey AS "to", 'line' AS kind FROM lineitem UNION SELECT l_orderkey, 'supplier:' || l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'ships' ELSE '' END FROM lineitem)
        SELECT ref, "to", kind FROM e QUALIFY kind != '' OR max(kind) OVER (PARTITION BY ref, "to") = ''""",
    "broken_links": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 != 3)",
    "broken_link_severity": "SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) THEN 'warning' ELSE 'error' END AS severity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 != 3)",
    "missing_anchors": "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS VARCHAR) AS anchor FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL OR l_linenumber > p_size % 7 + 1",
    "backlinks": "SELECT l_partkey, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FILTER (WHERE r <= 20) AS froms FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey != l_orderkey)) GROUP BY 1",
    "linked_set": "SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS other FROM orders UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders",
    "alias_backlinks": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "cross_brain_links": """WITH c AS (SELECT *, (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) % 5 AS r FROM customer) SELECT c_custkey, 'bf://r' || r || '/n' || c_nationkey AS "to" FROM c WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r AND n_nationkey = c_nationkey)""",
    "newer_evidence": f"WITH {CUSTOMERS} SELECT ref, newer_count, newer FROM w",
    "latest_per_ref": "SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS latest FROM orders GROUP BY 1",
    "evidence_updated": "SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59.999999Z' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000Z' END) AS evidence FROM orders GROUP BY 1",
    "stale_due": f"WITH {CUSTOMERS} SELECT ref, {DUE} AS due FROM n WHERE stale_after IS NOT NULL",
    "future_updated": f"WITH {CUSTOMERS} SELECT ref FROM n WHERE updated > '1998-06-01'",
    "review_stale": f"WITH {CUSTOMERS}, r AS (SELECT n.ref, list_filter([CASE WHEN updated > '1998-06-01' THEN 'future_updated' END, CASE WHEN stale_after IS NOT NULL AND {DUE} THEN 'due' END, CASE WHEN newer_count > 0 THEN 'newer_evidence' END], lambda x: x IS NOT NULL) AS reasons, coalesce(newer_count, 0) AS newer_count FROM n LEFT JOIN w ON w.ref = n.ref WHERE status != 'deprecated') SELECT ref, array_to_string(reasons, ',') AS reasons, newer_count FROM r WHERE len(reasons) > 0",
    "review_actions": "SELECT o_orderkey AS ref, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_orderstatus = 'O' ORDER BY 2 DESC, 1 DESC LIMIT 50",
    "review_rows": f"""WITH {CUSTOMERS}, r AS (SELECT n.ref, list_filter([CASE WHEN updated > '1998-06-01' THEN 'future_updated' END, CASE WHEN stale_after IS NOT NULL AND {DUE} THEN 'due' END, CASE WHEN newer_count > 0 THEN 'newer_evidence' END], lambda x: x IS NOT NULL) AS reasons, coalesce(newer_count, 0) AS newer_count FROM n LEFT JOIN w ON w.ref = n.ref WHERE status != 'deprecated') SELECT 'stale' AS section, ref, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0 UNION ALL SELECT 'action_open', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderstatus = 'O'""",
    "problems_by_kind": "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'short' AS kind, source AS x FROM documents WHERE n_chars < 200 UNION ALL SELECT DISTINCT 'quality', CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) GROUP BY 1",
    "validate_store": """SELECT kind, count(*) AS n FROM (
        SELECT 'duplicate_id' AS kind, source || '/' || (doc_id % 900) AS x FROM documents GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'link', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 1
        UNION ALL SELECT 'broken_link', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 0
        UNION ALL SELECT 'missing_anchor', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 2) GROUP BY 1""",
    "link_problems": "SELECT p AS problem, count(*) AS n FROM documents, (SELECT unnest(['url', 'record', 'note', 'brain']) AS p) GROUP BY 1",
    "note_links": """SELECT 'concepts/doc-' || doc_id || '.md' AS ref, 'concepts/doc-' || (doc_id + 1) || '.md' AS "to", 'note' AS kind, 'top' AS anchor, 'links' AS section FROM documents""",
}
QUERIES = {
    f.__name__: f
    for f in (
        ingest_upsert_diff, ingest_counters, ingest_snapshot_diff, ingest_snapshot_incomplete, ingest_guard, ingest_forgotten_anti, ingest_forgotten_semi, build_diff, duplicate_ids, typed_link_dominance,
        broken_links, broken_link_severity, missing_anchors, backlinks, linked_set, alias_backlinks, cross_brain_links, newer_evidence, latest_per_ref, evidence_updated, stale_due, future_updated, review_stale,
        review_actions, review_rows, problems_by_kind, validate_store, link_problems, note_links,
    )
}
