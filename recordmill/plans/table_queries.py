"""Queries over a store as a partitioned table: pruned scans, and batches that replace what they touch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recordmill.functions import values as V
from recordmill.plans.search_queries import VIEW, read
from recordmill.sources import records, tables
from recordmill.sources.scratch import shared_dir

SOURCE = "src1"


def stored(spark, rows) -> str:
    """The records written as a store of its own; its root."""
    root = f"{shared_dir(spark)}/recordmill/{uuid.uuid4().hex}/table"
    tables.write(rows, root)
    return root


def view(spark, sf_dir):
    return records.documents(spark, sf_dir).withColumn("sha", V.sha256_hex(F.col("text"))).select("source", "path", "id", "doc_id", "title", "text", "sha")


def batch_of(spark, sf_dir):
    """Every third document of the source, some with other text, for a store of the even ones."""
    rows = view(spark, sf_dir)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    batch = rows.where(f"source = '{SOURCE}' and doc_id % 3 = 0").withColumn("text", text).withColumn("sha", V.sha256_hex(F.col("text")))
    return stored(spark, rows.where("doc_id % 2 = 0")), batch.drop("source")


def tombstones(spark, sf_dir):
    return read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))


def table_source(spark, sf_dir):
    return tables.scan(spark, stored(spark, view(spark, sf_dir)), SOURCE).select("doc_id", "path", "sha")


def table_scope(spark, sf_dir):
    """The records whose files' names begin with a digit of their hash, as a scope."""
    return tables.scan(spark, stored(spark, view(spark, sf_dir)), scope=f"memories/{SOURCE}/3").select("doc_id", "path")


def table_upsert(spark, sf_dir):
    """What a store holds after a batch for one source."""
    root, batch = batch_of(spark, sf_dir)
    tables.take_in(spark, root, SOURCE, batch)
    return tables.read(spark, root).select("doc_id", "source", "sha")


def table_snapshot(spark, sf_dir):
    """What a store holds after a snapshot of one source, forgotten records aside; all else of the source goes."""
    root, batch = batch_of(spark, sf_dir)
    tables.take_in(spark, root, SOURCE, batch, "snapshot", forgotten=tombstones(spark, sf_dir), allow_removal=True)
    return tables.read(spark, root).select("doc_id", "source", "sha")


def table_counters(spark, sf_dir):
    """The counters that the write of an incomplete snapshot observed, and the guard's verdict on a complete one."""
    root, batch = batch_of(spark, sf_dir)
    first = tables.take_in(spark, root, SOURCE, batch, "snapshot", complete=False, forgotten=tombstones(spark, sf_dir))
    then = tables.take_in(spark, root, SOURCE, batch.where("doc_id % 9 = 0"), "snapshot")
    return spark.createDataFrame([(*first.counters.values(), then.blocked)], ", ".join(f"{n} long" for n in first.counters) + ", blocked boolean")


QUERIES = {f.__name__: f for f in (table_source, table_scope, table_upsert, table_snapshot, table_counters)}
S = f"""v AS (SELECT doc_id, source, text, sha256(text) AS sha, path FROM ({VIEW})), store AS (SELECT * FROM v WHERE doc_id % 2 = 0),
batch AS (SELECT doc_id, source, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS sha FROM v WHERE source = '{SOURCE}' AND doc_id % 3 = 0), gone AS (SELECT doc_id FROM labels WHERE toxic = 1)"""
MINE = f"(SELECT doc_id, sha FROM store WHERE source = '{SOURCE}')"
SQL = {
    "table_source": f"SELECT doc_id, path, sha256(text) AS sha FROM ({VIEW}) WHERE source = '{SOURCE}'",
    "table_scope": f"SELECT doc_id, path FROM ({VIEW}) WHERE path LIKE 'memories/{SOURCE}/3%'",
    "table_upsert": f"WITH {S} SELECT doc_id, source, sha FROM batch UNION ALL SELECT doc_id, source, sha FROM store WHERE doc_id NOT IN (SELECT doc_id FROM batch)",
    "table_snapshot": f"WITH {S} SELECT doc_id, source, sha FROM batch WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT doc_id, source, sha FROM store WHERE source != '{SOURCE}'",
    "table_counters": f"""WITH {S}, a AS (SELECT CASE WHEN g.doc_id IS NOT NULL AND s.doc_id IS NOT NULL THEN 'removed' WHEN g.doc_id IS NOT NULL THEN 'forgotten' WHEN s.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'kept' WHEN b.sha = s.sha THEN 'unchanged' ELSE 'updated' END AS action
FROM batch b FULL JOIN {MINE} s ON b.doc_id = s.doc_id LEFT JOIN gone g ON g.doc_id = coalesce(b.doc_id, s.doc_id)), c AS (SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (action = 'forgotten') AS forgotten, count(*) FILTER (action = 'kept') AS kept FROM a),
h AS (SELECT coalesce(b.doc_id, s.doc_id) AS doc_id FROM batch b FULL JOIN {MINE} s ON b.doc_id = s.doc_id WHERE coalesce(b.doc_id, s.doc_id) NOT IN (SELECT doc_id FROM gone)), n AS (SELECT count(*) AS existing, count(*) FILTER (h.doc_id NOT IN (SELECT doc_id FROM batch WHERE doc_id % 9 = 0)) AS removed FROM h)
SELECT c.*, existing > 0 AND ((SELECT count(*) FROM batch WHERE doc_id % 9 = 0) = 0 OR existing >= 10 AND 2 * n.removed > existing) AS blocked FROM c, n""",
}
