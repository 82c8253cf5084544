"""Links as edges: where they lead, what is missing, who links back, and what is newer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edges(records: DataFrame, links: str = "links") -> DataFrame:
    """ref, to, kind, anchor, meta and section of each link."""
    return records.select("ref", F.explode(links).alias("l")).select("ref", "l.to", "l.kind", "l.anchor", "l.meta", "l.section")


def broken(links: DataFrame, targets: DataFrame, to: str = "to") -> DataFrame:
    """Links whose target is not there. Repeated targets do no harm here, while making them distinct holds a task's in memory."""
    return links.join(targets.select(to), to, "left_anti")


def severity(missing: DataFrame, snapshot_sources: DataFrame, forgotten: DataFrame, source: str = "source", to: str = "to") -> DataFrame:
    """warning where the target's source is taken in snapshots or the target is forgotten; else error."""
    marked = missing.join(snapshot_sources.select(source).distinct().withColumn("_s", F.lit(True)), source, "left")
    marked = marked.join(forgotten.select(to).distinct().withColumn("_f", F.lit(True)), to, "left")
    return marked.withColumn("severity", F.when(F.col("_s") | F.col("_f"), "warning").otherwise("error")).drop("_s", "_f")


def missing_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links with an anchor that their target doesn't have.

    Both sides are sorted: anchors come of lists in few small rows, so Spark, which goes by those, would broadcast any number.
    """
    return links.where("anchor != ''").join(anchors.select("to", "anchor").hint("merge"), ["to", "anchor"], "left_anti")


#: What makes two links of a record the same but for their type.
LINK_KEY = ("to", "kind", "anchor", "section")


def typed_dominate(links: DataFrame, typed: Column | None = None, *key: str) -> DataFrame:
    """All typed links, and the others that have no typed one with their key. A link is typed by what it carries (meta),
    unless a condition says otherwise; nothing else is left out, so two typed links with one key both stay."""
    key = key or tuple(c for c in ("ref", *LINK_KEY) if c in links.columns)
    typed = F.coalesce(typed if typed is not None else F.size("meta") > 0, F.lit(False))
    beside = links.where(typed).select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return links.where(typed).unionByName(links.where(~typed).join(beside, same, "left_anti"))


def backlinks(links: DataFrame, source: str = "ref", to: str = "to", first: int = 20) -> DataFrame:
    """to, n and froms (the first few, distinct and in order) of incoming links; a hub's others are counted only.

    The rank is limited before the shuffle, so no task holds all that link to one target.
    """
    each = links.where(F.col(source) != F.col(to)).select(to, source).distinct()
    few = each.withColumn("rank", F.row_number().over(W.partitionBy(to).orderBy(source))).where(F.col("rank") <= first)
    froms = few.groupBy(to).agg(F.sort_array(F.collect_list(source)).alias("froms"))
    return each.groupBy(to).agg(F.count("*").alias("n")).join(froms, to)


def both_ways(links: DataFrame, source: str = "ref", to: str = "to") -> DataFrame:
    """node and other for every link in both directions, without repeats and self-links."""
    out = links.select(F.col(source).alias("node"), F.col(to).alias("other"))
    return out.union(out.select("other", "node")).where("node != other").distinct()


def by_identity(links: DataFrame, identities: DataFrame, to: str = "to") -> DataFrame:
    """Links resolved to the records whose names or aliases they use. identities: identity, ref."""
    named = identities.select(identity_key(F.col("identity")).alias("_k"), F.col("ref").alias("target")).distinct()
    return links.withColumn("_k", identity_key(F.col(to))).join(named, "_k").drop("_k")


def identity_key(name: Column) -> Column:
    """A name without fragment, query, and urn: in front."""
    return F.regexp_replace(F.regexp_replace(name, r"[#?].*$", ""), "^urn:", "")


def newer(notes: DataFrame, linked: DataFrame, others: DataFrame, first: int = 5) -> DataFrame:
    """ref, newer_count and newer (the first few, in order) of linked records with a later time.

    An equality join on the links with the comparison as a filter; only the first few are kept beside the count.
    """
    both = notes.join(linked.withColumnsRenamed({"node": "ref"}), "ref").join(others.select(F.col("ref").alias("other"), F.col("ts").alias("other_ts")), "other")
    later = both.where("other_ts > ts").select("ref", "other").distinct()
    w = W.partitionBy("ref").orderBy("other")
    top = later.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).groupBy("ref").agg(F.sort_array(F.collect_list("other")).alias("newer"))
    return later.groupBy("ref").agg(F.count("*").alias("newer_count")).join(top, "ref")


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("latest"))
