"""Connected components: forests of bounded parts of the edges, then alternating large and small stars as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.shared import discard, lean, materialize, with_hot

#: Rounds after which something must be wrong; each at least halves the longest path.
MOST_ROUNDS = 64
#: Edges of a part whose forest one task finds.
PART = 200_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of the edges but the smallest of its tree: the node (u) and the smallest (v)."""
    above: dict = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    kinds = None
    for batch in batches:
        kinds = [batch.column(c).type for c in "uv"]
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [x for x in above if root(x) != x]
    for lo in range(0, len(found), 10_000):
        some = found[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kinds[0]), pa.array(map(root, some), kinds[1])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node with an edge to another: node, label (the smallest node that it reaches).

    Edges with a null end and self-loops are ignored; repeated edges count once; no edges give no rows. The edges are
    dealt in parts of at most about PART, whose forests replace them; with one part that is all. Else minima are combined before each shuffle, and hubs' minima are broadcast, so a hub with a third of all edges doesn't
    gather them in one task.
    """
    spark = edges.sparkSession
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = materialize(now, "edges"), None
    parts = -(-now.count() // PART)
    kind = now.schema["u"].dataType.simpleString()
    trees = materialize(now.repartition(max(1, parts)).mapInArrow(lean(forest), f"u {kind}, v {kind}"), "edges")
    discard(spark, now)
    now, rows = trees, trees.count()
    for _ in range(MOST_ROUNDS if parts > 1 else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = materialize(with_hot(both, low, "u", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = with_hot(large, low, "u", 2 * rows).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", "m")).toDF("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(spark, large)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = after
        if state == seen:
            break
        seen, rows = state, state[0]
    else:
        if parts > 1:
            raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
