"""Nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched by beams.

Equal vectors are one node that holds their smallest ids. A shard is a random part of the nodes of bounded
size. Its graph grows in doubling batches: each new node is sought greedily, the nodes met on the way are its
candidates, and relaxed pruning keeps those that no kept one covers; edges back are pruned alike. A further
coordinate makes nearness by inner product one of distance. Every query visits every shard of its length, in
bounded blocks, and the best of all shards stay, scored in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.llm.shared import materialize

#: Nodes of a shard, and queries of a block that visits it, at most (about).
SHARD, BLOCK = 16_384, 16_384
#: Edges of a node; beam of a build and of a search; relaxation of pruning; nodes sought side by side.
DEGREE, BUILD_BEAM, BEAM, RELAX, SIDE = 40, 64, 160, 1.15, 512


class Graph:
    """Vectors with the further coordinate, edges (-1 for none), and where searches begin."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, start: int):
        self.x, self.edges, self.start = x, edges, start
        self.norms = (x * x).sum(axis=1)

    def seek(self, q: np.ndarray, beam: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes of its beam, nearest first (-1 for none), and the nodes it went through."""
        b = len(q)
        rows = np.arange(b)
        ids = np.full((b, beam), -1)
        far = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        far[:, 0] = self.norms[self.start] - 2 * (q @ self.x[self.start])
        passed = []
        while not done.all():
            live = ~done.all(axis=1)
            at = np.where(live, done.argmin(axis=1), 0)
            done[rows[live], at[live]] = True
            node = np.where(live, ids[rows, at], -1)
            if trail:
                passed.append(node)
            near = np.where(live[:, None], self.edges[node], -1)
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            seen[np.nonzero(fresh)[0], near[fresh]] = True
            d = np.where(fresh, self.norms[near] - 2 * np.einsum("bkd,bd->bk", self.x[near], q), np.inf).astype(np.float32)
            ids, far, done = np.concatenate([ids, near], 1), np.concatenate([far, d], 1), np.concatenate([done, ~fresh], 1)
            order = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(axis=1, kind="stable"), 1)
            ids, far, done = (np.take_along_axis(v, order, 1) for v in (ids, far, done))
            done |= ~np.isfinite(far)
        return np.where(np.isfinite(far), ids, -1), np.stack(passed, 1) if trail else ids

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Set each node's edges to the candidates that stay: near ones first, without those a kept one covers."""
        c = np.sort(candidates, axis=1)
        c[(c == nodes[:, None]) | (np.diff(c, axis=1, prepend=-2) == 0)] = -1
        x = self.x[c]
        own = ((x - self.x[nodes][:, None]) ** 2).sum(axis=2)
        own[c < 0] = np.inf
        left = np.isfinite(own)
        kept = np.full((len(nodes), DEGREE), -1)
        rows = np.arange(len(nodes))
        norms = self.norms[c]
        for k in range(DEGREE):
            if not left.any():
                break
            pick = np.where(left, own, np.inf).argmin(axis=1)
            have = left[rows, pick]
            kept[have, k] = c[rows, pick][have]
            p = x[rows, pick]
            between = norms - 2 * np.einsum("bkd,bd->bk", x, p) + norms[rows, pick][:, None]
            left &= (RELAX * RELAX * np.maximum(between, 0) > own) & have[:, None]
            left[rows, pick] = False
        self.edges[nodes] = kept


def build(vectors: np.ndarray, seed: int = 2) -> Graph:
    """The graph of distinct vectors."""
    n = len(vectors)
    size = (vectors * vectors).sum(axis=1)
    x = np.concatenate([vectors, np.sqrt(np.maximum(0, size.max() - size))[:, None]], axis=1).astype(np.float32)
    graph = Graph(x, np.full((n, DEGREE), -1), int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()))
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != graph.start]
    lo = 0
    while lo < len(order):
        new = order[lo : lo + max(1, min(SIDE, lo))]
        beam, passed = graph.seek(x[new], BUILD_BEAM, True)
        graph.prune(new, np.concatenate([beam, passed], axis=1))
        graph_edges = graph.edges[new]
        source, target = np.repeat(new, DEGREE), graph_edges.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for k in range(0, len(nodes), SIDE):
            some, f, m = nodes[k : k + SIDE], first[k : k + SIDE], count[k : k + SIDE]
            more = np.full((len(some), int(m.max())), -1)
            owner = np.repeat(np.arange(len(some)), m)
            more[owner, np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)] = source[np.concatenate([np.arange(a, a + b) for a, b in zip(f, m)])]
            both = np.concatenate([graph.edges[some], more], axis=1)
            full = (both >= 0).sum(axis=1) > DEGREE
            if full.any():
                graph.prune(some[full], both[full])
            room = np.sort(np.where(both[~full] < 0, n, both[~full]), axis=1)[:, :DEGREE]
            padded = np.full((len(room), DEGREE), n)
            padded[:, : room.shape[1]] = room
            graph.edges[some[~full]] = np.where(padded == n, -1, padded)
        lo += len(new)
    return graph


def index_shard(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's vectors, edges, start and ids."""
    vectors = np.array(part["embedding"].tolist(), np.float32)
    graph = build(vectors)
    ids = [list(map(int, x)) for x in part["ids"]]
    return pd.DataFrame({"dim": part["dim"].iloc[:1], "shard": part["shard"].iloc[:1], "vectors": [vectors.tobytes()], "edges": [graph.edges.astype(np.int32).tobytes()], "start": [graph.start], "ids": [ids]})


def search_block(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(index) or not len(queries):
            return none
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
        size = (vectors * vectors).sum(axis=1)
        x = np.concatenate([vectors, np.sqrt(np.maximum(0, size.max() - size))[:, None]], axis=1).astype(np.float32)
        graph = Graph(x, np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE).astype(np.int64), int(row["start"]))
        ids, out = row["ids"], []
        for lo in range(0, len(queries), SIDE):
            some = queries.iloc[lo : lo + SIDE]
            q = np.array(some["embedding"].tolist(), np.float32)
            found, _ = graph.seek(np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1), max(BEAM, 2 * k))
            exact = np.einsum("bkd,bd->bk", vectors[found].astype(np.float64), q.astype(np.float64))
            exact[found < 0] = -np.inf
            for own, nodes, scores in zip(some["query_id"], found, exact):
                top = np.argsort(-scores, kind="stable")
                got = sorted(((-scores[j], int(i)) for j in top[: 2 * k] if nodes[j] >= 0 for i in ids[nodes[j]] if i != own))[:k]
                out += [(own, i, -s) for s, i in got]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none

    return run


def valid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(F.coalesce(sound, F.lit(False)))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest other rows found: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id. Rows whose vector is null, empty or zero or has a null or non-finite component
    take no part, nor do rows with a null id; vectors are compared with those of their length. Fewer candidates
    than k give fewer rows; repeated rows of an id count as one.
    """
    rows = valid(df.where(F.col(key).isNotNull()), vector).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"))
    asked = valid(queries.where(F.col(key).isNotNull()), vector).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("embedding"))
    smallest = rows.withColumn("r", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = materialize(smallest.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))
    nodes = nodes.select("embedding", "ids", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"))
    index = nodes.groupBy("dim", "shard").applyInPandas(index_shard, "dim int, shard int, vectors binary, edges binary, start int, ids array<array<long>>")
    index = materialize(index, "index")
    blocks = max(1, -(-asked.count() // BLOCK))
    visits = asked.select("query_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ("dim", "shard", "block")
    found = index.groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(search_block(k), "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id"])
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
