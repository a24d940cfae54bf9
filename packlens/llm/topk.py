"""Exact top-k inner-product search by ball trees.

Vectors are quantised to integers, so scores are exact. Candidates are hashed into shards of at most
about SHARD_ROWS, queries into blocks, and a task holds one shard and one block. In a task a ball tree over the
shard is searched best first: nodes are taken in the order of their upper bound q.c + |q| r, and the
search of a query ends when the best open node can't beat its kth score. The kth score over a small
pilot set, which any shard's search starts from, is the bound that shards share.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, ship

SHARD_ROWS, BLOCK_ROWS, PILOT_ROWS, LEAF_ROWS = 16_384, 1_024, 2_048, 128


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v (array<bigint>: floor(scale * x) of each component as double).

    Vectors that are null, empty or hold null or non-finite components go.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class BallTree:
    """Nodes as arrays; rows are permuted so that a node is a range. Identical points stay in one leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.nodes = []  # (first, end, centre, radius, smallest id, children)
        stack = [(0, len(ids), None)]
        x = points.astype(np.float64)
        while stack:
            a, b, parent = stack.pop()
            rows = order[a:b]
            centre = x[rows].mean(axis=0)
            far = ((x[rows] - centre) ** 2).sum(axis=1)
            radius = float(np.sqrt(far.max()))
            at = len(self.nodes)
            self.nodes.append([a, b, centre, radius, int(ids[rows].min()), ()])
            if parent is not None:
                self.nodes[parent][5] += (at,)
            if b - a > LEAF_ROWS and radius > 0:
                left = x[rows[far.argmax()]]
                right = x[rows[((x[rows] - left) ** 2).sum(axis=1).argmax()]]
                side = x[rows] @ (right - left)
                cut = (b - a) // 2
                part = np.argpartition(side, cut)
                order[a:b] = rows[part]
                stack += [(a, a + cut, at), (a + cut, b, at)]
        self.ids, self.points = ids[order], points[order].astype(np.float64)  # integer products stay below 2**53

    def search(self, query_id: int, q: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, smaller ids first on ties; scores under ``bound`` may be left out."""
        norm = float(np.sqrt(q @ q))
        best: list[tuple[float, int]] = []  # heap of (score, -id): the worst first

        def upper(node) -> float:
            return float(q @ node[2]) + norm * node[3] * (1 + 1e-12) + 1e-6

        open_ = [(-upper(self.nodes[0]), 0)]
        while open_:
            u, at = heapq.heappop(open_)
            if -u < bound or len(best) == k and -u < best[0][0]:
                break
            a, b, _, _, least, children = self.nodes[at]
            if len(best) == k and np.floor(-u) <= best[0][0] and least > -best[0][1]:
                continue  # it can at most tie, with larger ids
            if children:
                for c in children:
                    heapq.heappush(open_, (-upper(self.nodes[c]), c))
                continue
            scores = self.points[a:b] @ q
            floor = max(bound, best[0][0] if len(best) == k else -np.inf)
            near = np.flatnonzero(scores >= floor)
            if len(near) > k:
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[: k + 1]]
            for i in near:
                if (vec := int(self.ids[a + i])) == query_id:
                    continue
                item = (float(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    ``vectors`` and ``queries``: vec_id and v of ``quantise``. Candidates are the rows of another vec_id; ties go to
    the smaller vec_id; fewer candidates give fewer rows. Repeated rows count once; a query is compared only
    with vectors of its own length. A vec_id with several vectors is asked with each, and one list is kept of all
    their results. Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    base = scratch.write(vectors.distinct())
    asked = scratch.write(queries.distinct())
    n, m = base.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    pilot = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS)
    p = pilot.toPandas()  # PILOT_ROWS rows at most
    pilot_ids, pilot_rows = p["vec_id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in p["v"]]

    def kth(frames):
        by_size = {d: (pilot_ids[[i for i, v in enumerate(pilot_rows) if len(v) == d]], np.array([v for v in pilot_rows if len(v) == d])) for d in {len(v) for v in pilot_rows}}
        for f in frames:
            bounds = []
            for vec, v in zip(f["vec_id"], f["v"]):
                ids, points = by_size.get(len(v), (np.empty(0, np.int64), np.empty((0, len(v)))))
                scores = (points @ np.asarray(v, np.float64))[ids != vec]
                bounds.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else float("-inf"))
            yield f.assign(bound=bounds)

    bounded = asked.mapInPandas(kth, "vec_id long, v array<long>, bound double")
    left = base.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = bounded.select("*", F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(points: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(points) and len(block):
            sizes = points["v"].map(len)
            for d, group in points.groupby(sizes):
                tree = BallTree(group["vec_id"].to_numpy(np.int64), np.array(group["v"].tolist(), np.int64).reshape(len(group), d))
                for vec, v, bound in zip(block["vec_id"], block["v"], block["bound"]):
                    if len(v) == d:
                        rows += [(vec, i, s) for s, i in tree.search(vec, np.asarray(v, np.float64), k, bound)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
