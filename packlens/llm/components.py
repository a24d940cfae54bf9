"""Connected components of an edge table, without a collected edge or an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; long): root is the component's smallest node.

    Large-star and small-star steps in turn: every node passes its smallest neighbour on to its other
    neighbours, until no edge changes and all nodes hang from their roots. Each step is an aggregate
    with map-side combine and an equi-join, which AQE splits at hot nodes; a step's edges are written.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(_proper(edges))
    mark = _mark(now)
    while mark[0]:
        large = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = scratch.write(_star(large, larger=False))
        scratch.drop(now)
        now, (mark, last) = small, (_mark(small), mark)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def _proper(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if larger:
        joined = joined.where("v > u")
        return _proper(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _proper(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
