"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws ln(u) / weight with u in
(0, 1) hashed from the key and the child's identity, and the largest draw wins, so a child gets
keys in proportion to its weight. A draw depends on nothing but key, child and that child's own
weight: when weights change, keys move only into or out of the subtrees whose weights changed.
A shard added by ``grow`` stands alone in a region of its own, so that all keys that move go to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import gapless_rank


@dataclass(frozen=True)
class HashTree:
    """regions[i][j] holds the (shard, weight) pairs of rack j of region i."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    _by: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def even(shards: int, racks: int = 2, per_rack: int = 5) -> HashTree:
        """Shards 0 .. shards-1 of weight 1, filled rack by rack and region by region."""
        if shards < 1:
            raise ValueError("a tree has at least one shard")
        ids = [(s, 1.0) for s in range(shards)]
        full = [tuple(ids[i : i + per_rack]) for i in range(0, shards, per_rack)]
        return HashTree(tuple(tuple(full[i : i + racks]) for i in range(0, len(full), racks)))

    @property
    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def grow(self, weight: float = 1.0) -> HashTree:
        return HashTree((*self.regions, (((max(self.shards) + 1, weight),),)))

    def reweigh(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def place(self, key: Column) -> Column:
        """The shard of a key (null keys are one key), as int."""
        regions = [(F.lit(i), sum(w for rack in r for _, w in rack)) for i, r in enumerate(self.regions)]
        region = _draw(key, "region", regions)
        by_region = None
        for i, r in enumerate(self.regions):
            racks = [(F.lit(i * 1_000_003 + j), sum(w for _, w in rack)) for j, rack in enumerate(r)]
            rack = _draw(key, "rack", racks) if len(r) > 1 else racks[0][0]
            by_rack = None
            for j, leaves in enumerate(r):
                leaf = _draw(key, "shard", [(F.lit(s), w) for s, w in leaves]) if len(leaves) > 1 else F.lit(leaves[0][0])
                hit = rack == F.lit(i * 1_000_003 + j)
                by_rack = F.when(hit, leaf) if by_rack is None else by_rack.when(hit, leaf)
            by_rack = by_rack if len(r) > 1 else leaf
            by_region = F.when(region == F.lit(i), by_rack) if by_region is None else by_region.when(region == F.lit(i), by_rack)
        return by_region.cast("int")


def _draw(key: Column, level: str, children: list[tuple[Column, float]]) -> Column:
    """The child with the largest ln(u) / weight; a child of weight 0 never wins."""
    draws = []
    for child, weight in children:
        if weight <= 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((F.log(u) / F.lit(float(weight))).alias("draw"), child.alias("child")))
    if not draws:
        raise ValueError("all weights of a node are 0")
    return F.array_max(F.array(*draws))["child"] if len(draws) > 1 else draws[0]["child"]


def shard_documents(docs: DataFrame, tree: HashTree, n_rows: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the tree alone decide. size is the text's UTF-8 bytes plus 16; a
    null text has no bytes and crc32 0. Null doc_ids are one key. Repeated rows each get a slot
    of their own, in the same shard. An empty table gives an empty result; columns of ``docs`` other
    than doc_id and text aren't read. slot counts from 0 without gaps within a shard.
    """
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.place(key).alias("shard"),
        tree.grow().place(key).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], ["doc_id"], "slot", n_rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
