"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import stored
from loadweave.llm.shards import join_counted

#: Edges whose nodes' minima are broadcast, two nodes an edge at most
FEW = 50_000


def _met(rows: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """The rows (node, near) beside the smallest node of each."""
    return rows.join(F.broadcast(low), "node") if few else join_counted(rows, stored(low), "node")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows, itself included."""
    both = edges.select(F.col("big").alias("node"), F.col("small").alias("near")).unionByName(edges.select(F.col("small").alias("node"), F.col("big").alias("near")))
    low = both.groupBy("node").agg(F.count("*").alias("n"), F.least(F.col("node"), F.min("near")).alias("low"))
    up = edges.select(F.col("small").alias("node"), F.col("big").alias("near"))
    return _met(up, low, few).select(F.col("near").alias("big"), F.col("low").alias("small")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of these."""
    down = edges.select(F.col("big").alias("node"), F.col("small").alias("near"))
    low = down.groupBy("node").agg(F.count("*").alias("n"), F.min("near").alias("low"))
    met = _met(down, low, few)
    moved = met.where("near <> low").select(F.col("near").alias("big"), F.col("low").alias("small"))
    return moved.unionByName(met.select(F.col("node").alias("big"), F.col("low").alias("small"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) links, but for those that are their component's smallest node, its name.

    The two operations alternate until the edges are stars. Nodes with very many neighbours do not gather
    them: minima are taken with partial sums, and those of such nodes are broadcast. Edges are stored every round; only
    their number and a checksum come to the driver. Up to `FEW` edges all minima are broadcast, and a few tasks do a round's work.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("big").alias("node"), F.col("small").alias("component"))
        seen, few = mark, mark[0] <= FEW
        large = stored(_large_star(edges, few).coalesce(8)) if few else stored(_large_star(edges, few))
        edges = stored(_small_star(large, few).coalesce(8)) if few else stored(_small_star(large, few))
