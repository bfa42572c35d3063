"""Connected components of a large edge table by contraction."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.session import cut_lineage

FEW_LINKS = 1_000_000        # links that one task may hold: 16 MB


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the links (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, a, b = np.arange(len(nodes)), ends[:len(a)], ends[len(a):]
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (far := low[low]).tobytes() != low.tobytes():
            low = far
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[low]


def joined_links(edges: DataFrame) -> DataFrame:
    """(node, component) as `components` gives it, for links that are mostly few: up to FEW_LINKS, counted before, are joined by one
    task, more by contraction."""
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() > FEW_LINKS:
        return components(edges)

    def run(batches):
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            node, component = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])
    return cut_lineage(edges.coalesce(1).mapInArrow(run, "node bigint, component bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round points every node to its smallest neighbour or itself, follows pointers to their ends by doubling, and
    replaces the ends of every edge by where they point; edges inside one node go. Only nodes smallest around them are left.
    Every step is cut by a reliable checkpoint; only whether rows are left comes to the driver. Hubs are no hazard: smallest
    neighbours are pre-aggregated, and the joins look up one row per key, so that a large side can be split at run time."""
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        point = both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
        moving = True
        while moving:                                                          # as often as the depth of the pointers has bits
            point = point.select("node", "to")
            point = cut_lineage(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
                                .select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            moving = point.where("moved").limit(1).count() > 0
        point = point.select("node", "to")
        if found is None:
            found = point.withColumnRenamed("to", "component")
        else:
            found = cut_lineage(found.join(point.select(F.col("node").alias("component"), "to"), "component", "left")
                                .select("node", F.coalesce("to", "component").alias("component")))
        a, b = (point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where("a_to <> b_to")
                            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
