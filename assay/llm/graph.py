"""Connected components of a link table: contracted inside tasks, then by alternating stars written out between rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.storage import discard, written

# Links that are contracted together: bounds what a task holds.
TOGETHER = 1 << 18


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, with that least node; by minima along links and short cuts."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        # The least known on either side goes to the roots of both, then every node looks past its root.
        low = np.minimum(least[u], least[v])
        for side in (u, v):
            np.minimum.at(least, least[side], low)
            np.minimum.at(least, side, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            moved = np.flatnonzero(least != np.arange(len(nodes)))
            return nodes[moved], nodes[least[moved]]


def _contracted(batches):
    waiting, size = [], 0

    def stars():
        u, v = stars_of(*(np.concatenate(c) for c in zip(*waiting)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        waiting.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
        size += batch.num_rows
        if size >= TOGETHER:
            yield stars()
            waiting, size = [], 0
    if size:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links reach.

    Links are first dealt out in lots of ``TOGETHER`` at most and each lot is contracted to stars, in its task; a table of one
    lot is done then. Large stars and small stars alternate until all links point at their smallest node, after about
    log(n) rounds. A hub of any degree is safe: minima merge from partial aggregates, and the join that hands them out reads
    written tables on both sides, so a hot hub is split among tasks.
    """
    # Every link points from its larger to its smaller end.
    found = written(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "links")
    lots = -(-found.count() // TOGETHER)
    edges = written(found.repartition(max(1, lots)).mapInArrow(_contracted, "u long, v long"), "links")
    discard(found)
    while lots > 1 and not _are_stars(edges):
        # Large star: the larger neighbours of each node move to its smallest neighbour.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "links")
        # Small star: the smaller neighbours of each node, and the node, move to the smallest of them.
        small_least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        moved = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(moved.union(small_least).toDF("u", "v").distinct(), "links")
        discard(edges, least, large, small_least)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points at one node at most, and none that is pointed at points itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return nodes.where("out > 1 OR out = 1 AND root = 1").count() == 0
