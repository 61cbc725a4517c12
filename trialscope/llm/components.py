"""Connected components of an edge table: alternating large and small stars, or one task where a count proves the table
small. No edge reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import frugal, written


#: Edges (16 bytes each) that one task may join; beyond them the stars do, in a few shuffles a turn.
FEW_EDGES = 500_000


@frugal
def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels along edges, then to the labels' own labels, until nothing changes."""
    got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    ends = np.stack([np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])])
    nodes, index = np.unique(ends, return_inverse=True)
    u, v = index.reshape(ends.shape)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour above a node to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lower neighbours to the least of them. Edges run from the higher u to the lower v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the least node reachable."""
    edges = edges.filter("a <> b")
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(_join_all, "node long, component long")
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = written(_small_star(_large_star(now)), "edges")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
