"""Connected components of an edge list, labelled by their smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.staging import staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges: each node with its smallest known relative."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        top = np.array([root(x) for x in part], np.int64)
        own = np.array(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own[own != top]), pa.array(top[own != top])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; ``edges`` has two long columns u and v.

    A union-find in each partition first leaves at most one edge a node and partition. Then each round
    links every node's neighbours to the smallest of them, first the larger neighbours, then the smaller
    ones, until all nodes hang on their smallest relative. A node's neighbours meet only as a minimum
    and in a join, never in a list.
    """
    edges = staged(edges.select("u", "v").mapInArrow(_forest, "u long, v long").distinct(), "links")
    while True:
        most = 2 * edges.count()  # a round makes at most one edge more for each it has
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = staged(after, "links", most)
        # done when every node has one edge and no node that is pointed at points further
        tops = after.select(F.col("v").alias("node")).distinct()
        further = after.join(tops, after.u == tops.node, "left_semi").limit(1).count()
        edges = after
        if not further:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
