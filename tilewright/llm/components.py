"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import checkpoint, giving_back

#: Edges that a task joins at a time, and up to which one task settles them all.
EDGES = 1 << 16


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes of some edges in order, the least that each can reach by them)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            return nodes, nodes[root]
        x, y = low[open_], high[open_]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same nodes: in each run of ``EDGES`` of them every node is joined to the least that it reaches, and no node twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def settled() -> pa.RecordBatch:
            node, root = least_reached(*[np.concatenate(c) for c in zip(*held, strict=True)])
            other = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], ["a", "b"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            count += batch.num_rows
            if count >= EDGES:
                yield settled()
                held, count = [], 0
        if count:
            yield settled()

    return edges.select("a", "b").mapInArrow(giving_back(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) can reach.

    Tasks join what they have themselves. If no more than ``EDGES`` edges are left, one task settles them; else
    alternates large-star and small-star steps: every node links its larger neighbours, then its smaller ones, to the least it knows, until all
    edges point at a root. The edges stay as many as they were at most, in about log(n) rounds, each written to the shared folder.
    """
    now = checkpoint(contracted(edges.filter("a <> b")))
    if now.count() <= EDGES:
        now = checkpoint(contracted(now.coalesce(1)))
    else:
        now = checkpoint(now.distinct())
        before = None
        while True:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            now = checkpoint(small.filter("a <> b").distinct())
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
