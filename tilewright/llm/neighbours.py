"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph starts from the leaves of a few random projection trees, fitted on a bounded sample (``sample`` rows); all rows are indexed. Each round
of NN-descent then sends every node's vector, as 32-bit floats, to the nodes it neighbours, either way, and each of those introduces what it
holds to each other, where one of the two edges is new: neighbours of neighbours. Only edges better than a node's worst are sent on. Rounds go on
until less than ``settled`` of the edges change. Queries then search the graph greedily: the ``beam`` best nodes seen are expanded, a
step in all queries at once, until none of them is new. Distances in the result come from the original vectors.

Equal vectors are one node, which keeps the ``k`` + 1 smallest ids of its rows; so a vector that very many rows share is one node of the graph,
and its rows are found in order of their ids. A node that very many others hold among their nearest is a host in several parts, each
with its own neighbours and a share of those others, so no group grows with the table.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as rows or as queries; vectors of another length
than most are an error of the caller; rows at equal distance come in order of their ids; repeated ids are rows of their own, but none is a
neighbour of a query with its id; with fewer than k candidates all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.jobs import bounded_sample, checkpoint

LEAF = 160


class Trees:
    """Random projection trees: at each inner node a direction and the median of the sample along it."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        random = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth = depth
        self.direction = random.normal(size=(trees, inner, sample.shape[1])).astype(np.float32) if len(sample) else np.zeros((trees, inner, 0), np.float32)
        self.cut = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            groups = [np.arange(len(sample))]
            for node in range(inner):
                own = groups[node]
                if len(own) >= 2:  # the direction between two members parts clusters
                    a, b = random.choice(own, 2, replace=False)
                    step = sample[a] - sample[b]
                    self.direction[t, node] = step if np.abs(step).sum() > 0 else self.direction[t, node]
                along = sample[own] @ self.direction[t, node] if len(own) else np.zeros(0)
                self.cut[t, node] = np.median(along) if len(own) else 0
                groups += [own[along < self.cut[t, node]], own[along >= self.cut[t, node]]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.cut)), np.int64)
        for t in range(len(self.cut)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", vectors, self.direction[t, node]) >= self.cut[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out


def _codes(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, a row each."""
    if not len(column):
        return np.zeros((0, 1))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, (int(offsets[-1]) - int(offsets[0])) // 4, int(offsets[0])).reshape(len(column), -1).astype(np.float64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        if held and [held[-1].column(k)[-1].as_py() for k in keys] != marks[:, 0].tolist():
            yield _joined(held)
            held = []
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if at and held:
                yield _joined(held)
                held = []
            held.append(batch.slice(at, to - at))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(edges: DataFrame, of: str, other: str, k: int) -> DataFrame:
    """The k nearest edges of each node, with their rank; what is far is cut before it is moved, so no node's edges are ever all in one place."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy("gap", other))).filter(F.col("rank") <= k)


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """(a, b, gap, fresh, rank): the nearest edges of each node, each neighbour once; fresh if none of its rows was known."""
    return _nearest(edges.groupBy("a", "b").agg(F.min("gap").alias("gap"), F.bool_and("fresh").alias("fresh")), "a", "b", degree)


def build_graph(nodes: DataFrame, degree: int, settled: float, trees: int, sample: int, seed: int = 11) -> DataFrame:
    """(a long, b long, gap double, fresh boolean, rank int) of nodes (node long, code binary)."""
    there = nodes.count()
    chosen = bounded_sample(nodes.select("node", "code"), "node", sample).orderBy("node").collect()
    fitted = _codes(pa.array([bytes(r["code"]) for r in chosen], pa.binary()))
    depth = min(max(0, math.ceil(math.log2(max(1, there) / LEAF))), max(0, int(math.log2(max(1, len(fitted)) / 8))))
    forest = Trees(fitted, trees, depth, seed)

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = forest.leaves(_codes(batch.column("code")))
                for t in range(at.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, t] * at.shape[1] + t), batch.column("node"), batch.column("code")], ["leaf", "node", "code"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["leaf"]):
            ids, x = g.column("node").to_numpy(), _codes(g.column("code"))
            along = np.argsort(x @ np.random.default_rng(seed).normal(size=x.shape[1]), kind="stable")
            for at in range(0, len(ids), 4 * LEAF):  # a leaf of any size is worked on in blocks
                block = along[at : at + 4 * LEAF]
                gap = _squares(x[block], x[block])
                np.fill_diagonal(gap, np.inf)
                near = np.argpartition(gap, min(degree, len(block) - 1), 1)[:, :degree] if len(block) > 1 else np.zeros((1, 0), int)
                a, b = np.repeat(np.arange(len(block)), near.shape[1]), near.ravel()
                good = np.isfinite(gap[a, b])
                yield pa.RecordBatch.from_arrays([pa.array(ids[block[a[good]]]), pa.array(ids[block[b[good]]]), pa.array(gap[a[good], b[good]])], ["a", "b", "gap"])

    leaves = nodes.select("node", "code").mapInArrow(fall, "leaf long, node long, code binary").repartition("leaf").sortWithinPartitions("leaf")
    graph = checkpoint(_best(leaves.mapInArrow(inside, "a long, b long, gap double").withColumn("fresh", F.lit(True)), degree))

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["host", "part"]):
            ids, once = np.unique(g.column("node").to_numpy(), return_index=True)
            worst, fresh = g.column("worst").to_numpy()[once], g.column("fresh").to_numpy(zero_copy_only=False)[once]
            x = _codes(g.column("code"))[once]
            gap = _squares(x, x)
            np.fill_diagonal(gap, np.inf)
            a, b = np.nonzero((gap < worst[:, None]) & (fresh[:, None] | fresh[None, :]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(gap[a, b])], ["a", "b", "gap"])

    while True:
        state = graph.agg(F.count_if("fresh").alias("fresh"), F.count(F.lit(1)).alias("edges")).first()
        if state["fresh"] <= settled * state["edges"]:
            return graph
        # who holds a node, in parts of at most `degree` holders; a node's own neighbours are in all of its parts
        parts = graph.groupBy(F.col("b").alias("host")).agg(F.ceil(F.count(F.lit(1)) / degree).alias("parts"))
        ahead = graph.select(F.col("a").alias("host"), F.col("b").alias("node"), "fresh").join(parts, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        back = graph.select(F.col("b").alias("host"), F.col("a").alias("node"), "fresh").join(parts, "host").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        held = ahead.select("host", "part", "node", "fresh").unionByName(back.select("host", "part", "node", "fresh")).groupBy("host", "part", "node").agg(F.bool_or("fresh").alias("fresh"))
        held = held.join(held.filter("fresh").select("host", "part").distinct(), ["host", "part"], "left_semi")
        worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count(F.lit(1)) < degree, F.lit(float("inf"))).otherwise(F.max("gap")).alias("worst"))
        carried = nodes.select("node", "code").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        met = held.join(carried, "node").repartition("host", "part").sortWithinPartitions("host", "part")
        better = met.mapInArrow(introduce, "a long, b long, gap double").withColumn("fresh", F.lit(True))
        graph = checkpoint(_best(graph.select("a", "b", "gap", F.lit(False).alias("fresh")).unionByName(better), degree))


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = 30, settled: float = 0.1, trees: int = 4, beam: int = 160, sample: int = 20_000) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row that is_query holds for, the k nearest other rows found, by Euclidean distance."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    good = rows.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    most = float(np.finfo(np.float32).max)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.clip(np.array(v, np.float64), -most, most).astype(np.float32).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("ids"), batch.column("vector"), pa.array(data, pa.binary())], ["node", "ids", "vector", "code"])

    # of rows with equal vectors the k + 1 smallest ids are enough: that many come before any other of them
    numbered = good.select("id", "vector", F.xxhash64("vector").alias("hash"))
    least = numbered.groupBy("hash", "vector").agg(F.min("id").alias("node"))
    copies = checkpoint(_smallest(numbered.select("hash", "id", F.col("vector")), k + 1))
    nodes = least.join(copies, ["hash", "vector"]).select("node", "ids", "vector")
    nodes = checkpoint(nodes.mapInArrow(pack, "node long, ids array<long>, vector array<double>, code binary"))
    graph = build_graph(nodes.select("node", "code"), degree, settled, trees, sample)

    queries = good.filter("query").select(F.col("id").alias("q"), F.xxhash64("vector").alias("hash"), "vector")
    homes = checkpoint(queries.join(least.select("hash", "vector", "node"), ["hash", "vector"]).select("q", "node"))
    coded = nodes.select(F.col("node").alias("b"), F.col("code"))
    back = _nearest(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"), "a", "b", 2 * degree)
    ways = checkpoint(graph.select("a", "b").unionByName(back.select("a", "b")).distinct())
    start = homes.select(F.col("node").alias("home")).distinct()
    target = checkpoint(start.join(coded.withColumnsRenamed({"b": "home", "code": "goal"}), "home"))
    seen = checkpoint(start.select("home", F.col("home").alias("b"), F.lit(0.0).alias("gap"), F.lit(False).alias("done")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = ((_codes(batch.column("goal")) - _codes(batch.column("code"))) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("b"), pa.array(gap)], ["home", "b", "gap"])

    while not seen.filter("NOT done").isEmpty():
        reached = seen.filter("NOT done").select("home", F.col("b").alias("a")).join(ways, "a").select("home", "b").distinct().join(seen.select("home", "b"), ["home", "b"], "left_anti")
        gaps = reached.join(coded, "b").join(target, "home").mapInArrow(measure, "home long, b long, gap double").withColumn("done", F.lit(False))
        seen = checkpoint(_nearest(seen.withColumn("done", F.lit(True)).unionByName(gaps), "home", "b", beam).drop("rank"))

    # exact distances on the original vectors
    found = homes.join(seen.select(F.col("home").alias("node"), "b"), "node").select("q", "node", "b")
    exact = nodes.select(F.col("node").alias("b"), "ids", F.col("vector").alias("v"))
    of_query = nodes.select("node", F.col("vector").alias("w"))
    score = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    listed = found.join(exact, "b").join(of_query, "node").select("q", score.alias("score"), F.explode("ids").alias("id")).filter("id <> q")
    top = listed.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k).alias("top"))
    return top.select(F.col("q").alias("query_id"), F.posexplode("top").alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """(hash, vector, ids): the k smallest ids of each vector, gathered over salted parts so that no part or group holds more than it keeps."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("hash", "vector", "salt").orderBy("id"))
    part = salted.withColumn("rank", rank).filter(F.col("rank") <= k)
    return part.groupBy("hash", "vector").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))

