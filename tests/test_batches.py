"""Circles and closures against plain graph walks, on long chains and in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.plans import cover


def circles(nodes, edges):
    """The least member of each node's circle."""
    onward = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in onward[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}, reach


def frames(spark, plans):
    tile = lambda c, n: (c, *map(int, n.split("/")), "after", 0, 0, 0)
    members = spark.createDataFrame([tile(c, n) for c, (nodes, _) in plans.items() for n in nodes], "cut_id long, group_z int, group_x long, group_y long, side string, z int, x long, y long")
    edges = spark.createDataFrame([(c, a, b) for c, (_, edges) in plans.items() for a, b in edges], "cut_id long, a string, b string")
    return members, edges


def test_batches_and_closures_of_random_graphs(spark):
    plans = {}
    for c in range(8):
        r = random.Random(c)
        nodes = [f"{i % 5}/{i}/0" for i in range(r.choice([2, 12, 25]))]
        plans[c] = nodes, {(a, b) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(int(len(nodes) * r.choice([0.7, 1.2, 2.5])))) if a != b}
    members, edges = frames(spark, plans)
    got = {(x["cut_id"], x["node"]): x["batch"] for x in cover.atomic_batches(members, edges).collect()}
    want = {(c, n): b for c, (nodes, e) in plans.items() for n, b in circles(nodes, e)[0].items()}
    assert got == want
    seeds = [(c, nodes[0]) for c, (nodes, _) in plans.items() if c % 2]
    closed = cover.dependency_closure(spark.createDataFrame(seeds, "cut_id long, batch string"), edges.select("cut_id", F.col("a").alias("batch"), F.col("b").alias("depends_on")))
    assert {tuple(x) for x in closed.collect()} == {(c, m) for c, n in seeds for m in {n} | circles(*plans[c])[1][n]}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, written = [], cover.checkpoint
    monkeypatch.setattr(cover, "checkpoint", lambda df: rounds.append(1) or written(df))
    names = [f"1/{i}/{(i * 7919) % 2003}" for i in range(2000)]
    chain = list(zip(names, names[1:]))
    members, edges = frames(spark, {1: (names, chain)})
    assert cover.atomic_batches(members, edges).filter("batch <> node").count() == 0
    assert len(rounds) < 30
    rounds.clear()
    closed = cover.dependency_closure(spark.createDataFrame([(1, names[0])], "cut_id long, batch string"), edges.select("cut_id", F.col("a").alias("batch"), F.col("b").alias("depends_on")))
    assert closed.count() == 2000 and len(rounds) < 45


def test_tables_of_walks_stay_small(spark):
    names = [f"0/{i}/0" for i in range(60)]
    dense = [(a, b) for i, a in enumerate(names) for b in names[i + 1 : i + 6]] + [(names[40], names[20])]
    members, edges = frames(spark, {1: (names, dense)})
    walks = cover._walks(edges, "cut_id")
    assert all(w.count() <= cover.WALK_ROWS * len(dense) for w in walks[:-1])
    got = {x["node"]: x["batch"] for x in cover.atomic_batches(members, edges).collect()}
    assert got == circles(names, dense)[0] and len(set(got.values())) == 40


@pytest.mark.parametrize("most", [1 << 16, 20, 0])
def test_small_plans_take_no_rounds_and_large_ones_agree(spark, monkeypatch, most):
    monkeypatch.setattr(cover, "PLAN_EDGES", most)
    rounds, written = [], cover.checkpoint
    monkeypatch.setattr(cover, "checkpoint", lambda df: rounds.append(1) or written(df))
    plans = {}
    for c in range(6):
        r = random.Random(c)
        nodes = [f"{i % 3}/{i}/0" for i in range(14)]
        plans[c] = nodes, {(a, b) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(6 + 5 * c)) if a != b}
    members, edges = frames(spark, plans)
    got = {(x["cut_id"], x["node"]): x["batch"] for x in cover.atomic_batches(members, edges).collect()}
    assert got == {(c, n): b for c, (nodes, e) in plans.items() for n, b in circles(nodes, e)[0].items()}
    seeds = [(c, nodes[0]) for c, (nodes, _) in plans.items()] + [(99, "0/0/0")]
    closed = cover.dependency_closure(spark.createDataFrame(seeds, "cut_id long, batch string"), edges.select("cut_id", F.col("a").alias("batch"), F.col("b").alias("depends_on"))).collect()
    assert sorted(map(tuple, closed)) == sorted({(c, m) for c, n in seeds for m in {n} | (circles(*plans[c])[1][n] if c in plans else set())})
    assert len(rounds) <= 3 or most < 1 << 16


def test_a_summary_counts_what_only_some_tables_have(spark):
    cut = lambda rows: spark.createDataFrame(rows, "cut_id long, z int, x long, y long")
    old, new = cut([(1, 0, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0), (2, 1, 1, 0)]), cut([(2, 1, 1, 0), (2, 1, 1, 1), (3, 0, 0, 0)])
    members, _ = frames(spark, {2: (["1/0/0", "1/1/1"], [])})
    batches = spark.createDataFrame([(2, "1/0/0", "1/0/0"), (2, "1/1/1", "1/0/0")], "cut_id long, node string, batch string")
    needs = cut([(2, 1, 0, 0), (2, 1, 1, 1), (3, 0, 0, 0)]).withColumn("state", F.when(F.col("y") == 1, "in-flight").otherwise("ready"))
    out = cover.change_summary(old, new, members, batches, needs)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, False), (2, 2, 2, 1, 2, 1, 0, 1, 1, 0, 1, False), (3, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, False)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
