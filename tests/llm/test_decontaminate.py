"""Decontamination where very many documents and items share a short passage."""

import time

from tilewright.llm import decontaminate


def test_a_common_gram_makes_no_pairs(spark):
    common = "what is the capital of"
    said = lambda kind, i: f"{kind}{i} {kind}{i + 1} {common} {kind}{i + 2} {kind}{i + 3} {kind}{i + 4} {kind}{i + 5}"
    docs = spark.createDataFrame([(i, said("d", 10 * i)) for i in range(2000)], "key long, text string")
    items = spark.createDataFrame([(str(i), said("q", 10 * i)) for i in range(2000)] + [("short", "what is the"), ("odd", common + " z")], "item string, text string")
    long = items.filter("item NOT IN ('short', 'odd')")
    assert decontaminate.matches(docs, long, [10]).count() == 0
    began = time.time()
    out = decontaminate.decontaminate(docs.withColumnRenamed("key", "doc_id"), items, item_col="item").collect()
    assert {(r["n_words"], r["n_hit"], tuple(r["hit_items"])) for r in out} == {(11, 3, ("short",))} and len(out) == 2000
    assert time.time() - began < 60


def test_a_window_of_all_items_is_met_once(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} {shared} b{i}") for i in range(300)], "key long, text string")
    items = spark.createDataFrame([(str(i), f"q{i} {shared}") for i in range(300)], "item string, text string")
    assert decontaminate.matches(docs, items, [10]).count() == 300 * 3
    out = decontaminate.decontaminate(docs.withColumnRenamed("key", "doc_id"), items, item_col="item").collect()
    assert {(r["n_hit"], len(r["hit_items"]), tuple(map(tuple, r["hit_runs"]))) for r in out} == {(12, 300, ((1, 13),))}


def test_rows_without_an_id_are_judged_by_their_texts(spark):
    item = " ".join(f"s{i}" for i in range(11))
    docs = spark.createDataFrame([(None, item), (None, "nothing of it"), (None, item), (None, None), (5, item.upper()), (5, "x " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted((r["n_words"], r["n_hit"], tuple(r["hit_items"])) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(0, 0, ()), (3, 0, ()), (11, 11, ("7", "8")), (11, 11, ("7", "8")), (11, 11, ("7", "8")), (12, 11, ("7", "8"))]
