"""Pages of very many open or unmatched tags, and lines of very many words, in time that grows with their length."""

import time

import pytest
from pyspark.sql import functions as F

from tilewright.llm import html_blocks, line_dedup


@pytest.mark.parametrize("piece", ["<div>x", "<head>", "</p>x", "<div class=a>y</section>", "<p>z"])
def test_pages_of_a_megabyte(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    blocks = html_blocks.blocks_of(page)
    html_blocks.features([blocks])
    assert time.time() - began < 8
    assert len(blocks) == {"<head>": 0, "</p>x": len(page) // 5}.get(piece, len(page) // len(piece))


def test_paths_are_those_of_the_open_elements():
    blocks = html_blocks.blocks_of("<body><div class='a b'><p>one<p>two</div></i></section>three<div id=c>four")
    assert [(list(b.path), b.text) for b in blocks] == [
        (["body", "div", ".a", ".b", "p"], "one"), (["body", "div", ".a", ".b", "p"], "two"), (["body"], "three"), (["body", "div", ".c"], "four"),
    ]
    assert [html_blocks.path_kinds(b.path) for b in blocks] == [html_blocks.path_kinds(tuple(b.path)) for b in blocks]


def test_lines_of_a_hundred_thousand_words(spark):
    words = [f"w{i}" for i in range(100_000)]
    near = words[:70_000] + ["other"] + words[70_001:]
    texts = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    line_dedup.dedup_lines(docs.filter("doc_id = 3")).collect()
    began = time.time()
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}
    assert time.time() - began < 60


@pytest.mark.parametrize("n", [1, 8, 255, 256, 257, 513, 1000])
def test_variant_keys_in_runs(spark, n):
    words = [f"w{i % 7}" for i in range(n)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    keys = df.select(line_dedup.variant_keys(F.col("words")).alias("k")).first()["k"]
    plain = spark.createDataFrame([(i, words[:i] + words[i + 1 :]) for i in range(n)], "i int, words array<string>")
    zero = F.lit(0).cast("long")
    own = plain.select("i", F.aggregate(F.transform("words", lambda w, j: F.xxhash64(w, j)), zero, lambda a, x: a.bitwiseXOR(x)).alias("k"))
    assert len(keys) == n + 1 and [r["k"] for r in own.orderBy("i").collect()] == keys[1:]
