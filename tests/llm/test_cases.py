"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontaminate, html_blocks, jaccard_join, langid, line_dedup, neighbours, quality, sharding, substring_dedup

LINE = "one two three four five six seven eight nine ten"
ODD = [(None, LINE), (1, None), (2, ""), (3, LINE), (3, LINE), (4, LINE + "\n" + LINE), (5, "w " * 30000), (6, " \n\t"), (None, None)]
KIND = "doc_id long, text string, row int, dropped string, id int, `od.d` string, lead int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "d", 8, "o", 9) for r in ODD], KIND).repartition(3)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def makers(spark, vocabulary):
    items = spark.createDataFrame([(None, LINE), ("a", LINE), ("b", None)], "item_id string, text string")
    empty = quality.fit([], __import__("numpy").zeros(0, int), quality.GRADES)
    return {
        "html": (lambda df: html_blocks.extract(df.withColumnRenamed("text", "html"), html_blocks.Net.fresh(1)), "n_blocks"),
        "quality": (lambda df: quality.score(df, empty), "expected_grade"),
        "line_dedup": (line_dedup.dedup_lines, "n_lines"),
        "decontaminate": (lambda df: decontaminate.decontaminate(df, items), "n_hit"),
        "bpe": (lambda df: bpe.encode(df, vocabulary), "ids"),
        "langid": (lambda df: langid.predict(df, langid.fit([], [])), "score"),
        "substring_dedup": (substring_dedup.dedup_substrings, "removed"),
        "sharding": (lambda df: sharding.shard(df, 4), None),
        "jaccard_join": (jaccard_join.link_components, None),
    }


@pytest.mark.parametrize("name", ["html", "quality", "line_dedup", "decontaminate", "bpe", "langid", "substring_dedup", "sharding", "jaccard_join"])
def test_odd_rows_and_columns(spark, odd, vocabulary, name):
    make, added = makers(spark, vocabulary)[name]
    out = make(odd)
    assert out.count() == len(ODD)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name not in ("sharding", "jaccard_join"):
        assert set(odd.columns) - {"text"} <= set(out.columns)
        assert {tuple(r) for r in out.select("row", "dropped", "id", F.col("`od.d`"), "lead").collect()} == {(7, "d", 8, "o", 9)}
    assert make(odd.limit(0)).count() == 0
    if added:
        with pytest.raises(ValueError, match=added):
            make(odd.withColumn(added, F.lit(1)))


def test_lines(odd):
    out = line_dedup.dedup_lines(odd).select("doc_id", "text", "n_lines", "n_dropped").collect()
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] if r["doc_id"] != 5 else "") for r in out}
    # the null id comes first; both rows of document 3 are one document
    assert got == {(None, 1, 0, LINE), (None, 0, 0, None), (1, 0, 0, None), (2, 1, 0, ""), (3, 1, 1, ""), (4, 2, 2, ""), (5, 1, 0, ""), (6, 2, 0, " \n\t")}


def test_lines_of_one_document_and_near_ones(spark):
    near = LINE.replace("four", "for")
    df = spark.createDataFrame([(1, f"{near}\n{LINE}\nshort\nshort line"), (2, "short\n" + LINE + " eleven"), (3, LINE.replace("two", "2").replace("nine", "9"))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: f"{near}\nshort\nshort line", 2: LINE + " eleven", 3: LINE.replace("two", "2").replace("nine", "9")} or got[2] == ""
    assert got[1] == f"{near}\nshort\nshort line"


def test_items_without_an_id_hit(odd, spark):
    items = spark.createDataFrame([(None, LINE), ("a", "nothing of the kind")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["hit_items"]) for r in decontaminate.decontaminate(odd.filter("text IS NOT NULL"), items).collect()}
    assert got[3] == (10, []) and got[4] == (20, []) and got[5] == (0, [])


def test_equal_vectors_and_odd_ones(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(50, [0.0, 0.0]), (51, None), (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, []), (60, [1.0, 3.0]), (60, [5.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = neighbours.search(df, F.col("vec_id").isin(0, 29, 50, 60), k=3).collect()
    of = lambda q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and of(29) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert of(50) == []
