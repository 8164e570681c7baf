"""The pipeline's stages on a small table, each against what it is for."""

import random

import pytest

import corpus_pipeline as pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [f"n{k}" for k in range(300)]


def prose(r, n):
    return " ".join(r.choice(NAMES) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(2)
    home = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(400):
        text = prose(r, 40)
        if i % 4 == 0:
            text = " ".join(w + " |" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    item = prose(r, 14)
    long = prose(r, 50)
    near = long.split()
    near[25] = "other"
    extra = ["first line of words that many pages have in common here\n" + prose(r, 20), prose(r, 20) + "\nfirst line of words that many pages have in common here", long, long, " ".join(near), prose(r, 10) + " " + item + " " + prose(r, 10), None, ""]
    rows += [(1000 + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(extra)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home), {r[0]: r for r in rows}


def run(spark, made, stage, docs=None):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet") if docs is None else docs
    out = stage(spark, docs, made[0])
    assert out.columns == pipeline.COLUMNS
    return {r["doc_id"]: r for r in out.collect()}


def test_quality(spark, made):
    kept = run(spark, made, pipeline.quality_stage)
    assert sum(i in kept for i in range(400) if i % 4) >= 290 and sum(i in kept for i in range(400) if i % 4 == 0) <= 10
    assert all(tuple(r) == made[1][i] for i, r in kept.items())


def test_lines(spark, made):
    kept = run(spark, made, pipeline.line_dedup_stage)
    assert kept[1000]["text"] == made[1][1000][1]
    assert kept[1001]["text"] == made[1][1001][1].split("\n")[0] and kept[1001]["n_chars"] == len(kept[1001]["text"])
    assert 1002 in kept and 1003 not in kept  # all of its words were said before
    assert kept[1006]["text"] is None and kept[1007]["text"] == "" and set(range(400)) <= set(kept)


def test_near_duplicates(spark, made):
    kept = run(spark, made, pipeline.near_duplicate_stage)
    assert 1002 in kept and not {1003, 1004} & set(kept)  # 45 of 51 shingles of 3 words, 41 of 51 of 5: linked at 0.8 only by the latter, at 0.9 by neither
    assert len(kept) == len(made[1]) - 2
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    assert len(run(spark, made, pipeline.near_duplicate_stage, docs.unionByName(docs))) == len(kept)


def test_decontamination(spark, made):
    kept = run(spark, made, pipeline.decontamination_stage)
    assert set(made[1]) - set(kept) == {1005}


def test_tokens_and_all_together(spark, made):
    out = pipeline.run(spark, made[0])
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert not {r["doc_id"] for r in rows} & {1003, 1004, 1005} and len(rows) >= 290
    none = spark.read.parquet(f"{made[0]}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, made[0]).count() == 0
