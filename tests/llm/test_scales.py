"""Nearest neighbours of vectors whose norms are far apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import neighbours


def recall(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    hits = []
    for q in range(0, len(vectors), 50):
        gap = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        gap[q] = np.inf
        hits.append(len(set(np.argsort(gap)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q}) / 10)
    return hits


@pytest.mark.parametrize("made", ["one very large", "mixed norms"])
def test_recall_at_any_scale(spark, made):
    vectors = np.random.default_rng(3).uniform(-0.6, 0.6, size=(1500, 8))
    if made == "one very large":
        vectors[0, 2] = 1000
    else:
        vectors[::3] *= 1000
    hits = recall(spark, vectors)
    print(made, np.mean(hits), min(hits))
    assert np.mean(hits) >= 0.95 and hits[0] >= 0.9
