"""Stages of the corpus pipeline on small tables."""

import corpus_pipeline


def test_near_duplicates_link_at_four_fifths_of_5_shingles(spark):
    def text(name, n, *changed):
        return " ".join("new" + str(i) if i in changed else name + str(i) for i in range(n))

    def jaccard(a, b, size):
        a, b = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    pairs = [(text("a", 50), text("a", 50, 25)), (text("b", 100), text("b", 100, 30, 70)), (text("c", 40), text("c", 40, 20))]
    assert all(jaccard(a, b, 3) < 0.9 for a, b in pairs)
    assert [jaccard(a, b, 5) >= 0.8 for a, b in pairs] == [True, True, False]
    rows = [(2 * i + j, t, "x", "y", len(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2, 4, 5]
