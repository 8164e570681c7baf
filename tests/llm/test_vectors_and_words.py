"""Whitening, vector codes and word BPE against plain versions, and their odd rows."""

import hashlib
import random
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import vector_codes, whitening, word_bpe

SCHEMA = "vec_id long, embedding array<double>, label int"
PATH = public_tokenizers.path("word_bpe_49k.json")


def _vectors(rows, d, seed, spread=0.5):
    random_numbers = np.random.default_rng(seed)
    base = random_numbers.normal(size=(rows, d)) * np.linspace(1, 2, d) * spread
    return [(i, [float(c) for c in row], int(i % 3) if i % 7 else None) for i, row in enumerate(base)]


def _plain_codes(rows, parts, entries, rounds):
    """All entries for every part, in Python's integers."""
    d = len(rows[0][1])
    width = -(-d // parts)
    grid = {i: [floor(Fraction(c) * 1024) for c in v] + [0] * (width * parts - d) for i, v, _ in rows}
    cut = {i: [g[p * width : (p + 1) * width] for p in range(parts)] for i, g in grid.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = {}
            for x in cut.values():
                own.setdefault(best(x[p], book)[1], []).append(x[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(book)])
        books = new
    out = {}
    for i, x in cut.items():
        found = [best(x[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return out, digest


def _same_codes(spark, rows, **options):
    df, _ = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **options)
    got = {r["vec_id"]: r for r in df.collect()}
    want, digest = _plain_codes([r for r in rows if r[1]], options.get("parts", 4), options.get("entries", 256), options.get("rounds", 4))
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {i: (c, e if e < 1 << 63 else None) for i, (c, e) in want.items()}
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    by_label = {}
    for i, _, label in rows:
        if i in got:
            by_label.setdefault(label, []).append(want[i][1])
    assert all(r["label_error"] == (None if max(by_label[r["label"]]) >= 1 << 63 else sum(by_label[r["label"]])) for r in got.values())


def test_codes_equal_trying_all_entries(spark):
    _same_codes(spark, _vectors(400, 8, 1), entries=32)
    _same_codes(spark, _vectors(90, 10, 2))  # fewer vectors than entries, a length that 4 doesn't divide
    _same_codes(spark, [(i, [0.25, -0.25, 0.5, 0.0], 1) for i in range(20)] + [(20 + i, [0.25, -0.25, 0.0, 0.5], 2) for i in range(20)], entries=8)  # ties


def test_codes_of_components_of_any_size(spark):
    rows = _vectors(60, 4, 3)
    rows[5] = (5, [1e9, -3e9, 2.5, 1e30], 1)
    rows[6] = (6, [1e9, -3e9, 2.5, 1e30], 2)
    rows[50] = (50, [1e9, -3.1e9, 2.5, 1e3], 2)
    _same_codes(spark, rows, entries=16)


def test_bounds_spare_most_distances():
    random_numbers = np.random.default_rng(4)
    centres = random_numbers.integers(-4000, 4000, (64, 4))
    points = centres[random_numbers.integers(0, 64, 2000)] + random_numbers.integers(-20, 20, (2000, 4))
    pivots = vector_codes.choose_pivots(centres[None], 8)[0]
    who, best, tried = vector_codes.nearest(points, vector_codes.pivot_distances(points, pivots), centres, vector_codes.pivot_distances(centres, pivots))
    everything = ((points[:, None] - centres[None]) ** 2).sum(-1)
    assert (who == everything.argmin(1)).all() and (best == everything.min(1)).all()
    assert tried < 0.15 * everything.size


def _odd(rows):
    return [*rows, (None, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [nan] * 4, 1), (904, [inf, 0.0, 0.0, 0.0], 1), (905, [1.0] * 5, 1)]


def test_odd_vectors_take_no_part(spark):
    rows = _vectors(50, 4, 5)
    plain = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    odd = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(_odd(rows), SCHEMA))[0].collect()}
    assert odd == plain
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, None)], SCHEMA))[0].collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA))[0].collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 2)], SCHEMA))[0].collect() == []
    one, _ = whitening.whiten(spark.createDataFrame(_odd(rows), SCHEMA), keep=["vec_id"])
    assert {r["vec_id"] for r in one.collect()} == set(range(50))


def test_repeated_rows_and_clashing_names(spark):
    rows = _vectors(30, 4, 6) * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"vec_id": "k0", "label": "id"}).withColumn("vector", F.lit(1)).withColumn("a.b", F.lit(2))
    coded, _ = vector_codes.compress(df, id_col="k0", label_col="id", keep=["k0", "id", "vector", "a.b"])
    assert coded.count() == 60 and coded.columns[:4] == ["k0", "id", "vector", "a.b"]
    white, _ = whitening.whiten(df, keep=["k0", "vector", "a.b"])
    assert white.count() == 240
    with pytest.raises(ValueError):
        whitening.whiten(df.withColumn("n", F.lit(1)))


def _plain_whitening(rows, components):
    grid = np.array([[floor(Fraction(c) * 1024) + 100000 for c in v] for _, v, _ in rows], object)
    n, sums = len(grid), grid.sum(0)
    off = grid * n - sums
    v = (off.T @ off).astype(float) / float(n) ** 3 * 1.0
    values, vectors = np.linalg.eigh(v * n / n)
    deviation = (off * off).sum(1)
    order = np.argsort(-values)[:components]
    return n, deviation, values[order], vectors[:, order].T, values.sum()


def test_whitening_equals_a_symmetric_eigensolver(spark):
    rows = _vectors(300, 12, 7)
    df, model = whitening.whiten(spark.createDataFrame(rows, SCHEMA), keep=["vec_id"])
    n, deviation, values, vectors, trace = _plain_whitening(rows, 8)
    assert np.allclose(model.eigenvalues, values, rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * vectors).sum(1)), 1, atol=1e-12)
    got = df.collect()
    assert len(got) == 8 * 300 and {r["n"] for r in got} == {n}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    assert all(abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-12 for r in got)
    w = np.zeros((300, 8))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-12 and got[0]["identity_error"] < 1e-12


def test_multiple_and_missing_eigenvalues(spark):
    corners = [[float((i >> k) & 1) for k in range(5)] for i in range(32)]  # five equal eigenvalues
    df, model = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(corners)], SCHEMA))
    assert len(model.vectors) == 5 and np.allclose(model.eigenvalues, 512.0**2) and df.first()["identity_error"] < 1e-12
    flat = [(i, [float(i), 2.0 * i, 1.0, -float(i)], 0) for i in range(9)]  # one direction
    df, model = whitening.whiten(spark.createDataFrame(flat, SCHEMA))
    assert len(model.vectors) == 1 and df.count() == 9 and df.first()["identity_error"] < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], SCHEMA)
    assert whitening.whiten(same)[0].collect() == []
    huge = [(i, [v * 1e12 for v in row], label) for i, row, label in _vectors(40, 3, 8)]
    df, model = whitening.whiten(spark.createDataFrame(huge, SCHEMA))
    assert df.filter("deviation IS NULL").count() == 120 and df.first()["identity_error"] < 1e-9


def test_polynomial_and_roots_are_exact(spark):
    roots = [3, 3, 5, 11, 40, 1000]
    random_numbers = random.Random(9)
    m = [[0] * 6 for _ in range(6)]
    rows = [[random_numbers.randint(-9, 9) for _ in range(6)] for _ in range(9)]
    for i in range(6):
        for j in range(6):
            m[i][j] = sum(r[i] * r[j] for r in rows)
    c = whitening.characteristic(spark, m)
    for at in range(-3, 4):  # det(at - m) by elimination in fractions
        a, value = [[Fraction(int(i == j) * at - m[i][j]) for j in range(6)] for i in range(6)], Fraction(1)
        for k in range(6):
            pivot = next(i for i in range(k, 6) if a[i][k])
            if pivot != k:
                a[k], a[pivot], value = a[pivot], a[k], -value
            value *= a[k][k]
            for i in range(k + 1, 6):
                by = a[i][k] / a[k][k]
                a[i] = [x - by * y for x, y in zip(a[i], a[k])]
        assert value == sum(v * at**k for k, v in enumerate(c))
    plain = [1]
    for r in roots:
        plain = [(plain[k - 1] if k else 0) - r * (plain[k] if k < len(plain) else 0) for k in range(len(plain) + 1)]
    found = whitening.RealRoots(plain).greatest(6, Fraction(2000))
    assert [(round(float(r), 9), n) for r, n in found] == [(1000, 1), (40, 1), (11, 1), (5, 1), (3, 2)]


TEXTS = [
    "", None, "Hello  World's <|endoftext|>ÉCOLE 123 ''s 'Re ΣΑΣ İx", "é é Å ﬁ ½ Ⅷ 一二 ١٢ \u0085   \x1c a​b 'S'T'S's 'll'dd", "x" * 500 + "ab" * 300, "<|startoftext|><|endoftext|> <|Endoftext|>",
    "á<|endoftext|>́a", "don't DON'T 'reading ''re \"'s\" ...'s", "\U0001d400 \U00010428 \U00010400 𝟘 🙂🙂", "the the the", "the the the", " \t\n", "a" * 100_000, ("word%d " * 20_000) % tuple(range(20_000)),
]


def test_word_ids_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    vocabulary = word_bpe.load(spark, PATH)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k0 int, text string").withColumn("chunk", F.lit("c")).withColumn("a.b", F.lit(1)).repartition(3)
    for chunk_bytes in (64, 1 << 23):
        ids = word_bpe.encode(df, vocabulary, chunk_bytes=chunk_bytes)
        got = {r["k0"]: r for r in word_bpe.decode(ids, vocabulary).collect()}
        assert len(got) == len(TEXTS) and ids.columns == ["k0", "chunk", "a.b", "ids"]
        for k, text in enumerate(TEXTS):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert got[k]["ids"] == want, k
            assert got[k]["decoded"] == library.decode(want, skip_special_tokens=False), k


def test_blocks_give_each_word_its_ids(spark):
    vocabulary = word_bpe.load(spark, PATH)
    lists = {c: [b"the", b"cat", *[f"own{c}x{k}".encode() for k in range(40)]] for c in range(5)}
    listed = spark.createDataFrame([(c, len(w), *map(bytearray, word_bpe.pack_words(w))) for c, w in lists.items()], "chunk long, n_words long, sizes binary, words binary")
    seen = {}
    for row in word_bpe.encode_words(listed, vocabulary, bucket_words=10).collect():
        ids = np.frombuffer(word_bpe.unzipped(bytes(row["ids"])), np.int32)
        numbers, sizes = np.cumsum(word_bpe.unpack(bytes(row["numbers"]))), word_bpe.unpack(bytes(row["sizes"]))
        for number, part in zip(numbers.tolist(), np.split(ids, np.cumsum(sizes)[:-1])):
            seen[row["chunk"], number] = part.tolist()
    assert seen == {(c, k): vocabulary.value.encode_word(w) for c, own in lists.items() for k, w in enumerate(own)}


def test_word_cases(spark):
    vocabulary = word_bpe.load(spark, PATH)
    none = spark.createDataFrame([], "doc_id int, text string")
    assert word_bpe.encode(none, vocabulary).collect() == []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "n int, ids array<int>")
    assert [r["decoded"] for r in word_bpe.decode(ids, vocabulary).orderBy("n").collect()] == [None, "", "a</w> <|endoftext|>"]
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a<|endoftext|>")], "n int, text string")
    digests = word_bpe.encode(texts, vocabulary, digest=True).orderBy("n").collect()
    assert [r["n_tokens"] for r in digests] == [0, 0, 2]
    assert digests[2]["ids_sha256"] == hashlib.sha256(np.array([320, 49407], "<u4").tobytes()).hexdigest()
    with pytest.raises(Exception, match="vocabulary"):
        word_bpe.decode(spark.createDataFrame([(1, [60000])], "n int, ids array<int>"), vocabulary).collect()
    with pytest.raises(ValueError):
        word_bpe.encode(none.withColumnRenamed("doc_id", "ids"), vocabulary)


def test_numbers_survive_packing():
    numbers = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 + 5, 3], np.int64)
    parts = word_bpe.pack_each(numbers, np.array([0, 4, 0, 5]))
    assert [word_bpe.unpack(p).tolist() for p in parts] == [[], numbers[:4].tolist(), [], numbers[4:].tolist()]
