"""Each operator against a plain version of its definition, on small tables with nulls, empty texts, ties and repeated rows."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontaminate, html_blocks, jaccard_join, langid, line_dedup, neighbours, quality, sharding, substring_dedup
from tilewright.llm.components import components

WORDS = [f"w{i}" for i in range(60)] + ["é", "ß", "the"]


def made(seed, n=120):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(0, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(r.choice(base)) if r.random() < 0.6 else [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            if words:
                words[r.randrange(len(words))] = r.choice(WORDS)
        text = "".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in words)
        out.append((i, text, "x", i % 3))
    return [*out, (n, None, "x", 0), (n + 1, "", "y", 1), (n + 2, " \n ", "y", 1), (n + 3, "one", None, 1), (n + 4, "a " * 400, "z", 2)]


SCHEMA = "doc_id long, text string, lang string, text_crc32 long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(1), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_tiktoken(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    odd = ["a", "'s", "'", "'ll", "'re", " ", "  ", "\n", "é", "1", "½", "!", " ", "漢", "😀", "\x1c", "\x85", "Ⅷ", "don't", "I'M"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["x" * 3000]
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, "", 0) for i, t in enumerate(texts)], SCHEMA))
    vocabulary = bpe.load(spark, path)
    for row in bpe.decode(bpe.encode(more.withColumn("copy", F.col("text")), vocabulary), vocabulary).collect():
        assert row["ids"] == plain.encode_ordinary(row["copy"] or "")
        assert bytes(row["decoded"]) == (row["copy"] or "").encode()
    assert bpe.encode(none, vocabulary).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, none):
    texts = [r["text"] for r in docs.collect() if r["text"]]
    items = [(0, " ".join(texts[0].split()[:30]).upper()), (1, "w1 w2 w3"), (2, "one"), (3, None), (4, ""), (5, " ".join(texts[3].split()[2:14])), (6, "w5 w6 w7 w8 w9 w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    window = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for p in range(len(w) - min(10, len(w)) + 1) if w else []:
            window.setdefault(tuple(w[p : p + min(10, len(w))]), set()).add(str(i))
    for row in decontaminate.decontaminate(docs, bench).collect():
        w, hit, found = WORD.findall((row["text"] or "").encode().lower()), set(), set()
        for g, ids in window.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found |= ids
        assert (row["n_words"], row["n_hit"], row["hit_items"]) == (len(w), len(hit), sorted(found)), row["doc_id"]
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


@pytest.mark.parametrize("group", [256, 0])
def test_substring_dedup(spark, docs, none, group):
    seen = set()
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, group=group).collect()}
    for row in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        w = (row["text"] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(g)
        mine = out[row["doc_id"]]
        assert (mine["n_words"], mine["n_removed"]) == (len(w), sum(gone))
        assert mine["text"] == (None if row["text"] is None else b" ".join(x for x, d in zip(w, gone) if not d).decode())
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_jaccard_components(spark, none):
    r = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    rows = made(2, 60)
    for i in range(260):  # a group of near copies over the size of a cell
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"u{r.randrange(400)}"
        rows.append((1000 + i, " ".join(words), "x", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = jaccard_join.link_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), find(i)) for i in ids}
    assert jaccard_join.link_components(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_line_dedup(spark, docs, none):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
            return a == b
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        q = 0
        while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
            q += 1
        return p + q >= max(len(a), len(b)) - 1

    lines = [(r["doc_id"], pos, line.encode().split()) for r in docs.collect() if r["text"] is not None for pos, line in enumerate(r["text"].split("\n"))]
    lines.sort(key=lambda x: x[:2])
    dropped = {}
    for k, (doc, _, w) in enumerate(lines):
        if w and any(near(w, other) for _, _, other in lines[:k] if other):
            dropped[doc] = dropped.get(doc, 0) + 1
    got = line_dedup.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got if r["n_dropped"]} == dropped
    assert {r["doc_id"]: r["text"] for r in got if r["text"] is None} == {120: None}
    assert line_dedup.dedup_lines(none).count() == 0


def test_sharding(spark, none):
    rows = made(3, 300) + [(2000 + i, "copy of one text", "x", 0) for i in range(200)]  # a third of all rows is one group
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=5).collect()
    assert len(got) == len(rows)
    size = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(5)}
    count = {s: sum(r["shard"] == s for r in got) for s in range(5)}
    assert max(size.values()) < 1.05 * min(size.values()) and max(count.values()) - min(count.values()) <= 0.1 * len(rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    assert sharding.shard(none).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(0)
    vectors = [x.tolist() for x in r.normal(size=(400, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400 + i, vectors[0]) for i in range(40)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    good = {i: np.array(v) for i, v in rows if v is not None and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        true = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(mine) == 10 and all(abs(s - np.sqrt(((good[q] - good[i]) ** 2).sum())) < 1e-12 for s, i in mine)
        hits += len({i for _, i in true} & {i for _, i in mine})
        total += 10
    assert hits >= 0.9 * total
    assert not {r["query_id"] for r in got} & {900, 901, 902}
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_language(spark, none):
    r = random.Random(5)
    make = {"aa": "the and of with thing", "bb": "der die und nicht schön", "cc": "le la et où élève"}
    rows = [(i, " ".join(r.choice(make[l].split()) for _ in range(r.randint(2, 30))), l, 0) for i in range(240) for l in [r.choice(list(make))]]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df.filter("doc_id % 4 <> 2"))
    got = langid.predict(df.filter("doc_id % 4 = 2"), model, keep=["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, None, 0), (2, "", None, 0), (3, "12 %%", None, 0)], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()} == {("und", 0.0)}
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(none)).collect()} == {"und"}


def test_quality(spark, none):
    r = random.Random(6)
    rows, ratings = [], []
    for i in range(1500):
        kind = i % 3
        words = [f"n{r.randrange(100)}" for _ in range(15)]
        if kind == 0:
            words = [w + " |" for w in words]
        if kind == 1:
            words[r.randrange(15)] = r.choice(["idiot", "scum"])
        rows.append((i, " ".join(words), "x", 0))
        ratings.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*ratings, (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels.filter("doc_id < 1200 OR quality IS NULL"), quality.grade(), quality.GRADES)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r["at_least"][-1] >= quality.SELECT_FROM for r in quality.score(df, model).collect()}
    assert sum(got[i] == (i % 3 == 2) for i in range(1200, 1500)) >= 280
    assert quality.score(none, model).count() == 0 and quality.score(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA), model).count() == 2


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>First   part<br>here<p>Second &lt;one&gt;</p><div class="comments"><p>I like it</p></div></article><aside>more</aside><footer>&copy; me</footer>"""
    net = html_blocks.fit([html_blocks.blocks_of(page)] * 20)
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "&am")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(df, net).collect()}
    assert got[1] == "A & B\nFirst part here\nSecond <one>"
    assert got[2] == got[3] == ""
    assert html_blocks.extract(df.limit(0), net).count() == 0
    assert html_blocks.train(df.limit(0)) is not None
    assert len(html_blocks.blocks_of(page)) == 8


def test_html_without_names():
    """Given pages whose names are taken away and whose boxes are alike, of which the labeller has seen none."""
    pages = [html_blocks.blocks_of(r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    net = html_blocks.fit([p for p in pages[:125] if len(p) <= 400])
    bare = [[html_blocks.Block(tuple(n if n in html_blocks.PLAIN else "div" for n in b.path if n[0] != "."), b.text, b.linked, b.told) for b in p] for p in pages[125:]]
    told, got = np.array([b.told for p in bare for b in p]), np.concatenate(html_blocks.label(net, bare))
    assert got[told == 1].mean() >= 0.95 and (~got[told == 0]).mean() >= 0.95


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<div class=it's>a</div><p title=\"a>b", [("a", -1), ("b", -1)]),
        ("<html><head><title>T</title><body><p>x</p>", [("x", -1)]),
        ("<article class=no-comments><header><h1>A</h1></header><p data-x='<b>'>b</p></article>", [("A", 1), ("b", 1)]),
        ("<body class=has-sidebar><article>z<div class=ads>y</div></article><p", [("z", 1), ("y", 0)]),
        ("<div class=comments><article>x</article></div>&lt;p&gt;", [("x", 0), ("<p>", -1)]),
        ("<a " * 20000, []),
    ],
)
def test_html_markup(page, blocks):
    assert [(b.text, b.told) for b in html_blocks.blocks_of(page)] == blocks


def test_substrings_of_any_kind(spark):
    r = random.Random(7)
    pool = [" ".join(f"p{j}_{r.randrange(40)}" for _ in range(r.randrange(5, 60))) for j in range(8)]
    docs = [(f"k{k:03d}", " ".join(r.choice(pool) if r.random() < 0.6 else " ".join(f"u{r.randrange(9)}" for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 9)))) for k in range(150)]
    docs += [("k150", docs[3][1]), ("k151", "a " * 5000), ("k152", "b a " * 3000), ("k153", "z " * 200_000), (None, docs[5][1])]
    want, seen = {}, set()
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words, gone = text.split(), set()
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        want[i] = (len(words), len(gone), " ".join(w for q, w in enumerate(words) if q not in gone))
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    for group in (2048, 5):
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup_substrings(df, group=group).collect()} == want


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(1, 1 << 62, 5000, dtype=np.uint64)
    found = bpe.PerfectHash(keys)
    assert (found.find(keys) == np.arange(5000)).all() and len(found.key) == 5000
    assert (found.find(keys + np.uint64(1)) == -1).all()
