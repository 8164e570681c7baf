"""The Jaccard join over regions that pivots cut, over dense ones, and through shared parts; all against brute force."""

import random

import pytest

from tilewright.llm import jaccard_join


def brute(docs, size, per_cent):
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                m, n = find(ids[x]), find(ids[y])
                parent[max(m, n)] = min(m, n)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families():
    r = random.Random(5)
    docs = []
    for f in range(12):
        base = [f"c{j}" for j in range(30)] + [f"f{f}w{j}" for j in range(60 + f * 25)]
        for m in range(24):
            w = list(base)
            for _ in range(r.randrange(0, 4) + (6 if m % 5 == 0 else 0)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


def phrases():
    r = random.Random(6)
    known, docs = [[f"b{q}_{j}" for j in range(9)] for q in range(14)], []
    for f in range(110):
        base = [f"f{f}w{j}" for j in range(r.randrange(12, 40))]
        for q in r.sample(range(14), 3):
            at = r.randrange(len(base))
            base[at:at] = known[q]
        for _ in range(r.choice([1, 2, 2, 3])):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize(("make", "size", "per_cent", "tries", "ways"), [(families, 3, 90, 1, {"cut", "bands"}), (phrases, 2, 70, 4, {"cut", "dense"})])
def test_regions_of_many_levels(spark, monkeypatch, make, size, per_cent, tries, ways):
    seen, cuts = set(), []
    for name, way in (("_cut", "cut"), ("_dense", "dense"), ("_banded", "bands")):
        own = getattr(jaccard_join, name)

        def spy(*args, own=own, way=way):
            seen.add(way)
            cuts.append(way)
            return own(*args)

        monkeypatch.setattr(jaccard_join, name, spy)
    docs = [*make(), (9001, None), (9002, ""), (9003, "one two"), (9004, "One two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df, size=size, per_cent=per_cent, tries=tries, cell=4).collect()}
    assert got == brute(docs, size, per_cent)
    assert ways <= seen and cuts.count("cut") >= 2


def test_rows_of_one_id_with_other_texts(spark):
    a, b = "p q r s t u v w x y", "k l m n o a b c d e"
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (3, a)], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.link_components(df).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]



def test_parts_meet_through_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_KEYS", 50)
    monkeypatch.setattr(jaccard_join, "LINKS", 3)
    monkeypatch.setattr(jaccard_join, "PARTITION_SHINGLES", 2000)
    docs = [*families(), (9001, None), (9002, ""), (9003, "one two"), (9004, "One two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(df, size=5, per_cent=80, tries=8).collect()}
    assert got == brute(docs, 5, 80)


def test_packed_keys_come_back():
    keys, owners = jaccard_join.np.array([5, 2**47 + 9, 2**48 - 1], "u8"), jaccard_join.np.array([-7, 2**62, -7], "i8")
    back = jaccard_join._unpacked(*jaccard_join._packed(keys, owners))
    assert [b.tolist() for b in back] == [keys.tolist(), owners.tolist()]


def test_small_regions_move_their_sets_once(spark, monkeypatch):
    docs = [(i, f"a{i // 2} " + " ".join(f"w{i // 2}x{k}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(60)]
    plans, within = [], jaccard_join._within
    monkeypatch.setattr(jaccard_join, "_within", lambda small, *rest: plans.append(small._jdf.queryExecution().executedPlan().toString()) or within(small, *rest))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([*docs, docs[3], docs[8]], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(rows).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(docs, 3, 90)
    assert plans and not any("SortMergeJoin" in p for p in plans)


def test_only_classes_that_share_enough_go_further(spark, monkeypatch):
    r = random.Random(9)
    common = " ".join(f"p{j}" for j in range(12))
    docs = [(i, f"{common} " + " ".join(f"d{i}x{r.randrange(10**9)}" for _ in range(40))) for i in range(300)]
    docs += [(1000 + i, " ".join(f"t{i // 2}y{j}" for j in range(60)) + (" end" if i % 2 else "")) for i in range(6)]
    seen, own = [], jaccard_join._touching
    monkeypatch.setattr(jaccard_join, "_touching", lambda sets, *rest: seen.append({x["cls"] for x in sets.select("cls").collect()}) or own(sets, *rest))
    df = spark.createDataFrame([*docs, docs[0], docs[303]], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.link_components(df, size=5, per_cent=80, tries=8).collect()}
    assert got == brute(docs, 5, 80)
    assert len(seen[0]) == 6


def test_shared_shingles_are_counted_in_many_small_blocks(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(3, 60)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def named(column):
        return ((jaccard_join.signature(s), s) for s in jaccard_join.shingle_sets(column, 2))

    sets = {}
    for cls, s in named(jaccard_join.pa.array([t for _, t in docs])):
        sets[cls] = set(jaccard_join._asked(s).tolist())
    want = {c: sum(any(x in o for d, o in sets.items() if d != c) for x in s) for c, s in sets.items()}
    for keys in (1 << 20, 40):
        monkeypatch.setattr(jaccard_join, "BLOCK_KEYS", keys)
        got = {x["cls"]: x["shared"] for x in jaccard_join._shared(df, named, 5000).collect()}
        assert all(got.get(c, 0) >= n for c, n in want.items())
        assert keys == 40 or got == {c: n for c, n in want.items() if n}


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    from tilewright.llm import components as C

    edges = [(i, i + 1) for i in range(0, 400) if i % 50] + [(1000 + i, 2000) for i in range(90)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {n: 50 * ((n - 1) // 50) + 1 for n in range(1, 401) if n <= 400} | {1000 + i: 1000 for i in range(90)} | {2000: 1000}
    for most in (1 << 16, 16):
        monkeypatch.setattr(C, "EDGES", most)
        assert {x["node"]: x["root"] for x in C.components(df).collect()} == want


def test_dense_regions_of_some_cells_need_no_row_for_a_part(spark, monkeypatch):
    plans, own = [], jaccard_join.checkpoint
    monkeypatch.setattr(jaccard_join, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    docs = families()[:48]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.link_components(df, size=3, per_cent=90, cell=4).collect()}
    assert got == brute(docs, 3, 90)
    assert any("band" in p for p in plans) and not any("explode(keys" in p for p in plans)
