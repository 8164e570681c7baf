"""Replacement groups and their dependencies against plain loops over tiles, in tasks and by joins."""

import random
import re

import pytest

from tilewright.plans import cover

CUT, TOP = "cut_id long, z int, x long, y long", 6


def inside(t, g):
    """Whether g is a coarser tile around t."""
    return t[0] > g[0] and (t[1] >> (t[0] - g[0]), t[2] >> (t[0] - g[0])) == g[1:]


def touch(a, b):
    """Whether the closed squares of two tiles meet on the ring."""
    (al, ah), (bl, bh), (cl, ch), (dl, dh) = [(v << (TOP - t[0]), (v + 1) << (TOP - t[0])) for i in (1, 2) for t in (a, b) for v in (t[i],)]
    return cl <= dh and dl <= ch and any(al <= bh + k and bl + k <= ah for k in (-(1 << TOP), 0, 1 << TOP))


def members_of(old, new):
    gone, come = old - new, new - old
    out = {(*g, "after", *t) for t in come for g in gone if inside(t, g)} | {(*g, "before", *t) for t in gone for g in come if inside(t, g)}
    return out | {(*r[:3], "before" if r[3] == "after" else "after", *r[:3]) for r in out}


def edges_of(members):
    name = lambda r: "/".join(map(str, r[:3]))
    return {(name(a), name(b)) for a in members if a[3] == "after" for b in members if b[3] == "before" if name(a) != name(b) and abs(a[4] - b[4]) > 1 and touch(a[4:], b[4:])}


def split(r, deep):
    """A cover of the world by random splits."""
    leaves, todo = set(), [(0, 0, 0)]
    while todo:
        z, x, y = todo.pop()
        if z < deep and (z == 0 or r.random() < 0.55):
            todo += [(z + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
        else:
            leaves.add((z, x, y))
    return leaves


def plans():
    """Covers, sets of tiles that overlap, and one side alone."""
    r, out = random.Random(11), {}
    some = lambda: {(z, r.randrange(1 << z), r.randrange(1 << z)) for z in r.choices(range(TOP), k=25)}
    for k in range(8):
        out[k] = split(r, 4 + k % 2), split(r, 4)
    out |= {k: (some(), some()) for k in range(8, 14)}
    return out | {14: (some(), set()), 15: (set(), some())}


@pytest.mark.parametrize("most", [1 << 16, 120, 0])
def test_groups_and_dependencies_move_no_ancestors(spark, monkeypatch, most):
    monkeypatch.setattr(cover, "PLAN_TILES", most, raising=False)
    given = plans()
    odd = [(None, 0, 0, 0), (3, 2, None, 1), (3, None, 1, 1), (3, 2, 1, None)]
    frame = lambda i: spark.createDataFrame([(k, *t) for k, cuts in given.items() for t in cuts[i] for _ in range(1 + (t[1] == 1))] + odd, CUT)
    groups = cover.replacement_groups(frame(0), frame(1))
    assert groups.columns == ["cut_id", "group_z", "group_x", "group_y", "side", "z", "x", "y"] and [t for _, t in groups.dtypes] == ["bigint", "int", "bigint", "bigint", "string", "int", "bigint", "bigint"]
    got, want = [tuple(m) for m in groups.collect()], {k: members_of(*cuts) for k, cuts in given.items()}
    assert len(got) == len(set(got)) and set(got) == {(k, *m) for k, some in want.items() for m in some}
    edges = cover.group_dependencies(groups)
    found = [tuple(e) for e in edges.collect()]
    assert len(found) == len(set(found)) and set(found) == {(k, *e) for k, some in want.items() for e in edges_of(some)}
    assert len(found) > 50
    # where plans are small, tiles meet in tasks: no table of tiles and all above them is shuffled or sorted
    for df in (groups, edges):
        assert most < 1 << 16 or "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_ready_batches_count_up_groups_before_batches_are_looked_up(spark):
    r = random.Random(4)
    states = ["ready", "missing", "requested", None]
    members, needs, batches, waits = [], [], [], []
    for k in range(6):
        for n in range(9):
            batches.append((k, f"2/{n}/0", f"2/{n - n % 2}/0"))
            for x in range(r.randrange(4)):
                members.append((k, 2, n, 0, "after", 4, x, n))
                needs += [(k, 4, x, n, s) for s in r.sample(states, k=r.choice([1, 1, 1, 2])) if s or r.random() < 0.5]
            members.append((k, 2, n, 0, "before", 2, n, 0))
        waits.append((k, "2/4/0", "2/0/0"))
    done = lambda m: all(s in ("ready", "missing") for s in [n[4] for n in needs if n[:4] == (m[0], *m[5:])] or [None])
    of = {b[:2]: b[2] for b in batches}
    tiles = [(m[0], of[m[0], f"2/{m[2]}/0"], done(m)) for m in members if m[4] == "after"]
    want = {t[:2] for t in tiles} - {t[:2] for t in tiles if not t[2]} - {w[:2] for w in waits}
    frame = spark.createDataFrame
    out = cover.ready_batches(
        frame(batches, "cut_id long, node string, batch string"),
        frame(waits, "cut_id long, batch string, depends_on string"),
        frame(members, "cut_id long, group_z int, group_x long, group_y long, side string, z int, x long, y long"),
        frame(needs, "cut_id long, z int, x long, y long, state string"),
    )
    got = [tuple(b) for b in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert re.search(r"Aggregate \[cut_id#\d+L?, node#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
