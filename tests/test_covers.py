"""Covers against their rule, tile by tile, and the joins that meet them."""

import random

from tilewright.operators import tiles as T
from tilewright.plans import cover


def by_rule(zoom, x, wide, y, tall):
    asked, opened, leaves = {(c % (1 << zoom), r) for c in range(x, x + wide) for r in range(y, y + tall) if 0 <= r < 1 << zoom}, set(), set()
    for z in range(zoom, 0, -1):
        w, parents = 1 << (z - 1), {(c // 2, r // 2) for c, r in asked}
        own = {(2 * c + i, 2 * r + j) for c, r in parents for i in (0, 1) for j in (0, 1)}
        leaves |= {(z, *t) for t in own - opened}
        asked = {(ax % w, ay) for c, r in own for ax in (c // 2, c // 2 + (1 if c % 2 else -1)) for ay in (r // 2, r // 2 + (1 if r % 2 else -1)) if 0 <= ay < w}
        opened = parents
    return leaves if zoom else {(0, 0, 0)}


def test_covers_follow_the_rule_without_sets_of_tiles(spark):
    r, rows = random.Random(3), []
    for k in range(60):
        z = r.randrange(9)
        rows.append((k, z, r.randint(-(1 << z), 2 << z), r.randint(1, 12), r.randint(-6, (1 << z) + 3), r.randint(1, 12)))
    targets = spark.createDataFrame([*rows, (99, 5, 0, 8, None, 8)], "observer_id long, zoom int, block_x long, block_width long, block_y long, block_height long")
    made = cover.balanced_cover(targets)
    got = [tuple(t) for t in made.select("observer_id", "z", "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, *t) for k, *target in rows for t in by_rule(*target)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and "array_distinct" not in plan


def by_corners(a, b, top=6):
    """Whether the closed squares of two tiles meet on the ring."""
    (z, x, y), (oz, ox, oy) = a, b
    span = lambda z, v: (v << (top - z), (v + 1) << (top - z))
    (al, ah), (bl, bh), (cl, ch), (dl, dh) = span(z, x), span(oz, ox), span(z, y), span(oz, oy)
    return a != b and cl <= dh and dl <= ch and any(al <= bh + k and bl + k <= ah for k in (-(1 << top), 0, 1 << top))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_touching_tiles_meet_once_and_not_through_the_driver(spark):
    r = random.Random(5)
    some = lambda n: [(r.randrange(2), z, r.randrange(1 << z), r.randrange(1 << z)) for z in r.choices(range(7), k=n)]
    a, b = some(60), some(60)
    frame = lambda rows: spark.createDataFrame(rows, "k long, z int, x long, y long")
    met = T.touching_tiles(frame(a), frame(b), ["k"])
    got = [tuple(p) for p in met.collect()]
    want = {(k, *t, *o) for k, *t in a for m, *o in b if k == m and by_corners(tuple(t), tuple(o))}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Broadcast" not in planned(met)


def test_replacements_and_dependencies_do_not_go_through_the_driver(spark):
    frame = lambda rows: spark.createDataFrame(rows, "cut_id long, z int, x long, y long")
    family = [(1, 1, i, j) for i in (0, 1) for j in (0, 1)]
    groups = cover.replacement_groups(frame([(1, 0, 0, 0)]), frame(family))
    assert groups.filter("side = 'after'").count() == 4 and groups.filter("side = 'before'").count() == 1
    for df in (groups, cover.group_dependencies(groups)):
        assert "Broadcast" not in planned(df)
