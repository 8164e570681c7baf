"""Observer targets, balanced covers, and the replacement of one cover by another, for many observers at once."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tilewright.functions import geo
from tilewright.functions.shared import checkpoint
from tilewright.operators.tiles import TILE, touching_tiles, with_ancestors


def mode_at(lat: Column, z: Column) -> Column:
    """normal, or the boundary that the observer is beyond or within two rows of."""
    w, row = geo.width(z), geo.tile_y(lat, z)
    return (
        F.when(lat > geo.MAX_LATITUDE, "north-boundary").when(lat < -geo.MAX_LATITUDE, "south-boundary").when(w < geo.BLOCK, "normal")
        .when(row < geo.MARGIN, "north-boundary").when(row > w - geo.MARGIN - 1, "south-boundary").otherwise("normal")
    )


def observer_targets(observers: DataFrame) -> DataFrame:
    """observers (observer_id, lat, lon, max_zoom) with mode, zoom and the block of finest tiles: block_x, block_y, block_width, block_height.

    Without an earlier state; the streaming operators carry one. Beyond the map's edge the zoom drops by one for each doubling of the distance in
    finest tiles. block_x isn't wrapped.
    """
    z0 = F.greatest(F.lit(0), F.floor(F.col("max_zoom")).cast("int"))
    df = observers.withColumn("mode", mode_at(F.col("lat"), z0))
    edge = 2 * math.pi * geo.EARTH_RADIUS_KM * math.cos(math.radians(geo.MAX_LATITUDE)) / geo.width(z0)
    beyond = F.greatest(F.lit(0.0), F.abs(F.col("lat")) - geo.MAX_LATITUDE) * (math.pi / 180) * geo.EARTH_RADIUS_KM
    drop = F.floor(F.log2(1 + beyond / edge)).cast("int")
    zoom = F.when(F.col("mode") == "normal", z0).otherwise(F.greatest(F.lit(0), z0 - drop))
    df = df.withColumn("zoom", zoom)
    w, size = geo.width("zoom"), F.least(F.lit(geo.BLOCK).cast("long"), geo.width("zoom"))
    normal = F.col("mode") == "normal"
    x, y = geo.tile_x("lon", "zoom"), geo.tile_y("lat", "zoom")
    anchored = F.floor((F.floor(geo.mercator_x("lon", "zoom")) - geo.MARGIN) / geo.STRIDE) * geo.STRIDE
    block_x = F.when(normal, F.when(w <= geo.BLOCK, 0).otherwise(x - 3)).otherwise(F.when(w < geo.BLOCK, 0).otherwise(anchored))
    block_y = F.when(normal, F.when(w <= geo.BLOCK, 0).otherwise(geo.clamp(y - 3, F.lit(0).cast("long"), w - geo.BLOCK))).when(F.col("mode") == "north-boundary", 0).otherwise(w - size)
    return df.withColumns({"block_x": block_x.cast("long"), "block_y": block_y.cast("long"), "block_width": size, "block_height": size})


def block_tiles(x: Column, y: Column, width: Column, height: Column, z: Column) -> Column:
    """The tiles of a block as array<struct<x, y>>: columns wrap, rows off the map are left out."""
    w = geo.width(z)
    rows = F.filter(F.sequence(y, y + height - 1), lambda r: (r >= 0) & (r < w))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(x, x + width - 1), lambda c: F.struct(F.pmod(c, w).alias("x"), r.alias("y"))))))


def finest_tiles(targets: DataFrame, key: str = "observer_id") -> DataFrame:
    tiles = block_tiles(F.col("block_x"), F.col("block_y"), F.col("block_width"), F.col("block_height"), F.col("zoom"))
    return targets.select(key, F.col("zoom").alias("z"), F.explode(tiles).alias("t")).select(key, "z", "t.x", "t.y")


def balanced_cover(targets: DataFrame, key: str = "observer_id") -> DataFrame:
    """(key, z, x, y, role): the least complete quadtree cover that has the finest tiles, with touching tiles at most one zoom apart.

    From the finest zoom up, the tiles asked for are completed to families of four, and each member of a family asks the zoom above for the tiles around the place it faces. What
    is asked of a zoom is then a rectangle on the ring: the block's parents, and from there on the parents with one more row and column on each side. So a row's fold
    carries four numbers, and the leaves of a zoom are its families' rectangle without that of the tiles opened for the zoom below.
    """
    z0 = F.col("zoom").cast("int")
    half = lambda v: F.call_function("shiftright", v, F.lit(1))
    kind = "struct<x:bigint,wide:bigint,y:bigint,tall:bigint>"
    rectangle = lambda x, wide, y, tall: F.struct(x.cast("long").alias("x"), wide.cast("long").alias("wide"), y.cast("long").alias("y"), tall.cast("long").alias("tall"))

    def clipped(x: Column, wide: Column, y: Column, below: Column, w: Column) -> Column:
        """On a zoom of w columns: at most the whole ring, and the rows up to ``below`` that are on the map."""
        top = F.greatest(y, F.lit(0).cast("long"))
        return rectangle(x, F.least(wide, w), top, F.greatest(F.lit(0).cast("long"), F.least(below, w) - top))

    def parents(asked: Column, z: Column) -> Column:
        x, y, tall = half(asked["x"]), half(asked["y"]), asked["tall"]
        return rectangle(x, F.least(half(asked["x"] + asked["wide"] - 1) - x + 1, geo.width(z - 1)), y, F.when(tall > 0, half(asked["y"] + tall - 1) - y + 1).otherwise(0))

    def level(state: Column, z: Column) -> Column:
        up = lambda p: F.struct(
            F.when(p["tall"] > 0, clipped(p["x"] - 1, p["wide"] + 2, p["y"] - 1, p["y"] + p["tall"] + 1, geo.width(z - 1))).otherwise(p).alias("asked"),
            p.alias("opened"),
            F.concat(state["levels"], F.array(F.struct(z.alias("z"), p.alias("own"), state["opened"].alias("opened")))).alias("levels"),
        )
        return geo.let(parents(state["asked"], z), up)

    block = clipped(F.col("__x"), F.col("__wide"), F.col("__y"), F.col("__y") + F.col("__tall"), geo.width("__zoom"))
    nothing = rectangle(*[F.lit(0)] * 4)
    start = F.struct(block.alias("asked"), nothing.alias("opened"), F.array().cast(f"array<struct<z:int,own:{kind},opened:{kind}>>").alias("levels"))
    # the root alone, as the family of one that a world without zooms has
    root = F.array(F.struct(F.lit(0).alias("z"), rectangle(F.lit(0), F.lit(1), F.lit(0), F.lit(1)).alias("own"), nothing.alias("opened")))
    folded = F.aggregate(F.sequence(F.col("__zoom"), F.lit(1), F.lit(-1)), start, level, lambda s: s["levels"])
    given = targets.select(key, z0.alias("__zoom"), *[F.col(f"block_{c}").cast("long").alias(n) for c, n in (("x", "__x"), ("width", "__wide"), ("y", "__y"), ("height", "__tall"))])
    there = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in given.columns[2:]])
    levels = given.withColumn("l", F.explode(F.when(F.col("__zoom") > 0, F.when(there, folded)).otherwise(root))).select(key, *given.columns[1:], "l.*")
    split = F.when(F.col("__zoom") > 0, 2).otherwise(1)
    span = lambda first, many: F.when(many > 0, F.sequence(first * split, (first + many) * split - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = levels.withColumn("y", F.explode(span(F.col("own.y"), F.col("own.tall"))))
    out = rows.withColumn("c", F.explode(span(F.col("own.x"), F.col("own.wide")))).withColumn("x", F.pmod("c", geo.width("z")))
    within = lambda x, wide, y, tall: (F.pmod(F.col("x") - x, geo.width("z")) < wide) & (F.col("y") >= y) & (F.col("y") < y + tall)
    opened = F.col("opened")
    leaves = out.filter(~within(opened["x"], opened["wide"], opened["y"], opened["tall"]))
    finest = (F.col("z") == F.col("__zoom")) & within(F.col("__x"), F.col("__wide"), F.col("__y"), F.col("__tall"))
    return leaves.select(key, "z", "x", "y", F.when(finest, "finest").otherwise("outer").alias("role"))


def replacement_groups(old: DataFrame, new: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, group_z, group_x, group_y, side, z, x, y): the least regions in which one cut has a leaf where the other is finer.

    Both cuts of a plan of up to PLAN_TILES tiles meet in one task, so that a tile moves once and the tiles above it never do; larger plans are joined. old and new are read twice.
    """
    on = [key, *TILE]
    side = lambda df, s: df.select(*on, F.lit(s).alias("side")).filter(F.col(key).isNotNull() & (F.col("z") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull())
    a, b = side(old, "before"), side(new, "after")
    small, large = _by_size(a.unionByName(b), key, PLAN_TILES)
    groups = _in_tasks(small, key, ["side", *TILE], {f"group_{c}": c for c in TILE} | {"side": "side"} | {c: c for c in TILE}, _regions)
    if large is None:
        return groups
    return groups.unionByName(_groups_by_joins(a.join(large.hint("merge"), key, "left_semi"), b.join(large.hint("merge"), key, "left_semi"), key))


def _regions(rows: list[tuple]) -> list[tuple]:
    """The members of one plan's groups, of its tiles (side, z, x, y)."""
    tiles = {"before": set(), "after": set()}
    for side, *tile in rows:
        tiles[side].add(tuple(tile))
    gone, come = tiles["before"] - tiles["after"], tiles["after"] - tiles["before"]
    out = []
    for side, fine, other, coarse in (("after", come, "before", gone), ("before", gone, "after", come)):
        zooms, groups = sorted({z for z, _, _ in coarse}), set()
        for z, x, y in fine:
            for g in zooms:
                if g >= z:
                    break
                above = (g, x >> (z - g), y >> (z - g))
                if above in coarse:
                    groups.add(above)
                    out.append((*above, side, z, x, y))
        out += [(*g, other, *g) for g in groups]
    return sorted(out)  # what is alike lies together in the files of a cut


def _groups_by_joins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """replacement_groups of plans of any size, in which a tile meets all above it.

    Its joins are merges: tiles shrink so much in a shuffle that Spark would take tables of hundreds of megabytes for small enough to go through the driver.
    """
    on = [key, *TILE]
    a, b = old.select(*on).distinct(), new.select(*on).distinct()
    gone, come = a.join(b.hint("merge"), on, "left_anti"), b.join(a.hint("merge"), on, "left_anti")

    def under(fine: DataFrame, coarse: DataFrame) -> DataFrame:
        at = with_ancestors(fine)
        holds = coarse.select(key, F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        return at.join(holds.hint("merge"), [key, "az", "ax", "ay"]).select(key, F.col("az").alias("group_z"), F.col("ax").alias("group_x"), F.col("ay").alias("group_y"), *TILE)

    split, merged = under(come, gone).withColumn("side", F.lit("after")), under(gone, come).withColumn("side", F.lit("before"))
    group = ["group_z", "group_x", "group_y"]
    regions = lambda df: df.select(key, *group).distinct().withColumns({c: F.col(f"group_{c}") for c in TILE})
    whole = regions(split).withColumn("side", F.lit("before")).unionByName(regions(merged).withColumn("side", F.lit("after")))
    return split.unionByName(merged).unionByName(whole).select(key, *group, "side", *TILE)


def _group(alias: str) -> Column:
    return F.concat_ws("/", "group_z", "group_x", "group_y").alias(alias)


def group_dependencies(members: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, a, b): group a can't come before group b, as a new tile of a would touch an old tile of b more than one zoom away.

    A plan of up to PLAN_TILES members is settled in one task, larger ones by joins of touching tiles. members is read twice.
    """
    sound = members.filter(F.col(key).isNotNull() & F.col("side").isin("before", "after") & (F.col("z") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull())
    small, large = _by_size(sound, key, PLAN_TILES)
    found = _in_tasks(small, key, ["side", *TILE, _group("g")], {"a": None, "b": None}, _steep)
    return found if large is None else found.unionByName(_dependencies_by_joins(sound.join(large.hint("merge"), key, "left_semi"), key))


def _steep(rows: list[tuple]) -> set[tuple[str, str]]:
    """The edges of one plan, of its members (side, z, x, y, group). A fine tile looks two zooms up and more, under itself and under the tiles around it that have other parents."""
    groups = {"before": {}, "after": {}}
    for side, z, x, y, group in rows:
        groups[side].setdefault((z, x, y), set()).add(group)
    edges = set()
    for fine, coarse in (("after", "before"), ("before", "after")):
        zooms = sorted({z for z, _, _ in groups[coarse]})
        for (z, x, y), own in groups[fine].items():
            w = 1 << z
            beside, below = (x + 1 if x & 1 else x - 1) % w, y + 1 if y & 1 else y - 1
            for g in zooms:
                up = z - g
                if up < 2:
                    break
                columns, lines = {x >> up, beside >> up}, {y >> up, below >> up} if 0 <= below < w else {y >> up}
                for c in columns:
                    for r in lines:
                        there = groups[coarse].get((g, c, r))
                        if there:
                            edges.update((a, b) if fine == "after" else (b, a) for a in own for b in there if a != b)
    return edges


def _dependencies_by_joins(members: DataFrame, key: str) -> DataFrame:
    """group_dependencies of plans of any size."""
    after, before = members.filter("side = 'after'"), members.filter("side = 'before'")
    steep = touching_tiles(after, before, [key]).filter(F.abs(F.col("z") - F.col("other_z")) > 1)
    a = after.select(key, *TILE, _group("a")).distinct()
    b = before.select(key, *[F.col(c).alias(f"other_{c}") for c in TILE], _group("b")).distinct()
    return steep.join(a.hint("merge"), [key, *TILE]).join(b.hint("merge"), [key, "other_z", "other_x", "other_y"]).filter("a <> b").select(key, "a", "b").distinct()


#: Tables of longer walks are made as long as they have at most so many times the rows of the edges.
WALK_ROWS = 8


def _walks(edges: DataFrame, key: str) -> list[DataFrame]:
    """Who leads to whom in exactly 1, 2, 4, ... edges (key, a, b), each table made of the one before by joining it with itself.

    They end with an empty one if no circle is there, else where twice the steps are more than a plan has nodes, or where tables don't get smaller any more or hold over WALK_ROWS times the edges.
    """
    walks = [checkpoint(edges.select(key, "a", "b").distinct())]
    nodes = walks[0].select(key, F.explode(F.array("a", "b")).alias("node")).distinct().groupBy(key).count().agg(F.max("count")).first()[0] or 0
    before, steps, grown = walks[0].count(), 1, 0
    limit = WALK_ROWS * before
    while steps < nodes and grown < 2:
        last = walks[-1]
        longer = checkpoint(last.join(last.select(key, F.col("a").alias("b"), F.col("b").alias("__to")).hint("merge"), [key, "b"]).select(key, "a", F.col("__to").alias("b")).distinct())
        rows, steps = longer.count(), 2 * steps
        walks.append(longer)
        grown, before = grown + (rows >= before), rows
        if rows == 0 or rows > limit:
            break
    return walks


def _reached(start: DataFrame, walks: list[DataFrame], key: str, node: str) -> DataFrame:
    """The rows (key, node) of start and all that edges lead to from them.

    After the table of n steps all is found that lies less than 2n steps away, so the number of rounds grows with the logarithm of the distance; the last table is
    used until it finds no more.
    """
    found, k = checkpoint(start), 0
    while True:
        steps = walks[min(k, len(walks) - 1)].select(key, F.col("a").alias(node), F.col("b").alias("__to"))
        more = found.join(steps.hint("merge"), [key, node]).select(key, F.col("__to").alias(node)).distinct().join(found.hint("merge"), [key, node], "left_anti")
        fresh = checkpoint(more)
        if k >= len(walks) - 1 and fresh.isEmpty():
            return found
        found, k = checkpoint(found.unionByName(fresh)), k + 1


def _least_from(nodes: DataFrame, walks: list[DataFrame], key: str, source: str, to: str) -> DataFrame:
    """(key, node, label): the least node of those that lead to each node along walks from ``source`` to ``to``, itself included."""
    labels, k = nodes.select(key, "node", F.col("node").alias("label")), 0
    while True:
        steps = walks[min(k, len(walks) - 1)].select(key, F.col(source).alias("node"), F.col(to).alias("__to"))
        led = labels.join(steps.hint("merge"), [key, "node"]).groupBy(key, F.col("__to").alias("node")).agg(F.min("label").alias("__led"))
        lower = F.coalesce(F.col("__led") < F.col("label"), F.lit(False))
        new = checkpoint(labels.join(led.hint("merge"), [key, "node"], "left").select(key, "node", F.when(lower, F.col("__led")).otherwise(F.col("label")).alias("label"), lower.alias("__moved")))
        labels, k = new.select(key, "node", "label"), k + 1
        if new.filter("__moved").isEmpty():
            return labels


#: A plan of at most so many edges, or tiles, is settled in one task, so that no table of walks or of tiles and all above them is made; larger ones go round by round.
PLAN_EDGES = 1 << 16
PLAN_TILES = 1 << 16


def _by_size(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of plans of up to ``most``, and the keys of the larger ones, if there are any."""
    large = checkpoint(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(key))
    return (rows, None) if large.isEmpty() else (rows.join(large.hint("merge"), key, "left_anti"), large)


def _in_tasks(rows: DataFrame, key: str, given: list[Column | str], out: dict[str, str | None], solve: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """(key, out): what solve makes of the given columns of each key's rows. out has the given column whose type a column takes, or None for text. One key's rows are held at a time."""
    moved = rows.repartition(key).select(key, *given)
    schema = StructType([moved.schema[key], *[StructField(n, moved.schema[c].dataType if c else StringType()) for n, c in out.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = [], []
        plain = lambda c: not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_string(c.type))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], [key, *out])

        def each() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(c).type if c else pa.string() for c in (key, *out.values())]
                yield from zip(*[c.to_numpy(zero_copy_only=False).tolist() if plain(c) else c.to_pylist() for c in batch.columns], strict=True)

        for k, group in itertools.groupby(each(), lambda r: r[0]):
            held += [(k, *r) for r in solve([r[1:] for r in group])]
            if len(held) > 10_000:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return moved.sortWithinPartitions(key).mapInArrow(run, schema)


def _circles(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, least node of its circle) of all nodes in circles: Tarjan's strongly connected components, without recursion."""
    onward: dict[str, list[str]] = {}
    for a, b in edges:
        if a is not None and b is not None:
            onward.setdefault(a, []).append(b)
    number, low, path, on_path, out = {}, {}, [], set(), []
    for root in onward:
        if root in number:
            continue
        work = [(root, iter(onward[root]))]
        number[root] = low[root] = len(number)
        path.append(root)
        on_path.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    path.append(to)
                    on_path.add(to)
                    work.append((to, iter(onward.get(to, ()))))
                    break
                if to in on_path:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    circle = [path.pop()]
                    while circle[-1] != node:
                        circle.append(path.pop())
                    on_path.difference_update(circle)
                    if len(circle) > 1:
                        least = min(circle)
                        out += [(n, least) for n in circle]
    return out


def _followed(rows: list[tuple[str, str | None]]) -> list[tuple[str]]:
    """All that edges (a, b) lead to from the rows (a, null), and those."""
    onward: dict[str, list[str]] = {}
    for a, b in rows:
        if b is not None:
            onward.setdefault(a, []).append(b)
    todo = list({a for a, b in rows if b is None})
    seen = set(todo)
    while todo:
        fresh = {b for b in onward.get(todo.pop(), ()) if b not in seen}
        seen |= fresh
        todo += fresh
    return [(n,) for n in seen]


def atomic_batches(members: DataFrame, edges: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, node, batch): groups that depend on each other in a circle share a batch, named by its least group.

    A plan of up to PLAN_EDGES edges is settled in one task, larger ones by tables of walks.
    """
    nodes = members.select(key, _group("node")).distinct()
    small, large = _by_size(edges, key, PLAN_EDGES)
    found = _in_tasks(small, key, ["a", "b"], {"node": None, "batch": None}, _circles)
    if large is not None:
        found = found.unionByName(_circles_by_walks(edges.join(large.hint("merge"), key, "left_semi"), key))
    return nodes.join(found.hint("merge"), [key, "node"], "left").select(key, "node", F.coalesce("batch", "node").alias("batch"))


def _circles_by_walks(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, batch) of all nodes in circles.

    Walks of doubling length come first: who has none of the longest ones, in or out, is in no circle. Each other node takes the least node that leads to it and the least one
    that it leads to. Where both are one, the node is in a circle with it. Of the others, only those who have both in common can share one, so edges and walks between them
    stay, and go round again. Rows are nodes and walks.
    """
    tables = _walks(edges, key)
    rest = checkpoint(tables[-1].select(key, F.col("a").alias("node")).intersect(tables[-1].select(key, F.col("b").alias("node"))).withColumn("__of", F.lit(0)))
    walks, circles = functools.reduce(DataFrame.unionByName, [w.withColumn("__k", F.lit(k)) for k, w in enumerate(tables)]), []
    while not rest.isEmpty():
        a, b = (rest.select(key, F.col("node").alias(c), F.col("__of").alias(f"__{c}")) for c in "ab")
        walks = checkpoint(walks.join(a.hint("merge"), [key, "a"]).join(b.hint("merge"), [key, "b"]).filter("__a = __b").select(key, "a", "b", "__k"))
        parts = [walks.filter(F.col("__k") == k) for k in range(len(tables))]
        held = parts[0].select(key, F.explode(F.array("a", "b")).alias("node")).distinct()
        down, up = _least_from(held, parts, key, "a", "b"), _least_from(held, parts, key, "b", "a")
        ends = checkpoint(down.join(up.select(key, "node", F.col("label").alias("up")).hint("merge"), [key, "node"]))
        circles.append(ends.filter("label = up").select(key, "node", F.col("label").alias("batch")))
        rest = ends.filter("label <> up").select(key, "node", F.struct("label", "up").alias("__of"))
    none = edges.select(key, F.col("a").alias("node"), F.col("b").alias("batch")).limit(0)
    return functools.reduce(DataFrame.unionByName, circles, none)


def batch_dependencies(batches: DataFrame, edges: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, batch, depends_on)."""
    a = batches.select(key, F.col("node").alias("a"), "batch")
    b = batches.select(key, F.col("node").alias("b"), F.col("batch").alias("depends_on"))
    return edges.join(a.hint("merge"), [key, "a"]).join(b.hint("merge"), [key, "b"]).filter("batch <> depends_on").select(key, "batch", "depends_on").distinct()


def dependency_closure(seeds: DataFrame, dependencies: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, batch): the seeds and all they depend on. A plan of up to PLAN_EDGES dependencies is followed in one task, larger ones by tables of walks."""
    edges = checkpoint(dependencies.select(key, F.col("batch").alias("a"), F.col("depends_on").alias("b")).filter(F.col(key).isNotNull() & F.col("b").isNotNull()))
    start = seeds.select(key, F.col("batch").alias("a"), F.lit(None).cast("string").alias("b"))
    small, large = _by_size(edges, key, PLAN_EDGES)
    if large is None:
        return _in_tasks(small.unionByName(start), key, ["a", "b"], {"batch": None}, _followed)
    start = checkpoint(start)
    near = _in_tasks(small.unionByName(start.join(large.hint("merge"), key, "left_anti")), key, ["a", "b"], {"batch": None}, _followed)
    walks = _walks(edges.join(large.hint("merge"), key, "left_semi"), key)
    return near.unionByName(_reached(start.join(large.hint("merge"), key, "left_semi").select(key, F.col("a").alias("batch")).distinct(), walks, key, "batch"))


def ready_batches(batches: DataFrame, dependencies: DataFrame, members: DataFrame, requirements: DataFrame, key: str = "cut_id") -> DataFrame:
    """(key, batch): without a dependency, and all new tiles ready or known to be missing. requirements: (key, z, x, y, state)."""
    after = members.filter("side = 'after'").select(key, _group("node"), *TILE)
    state = requirements.select(key, *TILE, "state")
    done = F.coalesce(F.col("state").isin("ready", "missing"), F.lit(False))
    # a group's tiles are counted up before its batch is looked up, so that tiles meet their states and move no more
    groups = after.join(state.hint("merge"), [key, *TILE], "left").groupBy(key, "node").agg(F.bool_and(done).alias("done"))
    all_done = groups.join(batches.hint("merge"), [key, "node"]).groupBy(key, "batch").agg(F.bool_and("done").alias("done")).filter("done")
    return all_done.join(dependencies.select(key, "batch").distinct().hint("merge"), [key, "batch"], "left_anti").select(key, "batch")


def change_summary(old: DataFrame, new: DataFrame, members: DataFrame, batches: DataFrame, requirements: DataFrame, key: str = "cut_id") -> DataFrame:
    """One row for each plan: tiles committed, requested and retained, groups, batches, requirements by state, blocking, complete."""
    on = [key, *TILE]
    names = ["committed", "requested", "retained", "groups", "batches", "state_requested", "state_in_flight", "state_ready", "state_failed"]
    counts = lambda df, **of: df.groupBy(key).agg(*[of.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    # both cuts meet in one grouping, and what is counted by plan in another, so that no tables are joined
    side = lambda df, o: df.select(*on, F.lit(o).alias("o"), F.lit(1 - o).alias("n"))
    tiles = side(old, 1).unionByName(side(new, 0)).groupBy(*on).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    state = lambda s: F.count_if(F.col("state") == s)
    parts = [
        counts(tiles, committed=F.sum("o"), requested=F.sum("n"), retained=F.sum(F.col("o") * F.col("n"))),
        counts(members.select(key, _group("g")).distinct(), groups=F.count(F.lit(1))),
        counts(batches, batches=F.count_distinct("batch")),
        counts(requirements, state_requested=state("requested"), state_in_flight=state("in-flight"), state_ready=state("ready"), state_failed=state("failed")),
    ]
    out = functools.reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    blocking = F.col("state_requested") + F.col("state_in_flight") + F.col("state_failed")
    same = (F.col("committed") == F.col("retained")) & (F.col("requested") == F.col("retained"))
    return out.withColumns({"blocking": blocking, "complete": same & (F.col("groups") == 0) & (F.col("batches") == 0)})
