"""Points, tiles and cuts. A cut is a set of tiles (cut_id, z, x, y) that should cover the world once; tiles join on three integers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geo

TILE = ["z", "x", "y"]


def assign_tiles(points: DataFrame, zooms: list[int], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with the tile they lie in, one row for each zoom."""
    at = points.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    return at.withColumns({"x": geo.tile_x(lon, "z"), "y": geo.tile_y(lat, "z")})


def with_tile_bounds(tiles: DataFrame) -> DataFrame:
    """Edges in degrees, the centre's place in a world texture, and the share of the world map."""
    w = geo.width("z")
    north, south = F.degrees(geo.north_edge(F.col("y"), "z")), F.degrees(geo.north_edge(F.col("y") + 1, "z"))
    west, east = F.col("x") / w * 360.0 - 180.0, (F.col("x") + 1) / w * 360.0 - 180.0
    return tiles.withColumns({"west": west, "east": east, "north": north, "south": south, "centre_u": (F.col("x") + 0.5) / w, "centre_v": (F.col("y") + 0.5) / w, "area": F.pow(F.lit(4.0), -F.col("z"))})


def map_to_source_tiles(tiles: DataFrame, max_source_zoom: int) -> DataFrame:
    """The tile's ancestor at the source's deepest zoom, with the factor and place of the tile in it."""
    z = F.least(F.col("z"), F.lit(max_source_zoom))
    up = F.col("z") - z
    x, y = geo.ancestor("x", up), geo.ancestor("y", up)
    scale = geo.width(up)
    fields = {"source_z": z, "source_x": x, "source_y": y, "scale": scale, "offset_x": F.col("x") - x * scale, "offset_y": F.col("y") - y * scale}
    return tiles.withColumn("source", F.struct(*[v.alias(k) for k, v in fields.items()]))


def observer_zoom(observers: DataFrame, density: float = 1.0, height: str = "height_m", lat: str = "lat", focal: str = "focal_px", tile: str = "tile_px", cap: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(observers with continuous_zoom and zoom, rejects): the zoom whose pixels match the screen's under the observer."""
    sound = geo.finite(lat)
    for c in (height, focal, tile):
        sound = sound & geo.finite(c) & (F.col(c) > 0)
    rad = geo.clamp(F.radians(F.col(lat)), -math.pi / 2, math.pi / 2)
    ratio = 2 * math.pi * F.cos(rad) * F.col(focal) / (F.col(tile) * (F.col(height) / (geo.EARTH_RADIUS_KM * 1000)) * density)
    zoom = F.greatest(F.lit(0).cast("long"), geo.half_up("continuous_zoom"))
    zoom = F.least(zoom, F.greatest(F.lit(0).cast("long"), F.floor(cap))) if cap else zoom
    sound = F.coalesce(sound, F.lit(False))
    return observers.filter(sound).withColumn("continuous_zoom", F.log2(ratio)).withColumn("zoom", zoom), observers.filter(~sound)


def clean_coordinates(df: DataFrame, mode: str = "strict", lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). strict: outside +-90 or +-180 is rejected; normalise: latitude clamped, longitude wrapped, what isn't finite is 0."""
    if mode == "normalise":
        zero = lambda c: F.when(geo.finite(c), F.col(c).cast("double")).otherwise(0.0)
        return df.withColumns({lat: geo.clamp(zero(lat), -90.0, 90.0), lon: geo.wrap_longitude(zero(lon))}), df.limit(0)
    good = F.coalesce(geo.finite(lat) & geo.finite(lon) & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180), F.lit(False))
    return df.filter(good), df.filter(~good)


def first_valid_place(df: DataFrame, candidates: dict[str, tuple[str, str]]) -> DataFrame:
    """place struct<lat, lon, source>: the first of the labelled (lat, lon) columns that is valid, else 0, 0 from ``fallback``."""
    tried = []
    for label, (lat, lon) in candidates.items():
        good = geo.finite(lat) & geo.finite(lon) & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
        tried.append(F.when(good, F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.lit(label).alias("source"))))
    return df.withColumn("place", F.coalesce(*tried, F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("fallback").alias("source"))))


def canonical_order(cut: DataFrame) -> DataFrame:
    return cut.orderBy("z", "y", "x")


def work_order(work: DataFrame, first: int | None = None, provider: str | None = None) -> DataFrame:
    """Deepest first, then by row and column; with ``first``, that many of all or, with their ``turn``, of each provider."""
    order = [F.col("z").desc(), F.col("y"), F.col("x")]
    if first is None:
        return work.orderBy(*order)
    if provider is None:
        return work.orderBy(*order).limit(first)
    w = Window.partitionBy(provider).orderBy(*order)
    return work.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= first)


def fetch_order(fetches: DataFrame, limits: dict[str, int] | None = None, provider: str = "provider", keys: list[str] | None = None) -> DataFrame:
    """Fetches by falling priority, then by rising sequence. limits: how many each provider may run at a time; only these are kept, with their
    ``turn``, for each of ``keys`` and each provider. A provider without a limit starts nothing; a null priority comes last.

    The largest limit is known while planning, so each partition passes on that many rows of a provider at most, whatever its length.
    """
    order = [F.col("priority").desc_nulls_last(), F.col("sequence")]
    if limits is None:
        return fetches.orderBy(*order)
    if not limits:
        return fetches.withColumn("turn", F.lit(0)).limit(0)
    own = F.coalesce(*[F.when(F.col(provider) == name, F.lit(k)) for name, k in limits.items()])
    first = fetches.withColumn("turn", F.row_number().over(Window.partitionBy(*(keys or []), provider).orderBy(*order))).filter(F.col("turn") <= max(limits.values()))
    return first.filter(F.col("turn") <= own)


def with_ancestors(tiles: DataFrame, own: bool = True) -> DataFrame:
    """A row for each tile above (and for the tile itself): az, ax, ay."""
    up = F.sequence(F.lit(0), F.col("z").cast("int")) if own else F.when(F.col("z") > 0, F.sequence(F.lit(1), F.col("z").cast("int"))).otherwise(F.array().cast("array<int>"))
    out = tiles.withColumn("__up", F.explode(up))
    return out.withColumns({"az": F.col("z") - F.col("__up"), "ax": geo.ancestor("x", F.col("__up")), "ay": geo.ancestor("y", F.col("__up"))}).drop("__up")


def deepest_covering_tile(points: DataFrame, cut: DataFrame, max_zoom: int, keys: list[str] | None = None, lat: str = "lat", lon: str = "lon", point_id: list[str] | None = None) -> DataFrame:
    """Points with the tile of the cut that contains them (null beyond the map). keys: columns that choose the cut.

    An equi-join: a point emits its tile at each zoom that the cut has. In a valid cut one of them matches; in any other ``point_id`` names
    a point, and the deepest of its matches is taken.
    """
    keys = keys or []
    on_map = F.abs(F.col(lat)) <= geo.MAX_LATITUDE
    at = points.filter(on_map).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom)))).withColumns({"x": geo.tile_x(lon, "z"), "y": geo.tile_y(lat, "z")})
    hit = at.join(cut.select(*keys, F.col("z").cast("int").alias("z"), "x", "y").distinct(), [*keys, *TILE])
    if point_id:
        best = hit.groupBy(*keys, *point_id).agg(F.max_by(F.struct(*TILE), "z").alias("tile"))
        hit = points.filter(on_map).join(best, [*keys, *point_id]).select(*points.columns, "tile.z", "tile.x", "tile.y")
    off = points.filter(F.coalesce(~on_map, F.lit(True))).withColumns({"z": F.lit(None).cast("int"), "x": F.lit(None).cast("long"), "y": F.lit(None).cast("long")})
    return hit.select(*points.columns, *TILE).unionByName(off)


def with_covering_tile(points: DataFrame, cut: DataFrame, max_zoom: int, keys: list[str] | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with z, x, y of the deepest tile of the cut over them, null where there is none: every point stays, and a cut may have holes or overlap.

    Points in one tile of ``max_zoom`` have the same answer, so what is looked up at each zoom is such tiles, once each, however many points lie in them.
    """
    keys = keys or []
    on_map = geo.finite(lat) & geo.finite(lon) & (F.abs(F.col(lat)) <= geo.MAX_LATITUDE)
    fine = {"__fx": F.when(on_map, geo.tile_x(lon, F.lit(max_zoom))), "__fy": F.when(on_map, geo.tile_y(lat, F.lit(max_zoom)))}
    at = points.withColumns(fine)
    up = F.lit(max_zoom) - F.col("z")
    asked = at.select(*keys, *fine).filter(F.col("__fx").isNotNull()).distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))))
    asked = asked.withColumns({"x": geo.ancestor("__fx", up), "y": geo.ancestor("__fy", up)})
    hit = asked.join(cut.select(*keys, F.col("z").cast("int").alias("z"), "x", "y").distinct(), [*keys, *TILE])
    best = hit.groupBy(*keys, *fine).agg(F.max_by(F.struct(*TILE), "z").alias("__tile"))
    return at.join(best, [*keys, *fine], "left").select(*points.columns, *[F.col(f"__tile.{c}").alias(c) for c in TILE])


def touching_tiles(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs (keys, z, x, y, other_z, other_x, other_y) that share an edge or a corner; x wraps, y doesn't. Of tiles that hold each other all pairs touch but those of a tile with itself.

    No pair is tried blindly: tiles of one zoom travel as blocks of 8 x 8, a bit for each tile. A block emits the blocks that hold its tiles or their ring, at its own zoom and above, and
    meets the other side's blocks on equality; which tiles of two blocks touch is told from their bits. So a coarse tile meets the finer ones around it; with the sides swapped, and
    one zoom apart at least, a fine one the coarser ones: no pair is made twice, and nothing has to be made distinct. The joins are merges, as bits shrink too much in a shuffle to tell what they take in the driver.
    """
    keys = keys or []
    at = lambda v, up: geo.ancestor(v, up)
    place = lambda x, y: (y.bitwiseAND(F.lit(7)) * 8 + x.bitwiseAND(F.lit(7))).cast("int")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def blocks(tiles: DataFrame) -> DataFrame:
        tile = [F.col("z").cast("int").alias("__z"), F.col("x").cast("long").alias("__x"), F.col("y").cast("long").alias("__y")]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("__x"), F.col("__y")))
        return tiles.select(*keys, *tile).groupBy(*keys, "__z", at("__x", F.lit(3)).alias("__bx"), at("__y", F.lit(3)).alias("__by")).agg(F.bit_or(bit).alias("__bits"))

    def ring(df: DataFrame, x: Column, y: Column, side: int, w: Column, up: Column) -> DataFrame:
        """A row for each place (__cx, __cy), ``up`` zooms above, of the square of ``side`` tiles from (x, y) and of the tiles around it: each once."""
        west, east, north, south = F.pmod(x - 1, w), F.pmod(x + side, w), y - 1, y + side
        i, j = F.col("__d.i"), F.col("__d.j")
        column = (i == 0) | ((i < 0) & (at(west, up) != at(x, up))) | ((i > 0) & (at(east, up) != at(x, up)) & (at(east, up) != at(west, up)))
        row = (j == 0) | ((j < 0) & (north >= 0) & (at(north, up) != at(y, up))) | ((j > 0) & (south < w) & (at(south, up) != at(y, up)))
        cx, cy = F.when(i < 0, west).when(i > 0, east).otherwise(x), F.when(j < 0, north).when(j > 0, south).otherwise(y)
        return df.withColumn("__d", steps).filter(column & row).withColumns({"__cx": at(cx, up), "__cy": at(cy, up)}).drop("__d")

    def meet(fine: DataFrame, coarse: DataFrame, apart: int) -> DataFrame:
        """(keys, __fz, __x, __y) with (__z, __cx, __cy), ``apart`` zooms above at least."""
        own = blocks(fine).withColumnsRenamed({"__z": "__fz", "__bx": "__fx", "__by": "__fy", "__bits": "__own"})
        above = own.filter(F.col("__fz") >= apart).withColumn("__up", F.explode(F.sequence(F.lit(apart), F.col("__fz"))))
        asked = ring(above, F.col("__fx") * 8, F.col("__fy") * 8, 8, geo.width("__fz"), F.col("__up") + 3)
        asked = asked.select(*keys, "__fz", "__fx", "__fy", "__own", (F.col("__fz") - F.col("__up")).alias("__z"), F.col("__cx").alias("__bx"), F.col("__cy").alias("__by"))
        met = asked.join(blocks(coarse).hint("merge"), [*keys, "__z", "__bx", "__by"]).withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(F.getbit("__own", F.col("__n")) == 1)
        tiles = met.withColumns({"__x": F.col("__fx") * 8 + F.col("__n") % 8, "__y": F.col("__fy") * 8 + F.floor(F.col("__n") / 8)})
        near = ring(tiles, F.col("__x"), F.col("__y"), 1, geo.width("__fz"), F.col("__fz") - F.col("__z"))
        inside = (at("__cx", F.lit(3)) == F.col("__bx")) & (at("__cy", F.lit(3)) == F.col("__by"))
        return near.filter(inside & (F.getbit("__bits", place(F.col("__cx"), F.col("__cy"))) == 1))

    named = lambda names, cols: [F.col(c).alias(n) for n, c in zip(names, cols, strict=True)]
    own, other, low, high = TILE, [f"other_{c}" for c in TILE], ["__fz", "__x", "__y"], ["__z", "__cx", "__cy"]
    same = (F.col("__fz") == F.col("__z")) & (F.col("__x") == F.col("__cx")) & (F.col("__y") == F.col("__cy"))
    down = meet(a, b, 0).filter(~same).select(*keys, *named(own, low), *named(other, high))
    return down.unionByName(meet(b, a, 1).select(*keys, *named(own, high), *named(other, low)))


def validate_cut(cut: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, problem, z, x, y, detail): a row for each violation; none for a valid cut."""
    keys = keys or []
    none = [F.lit(None).cast("int").alias("z"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y")]
    cut = cut.select(*keys, F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    w = geo.width("z")
    good = (F.col("z") >= 0) & F.col("x").between(F.lit(0), w - 1) & F.col("y").between(F.lit(0), w - 1)
    row = lambda df, problem, detail: df.select(*keys, F.lit(problem).alias("problem"), *TILE, detail.cast("double").alias("detail"))
    bad = row(cut.filter(~F.coalesce(good, F.lit(False))), "address", F.lit(0.0))
    sound = cut.filter(good)
    twice = row(sound.groupBy(*keys, *TILE).count().filter("count > 1"), "duplicate", F.col("count"))
    once = sound.distinct()
    above = with_ancestors(once, own=False).select(*keys, F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    holds = row(once.join(above, [*keys, *TILE], "left_semi"), "ancestor", F.lit(0.0))
    area = once.groupBy(*keys).agg(F.sum(F.pow(F.lit(4.0), -F.col("z"))).alias("area")).filter(F.abs(F.col("area") - 1) > 1e-12)
    uncovered = area.select(*keys, F.lit("area").alias("problem"), *none, F.col("area").alias("detail"))
    steep = touching_tiles(once, once, keys).filter(F.col("other_z") - F.col("z") > 1)
    unbalanced = row(steep, "balance", F.col("other_z") - F.col("z"))
    return bad.unionByName(twice).unionByName(holds).unionByName(uncovered).unionByName(unbalanced)


def cut_statistics(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves in all and by role, depth, nodes of the tree, and a signature in canonical order; ``leaves_by_zoom`` has them by zoom."""
    leaves = cut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("leaves"),
        F.count_if(F.col("role") == "finest").alias("finest"),
        F.min("z").alias("min_zoom"),
        F.max("z").alias("max_zoom"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "y", "x"))), lambda t: F.concat_ws("/", t["z"].cast("string"), t["x"].cast("string"), t["y"].cast("string"))), " ").cast("binary")).alias("signature"),
    )
    nodes = with_ancestors(cut.select(*keys, *TILE)).select(*keys, "az", "ax", "ay").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    return leaves.join(nodes, keys)


def leaves_by_zoom(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, role, leaves, area): how many leaves each zoom and role has, and what share of the map they are."""
    return cut.groupBy(*keys, "z", "role").agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.pow(F.lit(4.0), -F.col("z"))).alias("area"))


def diff_cuts(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, z, x, y, side): retained, removed or added."""
    on = [*(keys or []), *TILE]
    a, b = old.select(*on).distinct().withColumn("__old", F.lit(True)), new.select(*on).distinct().withColumn("__new", F.lit(True))
    side = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").otherwise("retained")
    return a.join(b, on, "full_outer").select(*on, side.alias("side"))


def cuts_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same tiles."""
    return diff_cuts(a, b).agg((F.count_if(F.col("side") != "retained") == 0).alias("equal"))


def horizon_candidates(cut: DataFrame, members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The committed tiles and all that a replacement brings, once each."""
    on = [*(keys or []), *TILE]
    return cut.select(*on).unionByName(members.filter("side = 'after'").select(*on)).distinct()


def retained_sources(records: DataFrame, *in_use: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, prunable): records whose key is in any of the sets in use, and the rest."""
    used = in_use[0].select(*keys)
    for other in in_use[1:]:
        used = used.unionByName(other.select(*keys))
    used = used.distinct()
    return records.join(used, keys, "left_semi"), records.join(used, keys, "left_anti")


def gap_to_tile(lat: str = "lat", lon: str = "lon", z: str = "z", x: str = "x", y: str = "y") -> Column:
    """The haversine of the angle from a point (degrees) to the nearest place of a tile; exactly 0 for the tile that holds the point."""
    phi, w = F.radians(lat), geo.width(z)
    centre = (F.col(x) + 0.5) / w * 360.0 - 180.0
    aside = F.radians(F.greatest(F.lit(0.0), F.abs(geo.short_arc(F.col(lon), centre)) - 180.0 / w))
    # where the circle through the point meets the tile's nearer edge at a right angle, kept between the tile's rows
    best = F.when(aside == 0, phi).otherwise(F.atan2(F.sin(phi), F.cos(phi) * F.cos(aside)))
    at = geo.clamp(best, geo.north_edge(F.col(y) + 1, z), geo.north_edge(F.col(y), z))
    inside = (geo.tile_x(lon, z) == F.col(x)) & (geo.tile_y(lat, z) == F.col(y))
    return F.when(inside, 0.0).otherwise(geo.haversine(at - phi) + F.cos(phi) * F.cos(at) * geo.haversine(aside))


def horizon_gap(radius: Column, height: Column) -> Column:
    """The haversine of the angle to the horizon, from the smaller half-axis of a globe of that radius; 0 on the ground."""
    low, up = F.greatest(F.lit(0.0), radius) * (geo.WGS84_B_KM / geo.EARTH_RADIUS_KM), F.greatest(F.lit(0.0), height)
    return F.coalesce(F.try_divide(up, 2 * (low + up)), F.lit(0.0))


def with_horizon(observers: DataFrame, radius: str = "radius_m", height: str = "height_m") -> DataFrame:
    """How far the horizon is: horizon_rad and horizon_deg as angles, horizon_diameter_m across the displayed globe, horizon_source_km on the Earth. At least a millimetre of radius; no height is 0."""
    globe, up = F.greatest(F.lit(0.001), F.col(radius)), F.greatest(F.lit(0.0), F.col(height))
    angle = F.acos(globe / (globe + up))
    return observers.withColumns({"horizon_rad": angle, "horizon_deg": F.degrees(angle), "horizon_diameter_m": 2 * globe * angle, "horizon_source_km": angle * geo.EARTH_RADIUS_KM})


def tiles_within_horizon(observers: DataFrame, tiles: DataFrame, finest_cell: int = 16) -> DataFrame:
    """(observer_id, z, x, y) of tiles that the observer's horizon reaches. observers: (observer_id, lat, lon, radius_m, height_m).

    An observer's cells are the few tiles, of the zoom at which one is as wide as the horizon, that the horizon can reach. Finer tiles meet them
    through their ancestor of that zoom, coarser ones as ancestors of a cell: two joins on equality before the exact test. A null place or
    height sees nothing; the tile underfoot is always there.
    """
    seen = observers.withColumn("gap", horizon_gap(F.col("radius_m"), F.col("height_m"))).withColumn("reach", 2 * F.asin(F.sqrt("gap")))
    end = F.abs(F.radians("lat")) + F.col("reach")
    spread = F.when(end >= math.radians(geo.MAX_LATITUDE), F.lit(math.pi)).otherwise(F.asin(F.least(F.lit(1.0), F.sin("reach") / F.cos(F.radians("lat")))))
    zoom = F.when(F.col("spread") > 0, geo.clamp(F.floor(F.log2(math.pi / F.col("spread"))), 0, finest_cell)).otherwise(finest_cell)
    seen = seen.withColumn("spread", spread).withColumn("cz", zoom.cast("int")).filter("gap IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    # a little more than the reach, so that rounding at a cell's edge loses nothing
    wide, tall = F.degrees("spread") * (1 + 1e-9) + 1e-9, F.degrees("reach") * (1 + 1e-9) + 1e-9
    w = geo.width("cz")
    first, last = F.floor((F.col("lon") - wide + 180) / 360 * w), F.floor((F.col("lon") + wide + 180) / 360 * w)
    columns = F.when(last - first + 1 >= w, F.sequence(F.lit(0).cast("long"), w - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, w)))
    rows = F.sequence(geo.tile_y(F.col("lat") + tall, "cz"), geo.tile_y(F.col("lat") - tall, "cz"))
    cells = seen.withColumn("cx", F.explode(columns)).withColumn("cy", F.explode(rows)).select("observer_id", "lat", "lon", "gap", "cz", "cx", "cy")
    zooms = F.broadcast(cells.select("cz").distinct())  # at most finest_cell + 1 rows
    kept = tiles.select(*TILE).distinct()
    fine = kept.join(zooms, F.col("z") >= F.col("cz")).withColumns({"cx": geo.ancestor("x", F.col("z") - F.col("cz")), "cy": geo.ancestor("y", F.col("z") - F.col("cz"))})
    inner = cells.join(fine, ["cz", "cx", "cy"]).select("observer_id", "lat", "lon", "gap", *TILE)
    above = with_ancestors(cells.withColumnsRenamed({"cz": "z", "cx": "x", "cy": "y"}), own=False).select("observer_id", "lat", "lon", "gap", F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    outer = above.join(kept, TILE).select("observer_id", "lat", "lon", "gap", *TILE)
    return inner.unionByName(outer).filter(gap_to_tile() <= F.col("gap")).select("observer_id", *TILE).distinct()
