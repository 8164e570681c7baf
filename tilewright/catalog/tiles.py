"""Queries on points, tiles, covers and their changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import views as V
from tilewright.functions.shared import checkpoint
from tilewright.operators import tiles as T
from tilewright.plans import cover as C
from tilewright.streaming import anchors

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tile of its observer's cover each position lies in, and how many lie in each."""
    cut = C.balanced_cover(C.observer_targets(V.observers(spark, sf_dir)))
    hit = T.deepest_covering_tile(V.positions(spark, sf_dir), cut, 10, ["observer_id"])
    return hit.groupBy("observer_id", "z", "x", "y").agg(F.count(F.lit(1)).alias("positions"))


def assign_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assign_tiles(V.positions(spark, sf_dir), [3, 7, 11]).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("points"))


def _tiles(spark: SparkSession, sf_dir: str, z: int) -> DataFrame:
    return T.assign_tiles(V.positions(spark, sf_dir), [z]).select("z", "x", "y").distinct()


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.with_tile_bounds(_tiles(spark, sf_dir, 8)), "west", "east", "north", "south", "centre_u", "centre_v").withColumn("area", F.col("area") * 65536)


def source_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.map_to_source_tiles(_tiles(spark, sf_dir, 11).unionByName(_tiles(spark, sf_dir, 5)), 7).select("z", "x", "y", "source.*")


def _optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events")
    return e.select("event_id", (10 + F.col("value") * 100).alias("height_m"), (800 + F.col("event_id") % 400).alias("focal_px"), F.when(F.col("event_id") % 2 == 0, 256).otherwise(512).alias("tile_px"), ((F.col("event_id") * 7919) % 170001 / 1000.0 - 85.0).alias("lat"))


def observer_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.observer_zoom(_optics(spark, sf_dir))[0].select("event_id", "continuous_zoom", "zoom"), "continuous_zoom")


def clean_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 31 % 2001 / 10.0 - 100.0).alias("lat"), (F.col("event_id") * 17 % 4001 / 10.0 - 200.0).alias("lon"))
    good, bad = T.clean_coordinates(e)
    wrapped, _ = T.clean_coordinates(bad, "normalise")
    return rounded(good.withColumn("kind", F.lit("valid")).unionByName(wrapped.withColumn("kind", F.lit("normalised"))), "lat", "lon")


def first_valid_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 31 % 2001 / 10.0 - 100.0).alias("lat_a"), (F.col("event_id") * 17 % 4001 / 10.0 - 200.0).alias("lon_a"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 90).cast("double").alias("lat_b"), (F.col("event_id") % 180).cast("double").alias("lon_b"))
    return rounded(T.first_valid_place(e, {"device": ("lat_a", "lon_a"), "ip": ("lat_b", "lon_b")}).select("event_id", "place.*"), "lat", "lon")


def observer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.observer_targets(V.observers(spark, sf_dir)).select("observer_id", "mode", "zoom", "block_x", "block_y", F.col("block_width").alias("side"))


def finest_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finest_tiles(C.observer_targets(V.observers(spark, sf_dir)))


def _cut(spark: SparkSession, sf_dir: str, turn: int = 1) -> DataFrame:
    return C.balanced_cover(C.observer_targets(V.observers(spark, sf_dir, turn))).withColumnRenamed("observer_id", "cut_id")


def _written(spark: SparkSession, sf_dir: str, turn: int = 1) -> DataFrame:
    """The cut for what reads it more than once."""
    return checkpoint(_cut(spark, sf_dir, turn).select("cut_id", "z", "x", "y"))


def balanced_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)


def cut_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cut_statistics(checkpoint(_cut(spark, sf_dir)), ["cut_id"])


def cut_leaves_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.leaves_by_zoom(_cut(spark, sf_dir), ["cut_id"]), "area")


def horizon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each event's observer sees on a globe of its own radius."""
    e = V.read(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 15000).cast("double").alias("radius_m"), (F.col("value") - 5).alias("height_m"))
    return rounded(T.with_horizon(e).drop("radius_m", "height_m"), "horizon_rad", "horizon_deg", "horizon_diameter_m", "horizon_source_km")


def fetch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetches of each user that terrain and imagery start first: four and six at a time."""
    e = V.read(spark, sf_dir, "events")
    asked = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "terrain").when(F.col("event_id") % 5 > 0, "imagery").otherwise("other").alias("provider"), (F.col("event_id") * 7919 % 13).alias("priority"), F.col("event_id").alias("sequence"))
    return T.fetch_order(asked, {"terrain": 4, "imagery": 6}, keys=["user_id"])


def anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observers that wander about a place of their own, some of them over the seam and beyond the map's edges: where their blocks stand after each move."""
    e = V.read(spark, sf_dir, "events")
    lat = (F.col("user_id") * 7919 % 177 - 88) + (F.col("event_id") * 31 % 997) / 997.0
    lon = (F.col("user_id") * 104729 % 361 - 180) + (F.col("event_id") * 17 % 983) / 983.0 * 12
    moves = e.select(F.col("user_id").alias("observer_id"), F.col("event_id").alias("ts"), lat.alias("lat"), lon.alias("lon"), (7 + F.col("user_id") % 3).cast("int").alias("max_zoom"), (200.0 + F.col("event_id") * 13 % 100).alias("target_m"))
    return rounded(anchors.anchor_targets(moves), "held_lon")


def validate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covers, each with some tiles taken out, one doubled and one split deep: what is wrong with them."""
    cut = _written(spark, sf_dir)
    broken = cut.filter((F.col("x") + 3 * F.col("y") + F.col("z")) % 29 != 0)
    twice = cut.filter((F.col("x") + F.col("y")) % 31 == 1)
    deep = cut.filter((F.col("x") * 5 + F.col("y")) % 37 == 2).select("cut_id", (F.col("z") + 2).alias("z"), (F.col("x") * 4).alias("x"), (F.col("y") * 4).alias("y"))
    found = T.validate_cut(checkpoint(broken.unionByName(twice).unionByName(deep)), ["cut_id"])
    return found.groupBy("cut_id", "problem").agg(F.count(F.lit(1)).alias("found"), F.round(F.max("detail"), 6).alias("worst"))


def deepest_covering_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.balanced_cover(C.observer_targets(V.observers(spark, sf_dir)))
    return T.deepest_covering_tile(V.positions(spark, sf_dir), cut, 10, ["observer_id"]).select("id", "observer_id", "z", "x", "y")


def horizon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _written(spark, sf_dir, 2)
    return T.horizon_candidates(old, C.replacement_groups(old, _written(spark, sf_dir)), ["cut_id"])


def diff_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.diff_cuts(_cut(spark, sf_dir, 2), _cut(spark, sf_dir), ["cut_id"])


def retained_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    used = V.read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    also = V.read(spark, sf_dir, "lineitem").filter("l_discount = 0").select(F.col("l_partkey").alias("key"))
    kept, rest = T.retained_sources(records, used, also, keys=["key"])
    return kept.withColumn("kept", F.lit(True)).unionByName(rest.withColumn("kept", F.lit(False)))


def cuts_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _cut(spark, sf_dir, 2).select("z", "x", "y").distinct(), _cut(spark, sf_dir).select("z", "x", "y").distinct()
    return T.cuts_equal(a, b)


def touching_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _written(spark, sf_dir)
    return T.touching_tiles(cut, cut, ["cut_id"]).groupBy("cut_id", "z", "x", "y").agg(F.count(F.lit(1)).alias("touching"))


def tiles_within_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = V.observers(spark, sf_dir).select("observer_id", "lat", "lon", F.lit(1000.0).alias("radius_m"), (F.col("observer_id") % 40 * 2.5).alias("height_m"))
    return T.tiles_within_horizon(seen, _tiles(spark, sf_dir, 2).unionByName(_tiles(spark, sf_dir, 5)))


def replacement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replacement_groups(_written(spark, sf_dir, 2), _written(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str, old: DataFrame | None = None, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, edges and batches of the change, each written once, as all steps behind them read them more than once. old, new: the cuts, where they are written already."""
    members = checkpoint(replacement_groups(spark, sf_dir) if old is None else C.replacement_groups(old, new))
    edges = checkpoint(C.group_dependencies(members))
    return members, edges, checkpoint(C.atomic_batches(members, edges))


def group_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_dependencies(checkpoint(replacement_groups(spark, sf_dir)))


def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[2]


def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, batches = _plan(spark, sf_dir)
    seeds = batches.filter(F.length("batch") % 3 == 0).select("cut_id", "batch").distinct()
    return C.dependency_closure(seeds, C.batch_dependencies(batches, edges))


def _requirements(members: DataFrame) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("ready", "ready", "requested", "ready", "in-flight", "failed", "missing", "ready")])
    return members.filter("side = 'after'").select("cut_id", "z", "x", "y").distinct().withColumn("state", F.element_at(states, (1 + (F.col("x") + F.col("y")) % 8).cast("int")))


def ready_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, edges, batches = _plan(spark, sf_dir)
    return C.ready_batches(batches, C.batch_dependencies(batches, edges), members, _requirements(members))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _written(spark, sf_dir, 2), _written(spark, sf_dir)
    members, _, batches = _plan(spark, sf_dir, old, new)
    return C.change_summary(old, new, members, batches, _requirements(members))


def work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four tiles of each cut to fetch."""
    return T.work_order(_cut(spark, sf_dir), 4, "cut_id").select("cut_id", "z", "x", "y", F.col("turn").cast("int").alias("turn"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.canonical_order(_tiles(spark, sf_dir, 4))


QUERIES: dict[str, Query] = {f.__name__: f for f in (flagship, assign_tiles, tile_bounds, source_tiles, observer_zoom, clean_coordinates, first_valid_place, observer_targets, finest_tiles, balanced_cover, cut_statistics, cut_leaves_by_zoom, horizon_measures, fetch_order, anchor_targets, validate_cut, deepest_covering_tile, horizon_candidates, diff_cuts, retained_sources, cuts_equal, touching_tiles, tiles_within_horizon, replacement_groups, group_dependencies, atomic_batches, dependency_closure, ready_batches, change_summary, work_order, canonical_order)}

_COVER = f"WITH RECURSIVE {V.FINEST},\n{V.cover_sql()}"
_TWO = f"WITH RECURSIVE {V.two_covers_sql()}"
_GROUPS = """,
gone AS (SELECT * FROM old_cut ANTI JOIN new_cut USING (cut_id, z, x, y)),
come AS (SELECT * FROM new_cut ANTI JOIN old_cut USING (cut_id, z, x, y)),
parted AS (SELECT c.cut_id, g.z AS group_z, g.x AS group_x, g.y AS group_y, c.z, c.x, c.y FROM come c JOIN gone g ON c.cut_id = g.cut_id AND c.z >= g.z AND c.x >> (c.z - g.z) = g.x AND c.y >> (c.z - g.z) = g.y),
merged AS (SELECT g.cut_id, c.z AS group_z, c.x AS group_x, c.y AS group_y, g.z, g.x, g.y FROM gone g JOIN come c ON c.cut_id = g.cut_id AND g.z >= c.z AND g.x >> (g.z - c.z) = c.x AND g.y >> (g.z - c.z) = c.y),
members AS (
  SELECT cut_id, group_z, group_x, group_y, 'after' AS side, z, x, y FROM parted UNION ALL SELECT cut_id, group_z, group_x, group_y, 'before', z, x, y FROM merged
  UNION ALL SELECT DISTINCT cut_id, group_z, group_x, group_y, 'before', group_z, group_x, group_y FROM parted
  UNION ALL SELECT DISTINCT cut_id, group_z, group_x, group_y, 'after', group_z, group_x, group_y FROM merged)"""


def _touch(a: str, b: str) -> str:
    """Whether the closed rectangles of two tiles meet, in units of the finest zoom there is, the world being a ring."""
    span = lambda t, c: (f"({t}.{c} << (12 - {t}.z))", f"(({t}.{c} + 1) << (12 - {t}.z))")
    (al, ah), (bl, bh), (cl, ch), (dl, dh) = span(a, "x"), span(b, "x"), span(a, "y"), span(b, "y")
    ring = " OR ".join(f"({al} <= {bh} + {k} AND {bl} + {k} <= {ah})" for k in (-4096, 0, 4096))
    return f"({ring}) AND {cl} <= {dh} AND {dl} <= {ch}"


_EDGES = f"""{_GROUPS},
named AS (SELECT *, concat_ws('/', group_z, group_x, group_y) AS g FROM members),
edges AS (SELECT DISTINCT a.cut_id, a.g AS a, b.g AS b FROM named a JOIN named b ON a.cut_id = b.cut_id AND a.side = 'after' AND b.side = 'before' AND a.g <> b.g AND abs(a.z - b.z) > 1 AND {_touch('a', 'b')}),
paths AS (SELECT * FROM edges UNION SELECT p.cut_id, p.a, e.b FROM paths p JOIN edges e ON p.cut_id = e.cut_id AND p.b = e.a),
circle AS (SELECT p.cut_id, p.a AS node, min(p.b) AS least FROM paths p JOIN paths q ON p.cut_id = q.cut_id AND p.a = q.b AND p.b = q.a GROUP BY ALL),
batches AS (SELECT n.cut_id, n.g AS node, least(n.g, coalesce(c.least, n.g)) AS batch FROM (SELECT DISTINCT cut_id, g FROM named) n LEFT JOIN circle c ON n.cut_id = c.cut_id AND n.g = c.node),
depends AS (SELECT DISTINCT e.cut_id, a.batch, b.batch AS depends_on FROM edges e JOIN batches a ON e.cut_id = a.cut_id AND e.a = a.node JOIN batches b ON e.cut_id = b.cut_id AND e.b = b.node WHERE a.batch <> b.batch),
after AS (SELECT DISTINCT cut_id, g, z, x, y, ['ready', 'ready', 'requested', 'ready', 'in-flight', 'failed', 'missing', 'ready'][1 + (x + y) % 8] AS state FROM named WHERE side = 'after')"""
_AT8 = f"SELECT DISTINCT 8 AS z, {V.tx(z='8')} AS x, {V.ty(z='8')} AS y FROM positions"
_LATLON = "event_id * 31 % 2001 / 10.0::DOUBLE - 100.0::DOUBLE AS lat_a, event_id * 17 % 4001 / 10.0::DOUBLE - 200.0::DOUBLE AS lon_a"

_SHIFT = "CASE WHEN {i} BETWEEN 1 AND 6 THEN 0 WHEN {i} < 1 THEN {i} - 4 ELSE {i} - 3 END"
#: One step of all observers after another; what doesn't depend on the step before is in m.
_ANCHORS = f"""WITH RECURSIVE e AS (SELECT user_id AS observer_id, event_id AS ts, (user_id * 7919 % 177 - 88) + (event_id * 31 % 997) / 997.0::DOUBLE AS lat,
  (user_id * 104729 % 361 - 180) + (event_id * 17 % 983) / 983.0::DOUBLE * 12 AS east, 7 + user_id % 3 AS z, 200.0::DOUBLE + event_id * 13 % 100 AS target FROM events),
o AS (SELECT *, CASE WHEN east >= 180 THEN east - 360 ELSE east END AS lon, 1 << z AS w, row_number() OVER (PARTITION BY observer_id ORDER BY ts) AS k,
  log2(2 * pi() * 6371008.8 * greatest(1e-6, cos(radians(lat))) / target) AS wanted, cos(radians(85.05112878)) AS edge FROM e),
t AS (SELECT *, {V.tx(z='z')} AS c, {V.ty(z='z')} AS r, 1 + radians(greatest(0, abs(lat) - 85.05112878)) * w / (2 * pi() * edge) AS ratio FROM o),
m AS (SELECT *, CASE WHEN abs(lat) > 85.05112878 THEN CASE WHEN lat > 0 THEN 'north-boundary' ELSE 'south-boundary' END WHEN r BETWEEN 2 AND w - 3 THEN 'normal' WHEN r < 2 THEN 'north-boundary' ELSE 'south-boundary' END AS mode, CAST(floor(log2(ratio)) AS BIGINT) AS fall FROM t),
s(observer_id, k, ts, mode, zoom, bx, "by", locked, held, imagery, changed) AS (
  SELECT DISTINCT observer_id, 0::BIGINT, 0::BIGINT, '', -1::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::DOUBLE, -1::BIGINT, false FROM m
  UNION ALL
  SELECT observer_id, k, ts, mode, zoom, nx, ny, locked, held, imagery, mode <> 'normal' OR NOT same OR nx <> bx OR ny <> "by" FROM (
    SELECT *, CASE WHEN mode <> 'normal' THEN CASE WHEN (1 << zoom) < 8 THEN 0 ELSE CAST(floor((floor((held + 180) / 360 * (1 << zoom)) - 2) / 4) AS BIGINT) * 4 END WHEN NOT same THEN c - 3 ELSE bx + {_SHIFT.format(i='ahead')} END AS nx,
      CASE WHEN mode = 'north-boundary' THEN 0 WHEN mode = 'south-boundary' THEN (1 << zoom) - least(8, 1 << zoom) WHEN NOT same THEN greatest(0, least(w - 8, r - 3)) ELSE greatest(0, least(w - 8, "by" + {_SHIFT.format(i='(r - "by")')})) END AS ny FROM (
      SELECT *, CASE WHEN mode = 'normal' THEN z ELSE greatest(0, z - CASE WHEN same AND (fall > was AND ratio < pow(2, was + 1) * 1.1 OR fall < was AND ratio > pow(2, was) * 0.9) THEN was ELSE fall END) END AS zoom,
        CASE WHEN locked AND old_zoom >= 0 THEN old_held ELSE lon END AS held FROM (
        SELECT m.*, s.mode = m.mode AS same, s.bx, s."by", s.zoom AS old_zoom, s.held AS old_held, m.z - s.zoom AS was,
          m.mode <> 'normal' AND abs(cos(radians(m.lat))) < edge / 4 * CASE WHEN s.locked THEN 2 ELSE 1 END AS locked,
          ((c - s.bx + w // 2 - 4) % w + w) % w - (w // 2 - 4) AS ahead,
          CAST(greatest(0, ceil(wanted - log2(3.75 / 2.56)), least(CASE WHEN s.imagery < 0 THEN floor(wanted + 0.5) ELSE s.imagery END, floor(wanted - log2(1.75 / 2.56)))) AS BIGINT) AS imagery
        FROM s JOIN m ON m.observer_id = s.observer_id AND m.k = s.k + 1))))
SELECT observer_id, ts, mode, zoom, bx AS block_x, "by" AS block_y, least(8, 1 << zoom) AS side, imagery AS imagery_zoom, locked AS pole_locked, round(held, 6) AS held_lon, changed FROM s WHERE k > 0"""

ORACLES: dict[str, str] = {
    "flagship": f"{_COVER} SELECT p.observer_id, c.z, c.x, c.y, count(*) AS positions FROM positions p JOIN cover c ON p.observer_id = c.cut_id AND {V.tx(z='c.z')} = c.x AND {V.ty(z='c.z')} = c.y GROUP BY ALL",
    "assign_tiles": f"WITH {V.POSITIONS} SELECT z.z AS z, {V.tx(z='z.z')} AS x, {V.ty(z='z.z')} AS y, count(*) AS points FROM positions, (VALUES (3), (7), (11)) z(z) GROUP BY ALL",
    "tile_bounds": f"WITH {V.POSITIONS}, t AS ({_AT8}) SELECT z, x, y, round(x / 256.0 * 360 - 180, 6) AS west, round((x + 1) / 256.0 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 256.0)))), 6) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 256.0)))), 6) AS south, round((x + 0.5) / 256.0, 6) AS centre_u, round((y + 0.5) / 256.0, 6) AS centre_v, 1.0::DOUBLE AS area FROM t",
    "source_tiles": f"WITH {V.POSITIONS}, t AS (SELECT DISTINCT z.z AS z, {V.tx(z='z.z')} AS x, {V.ty(z='z.z')} AS y FROM positions, (VALUES (5), (11)) z(z)), s AS (SELECT *, least(z, 7) AS source_z FROM t) SELECT z, x, y, source_z, x >> (z - source_z) AS source_x, y >> (z - source_z) AS source_y, 1 << (z - source_z) AS scale, x % (1 << (z - source_z)) AS offset_x, y % (1 << (z - source_z)) AS offset_y FROM s",
    "observer_zoom": "WITH o AS (SELECT event_id, 10 + value * 100 AS h, 800 + event_id % 400 AS f, CASE WHEN event_id % 2 = 0 THEN 256 ELSE 512 END AS px, ((event_id * 7919) % 170001) / 1000.0::DOUBLE - 85 AS lat FROM events), c AS (SELECT event_id, log2(2 * pi() * cos(radians(lat)) * f / (px * (h / 6371008.8))) AS c FROM o WHERE h > 0) SELECT event_id, round(c, 6) AS continuous_zoom, greatest(0, CAST(floor(c + 0.5) AS BIGINT)) AS zoom FROM c",
    "clean_coordinates": f"WITH e AS (SELECT event_id, {_LATLON} FROM events), k AS (SELECT *, lat_a BETWEEN -90 AND 90 AND lon_a BETWEEN -180 AND 180 AS good FROM e) SELECT event_id, round(greatest(-90, least(90, lat_a)), 6) AS lat, round(CASE WHEN good THEN lon_a WHEN lon_a >= 180 THEN lon_a - 360 WHEN lon_a < -180 THEN lon_a + 360 ELSE lon_a END, 6) AS lon, CASE WHEN good THEN 'valid' ELSE 'normalised' END AS kind FROM k",
    "first_valid_place": f"WITH e AS (SELECT event_id, {_LATLON}, CASE WHEN event_id % 3 <> 0 THEN event_id % 90 END AS lat_b, event_id % 180 AS lon_b FROM events), k AS (SELECT *, lat_a BETWEEN -90 AND 90 AND lon_a BETWEEN -180 AND 180 AS good FROM e) SELECT event_id, round(CASE WHEN good THEN lat_a ELSE coalesce(lat_b, 0) END, 6)::DOUBLE AS lat, round(CASE WHEN good THEN lon_a WHEN lat_b IS NULL THEN 0 ELSE lon_b END, 6)::DOUBLE AS lon, CASE WHEN good THEN 'device' WHEN lat_b IS NULL THEN 'fallback' ELSE 'ip' END AS source FROM k",
    "observer_targets": f"WITH {V.TARGETS} SELECT observer_id, mode, zoom, block_x, block_y, side FROM targets",
    "finest_tiles": f"WITH {V.FINEST} SELECT observer_id, z, x, y FROM finest",
    "balanced_cover": f"{_COVER} SELECT c.cut_id, c.z, c.x, c.y, CASE WHEN f.z IS NULL THEN 'outer' ELSE 'finest' END AS role FROM cover c LEFT JOIN finest f ON c.cut_id = f.observer_id AND c.z = f.z AND c.x = f.x AND c.y = f.y",
    "cut_statistics": f"{_COVER}, nodes AS (SELECT cut_id, count(*) AS nodes FROM (SELECT DISTINCT cut_id, z - u.u AS z, x >> u.u AS x, y >> u.u AS y FROM cover, range(0, 12) u(u) WHERE u.u <= z) GROUP BY 1) SELECT c.cut_id, count(*) AS leaves, count(f.z) AS finest, min(c.z) AS min_zoom, max(c.z) AS max_zoom, md5(string_agg(concat_ws('/', c.z, c.x, c.y), ' ' ORDER BY c.z, c.y, c.x)) AS signature, any_value(nodes) AS nodes FROM cover c LEFT JOIN finest f ON c.cut_id = f.observer_id AND c.z = f.z AND c.x = f.x AND c.y = f.y JOIN nodes n ON n.cut_id = c.cut_id GROUP BY c.cut_id",
    "cut_leaves_by_zoom": f"{_COVER} SELECT c.cut_id, c.z, CASE WHEN f.z IS NULL THEN 'outer' ELSE 'finest' END AS role, count(*) AS leaves, round(sum(pow(4.0::DOUBLE, -c.z)), 6) AS area FROM cover c LEFT JOIN finest f ON c.cut_id = f.observer_id AND c.z = f.z AND c.x = f.x AND c.y = f.y GROUP BY ALL",
    "horizon_measures": """WITH o AS (SELECT event_id, (1 + event_id % 15000)::DOUBLE AS r, greatest(0, value - 5) AS h FROM events), a AS (SELECT event_id, r, acos(r / (r + h)) AS a FROM o)
SELECT event_id, round(a, 6) AS horizon_rad, round(degrees(a), 6) AS horizon_deg, round(2 * r * a, 6) AS horizon_diameter_m, round(a * 6371.0088, 6) AS horizon_source_km FROM a""",
    "fetch_order": """WITH f AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'terrain' WHEN event_id % 5 > 0 THEN 'imagery' ELSE 'other' END AS provider, event_id * 7919 % 13 AS priority, event_id AS sequence FROM events)
SELECT *, row_number() OVER (PARTITION BY user_id, provider ORDER BY priority DESC, sequence) AS turn FROM f QUALIFY turn <= CASE provider WHEN 'terrain' THEN 4 WHEN 'imagery' THEN 6 ELSE 0 END""",
    "anchor_targets": _ANCHORS,
    "validate_cut": f"""{_COVER}, given AS (SELECT * FROM cover WHERE (x + 3 * y + z) % 29 <> 0 UNION ALL SELECT * FROM cover WHERE (x + y) % 31 = 1 UNION ALL SELECT cut_id, z + 2, x * 4, y * 4 FROM cover WHERE (x * 5 + y) % 37 = 2), once AS (SELECT DISTINCT * FROM given),
found AS (SELECT cut_id, 'duplicate' AS problem, count(*)::DOUBLE AS detail FROM given GROUP BY cut_id, z, x, y HAVING count(*) > 1
UNION ALL SELECT cut_id, 'ancestor', 0 FROM once o WHERE EXISTS (SELECT 1 FROM once d WHERE d.cut_id = o.cut_id AND d.z > o.z AND d.x >> (d.z - o.z) = o.x AND d.y >> (d.z - o.z) = o.y)
UNION ALL SELECT cut_id, 'area', sum(pow(4.0::DOUBLE, -z)) FROM once GROUP BY cut_id HAVING abs(sum(pow(4.0::DOUBLE, -z)) - 1) > 1e-12
UNION ALL SELECT a.cut_id, 'balance', b.z - a.z FROM once a JOIN once b ON a.cut_id = b.cut_id AND b.z - a.z > 1 AND {_touch('a', 'b')})
SELECT cut_id, problem, count(*) AS found, round(max(detail), 6) AS worst FROM found GROUP BY ALL""",
    "deepest_covering_tile": f"{_COVER} SELECT p.id, p.observer_id, c.z, c.x, c.y FROM positions p JOIN cover c ON p.observer_id = c.cut_id AND {V.tx(z='c.z')} = c.x AND {V.ty(z='c.z')} = c.y",
    "horizon_candidates": f"{_TWO}{_GROUPS} SELECT cut_id, z, x, y FROM old_cut UNION SELECT cut_id, z, x, y FROM members WHERE side = 'after'",
    "diff_cuts": f"{_TWO} SELECT coalesce(o.cut_id, n.cut_id) AS cut_id, coalesce(o.z, n.z) AS z, coalesce(o.x, n.x) AS x, coalesce(o.y, n.y) AS y, CASE WHEN n.z IS NULL THEN 'removed' WHEN o.z IS NULL THEN 'added' ELSE 'retained' END AS side FROM old_cut o FULL JOIN new_cut n ON o.cut_id = n.cut_id AND o.z = n.z AND o.x = n.x AND o.y = n.y",
    "retained_sources": "SELECT p_partkey AS key, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 OR l_discount = 0) AS kept FROM part",
    "cuts_equal": f"{_TWO} SELECT NOT EXISTS ((SELECT z, x, y FROM old_cut EXCEPT SELECT z, x, y FROM new_cut) UNION ALL (SELECT z, x, y FROM new_cut EXCEPT SELECT z, x, y FROM old_cut)) AS equal",
    "touching_tiles": f"{_COVER} SELECT a.cut_id, a.z, a.x, a.y, count(*) AS touching FROM cover a JOIN cover b ON a.cut_id = b.cut_id AND (a.z, a.x, a.y) <> (b.z, b.x, b.y) AND {_touch('a', 'b')} GROUP BY ALL",
    "tiles_within_horizon": f"""WITH {V.OBSERVERS}, t AS (SELECT DISTINCT z.z AS z, {V.tx(z='z.z')} AS x, {V.ty(z='z.z')} AS y FROM positions, (VALUES (2), (5)) z(z)),
o AS (SELECT observer_id, lat, lon, radians(lat) AS phi, (observer_id % 40 * 2.5) / (2 * (1000 * (6356.752314245 / 6371.0088::DOUBLE) + observer_id % 40 * 2.5)) AS gap FROM observers),
w AS (SELECT *, (x + 0.5) / (1 << z)::DOUBLE * 360 - 180 AS centre, {V.tx(z='z')} = x AND {V.ty(z='z')} = y AS underfoot FROM o, t),
d AS (SELECT *, radians(greatest(0, abs((centre - lon + 180) - floor((centre - lon + 180) / 360) * 360 - 180) - 180 / (1 << z)::DOUBLE)) AS aside FROM w),
l AS (SELECT *, greatest(atan(sinh(pi() * (1 - 2 * (y + 1) / (1 << z)::DOUBLE))), least(atan(sinh(pi() * (1 - 2 * y / (1 << z)::DOUBLE))), CASE WHEN aside = 0 THEN phi ELSE atan2(sin(phi), cos(phi) * cos(aside)) END)) AS lt FROM d)
SELECT observer_id, z, x, y FROM l WHERE underfoot OR pow(sin((lt - phi) / 2), 2) + cos(phi) * cos(lt) * pow(sin(aside / 2), 2) <= gap""",
    "replacement_groups": f"{_TWO}{_GROUPS} SELECT * FROM members",
    "group_dependencies": f"{_TWO}{_EDGES} SELECT * FROM edges",
    "atomic_batches": f"{_TWO}{_EDGES} SELECT * FROM batches",
    "dependency_closure": f"{_TWO}{_EDGES}, closure AS (SELECT DISTINCT cut_id, batch FROM batches WHERE length(batch) % 3 = 0 UNION SELECT c.cut_id, d.depends_on FROM closure c JOIN depends d ON c.cut_id = d.cut_id AND c.batch = d.batch) SELECT * FROM closure",
    "ready_batches": f"{_TWO}{_EDGES} SELECT b.cut_id, b.batch FROM batches b JOIN after a ON a.cut_id = b.cut_id AND a.g = b.node ANTI JOIN depends d ON d.cut_id = b.cut_id AND d.batch = b.batch GROUP BY ALL HAVING bool_and(a.state IN ('ready', 'missing'))",
    "change_summary": f"""{_TWO}{_EDGES}, o AS (SELECT cut_id, count(*) AS committed FROM old_cut GROUP BY 1), n AS (SELECT cut_id, count(*) AS requested FROM new_cut GROUP BY 1), r AS (SELECT cut_id, count(*) AS retained FROM old_cut SEMI JOIN new_cut USING (cut_id, z, x, y) GROUP BY 1),
g AS (SELECT cut_id, count(*) AS groups, count(DISTINCT batch) AS batches FROM batches GROUP BY 1),
s AS (SELECT cut_id, count(*) FILTER (state = 'requested') AS state_requested, count(*) FILTER (state = 'in-flight') AS state_in_flight, count(*) FILTER (state = 'ready') AS state_ready, count(*) FILTER (state = 'failed') AS state_failed FROM (SELECT DISTINCT cut_id, z, x, y, state FROM after) GROUP BY 1),
j AS (SELECT cut_id, coalesce(committed, 0) AS committed, coalesce(requested, 0) AS requested, coalesce(retained, 0) AS retained, coalesce(groups, 0) AS groups, coalesce(batches, 0) AS batches, coalesce(state_requested, 0) AS state_requested, coalesce(state_in_flight, 0) AS state_in_flight, coalesce(state_ready, 0) AS state_ready, coalesce(state_failed, 0) AS state_failed
FROM o FULL JOIN n USING (cut_id) FULL JOIN r USING (cut_id) FULL JOIN g USING (cut_id) FULL JOIN s USING (cut_id))
SELECT *, state_requested + state_in_flight + state_failed AS blocking, committed = retained AND requested = retained AND groups = 0 AND batches = 0 AS complete FROM j""",
    "work_order": f"{_COVER} SELECT cut_id, z, x, y, turn FROM (SELECT *, row_number() OVER (PARTITION BY cut_id ORDER BY z DESC, y, x) AS turn FROM cover) WHERE turn <= 4",
    "canonical_order": f"WITH {V.POSITIONS} SELECT DISTINCT 4 AS z, {V.tx(z='4')} AS x, {V.ty(z='4')} AS y FROM positions",
}
