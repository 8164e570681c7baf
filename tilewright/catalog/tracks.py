"""Queries on moving objects, catalogues and the sky."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import views as V
from tilewright.catalog.tiles import rounded
from tilewright.functions import geo
from tilewright.operators import tracks as K
from tilewright.sources.files import TRACK


def latest_track_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), "snapshot").when(F.col("event_type") == "error", "remove").otherwise("upsert")
    ops = e.select((F.col("user_id") % 8).alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("track"), (F.col("event_id") % 5).alias("revision"))
    return K.latest_track_state(ops)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = V.read(spark, sf_dir, "lineitem"), V.read(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("track"), (F.col("l_linenumber") * 1000).cast("long").alias("offset_ms"), (F.col("l_partkey") * 7919 % 170001 / 1000.0 - 85.0).alias("lat"), (F.col("l_suppkey") * 104729 % 360000 / 1000.0 - 180.0).alias("lon"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_partkey") % 400 * 100.0).alias("altitude"), (F.col("l_partkey") % 360).cast("double").alias("course"))


def interpolate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).groupBy("track", "offset_ms").agg(*[F.min(c).alias(c) for c in ("lat", "lon", "altitude", "course")])
    times = points.select("track").distinct().withColumn("at_ms", F.explode(F.array(*[F.lit(t) for t in (500, 2500, 99000)])))
    return rounded(K.interpolate_tracks(points, times), "lat", "lon", "altitude", "course", "turn_rate")


def to_earth_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.positions(spark, sf_dir).select("id", "lat", "lon", (F.col("id") % 900 - 100.0).alias("height_km"))
    return rounded(K.to_earth_fixed(p, "lat", "lon", "height_km", 3.0), "ex", "ey", "ez").select("id", "ex", "ey", "ez")


def describe_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events")
    s = e.select("event_id", F.element_at(F.array(F.lit("A1"), F.lit("C1"), F.lit("C2")), (1 + F.col("event_id") % 3).cast("int")).alias("category"), (F.col("event_id") % 7 == 0).alias("on_ground"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 300).alias("altitude"), (F.col("event_id") % 500).cast("double").alias("speed_kt"), (F.col("event_id") % 720 + 0.25).alias("heading"), (F.col("event_id") % 3000 - 1500.0).alias("vertical_fpm"), (F.col("event_id") % 7 - 3.0).alias("turn_rate"))
    return rounded(K.describe_tracks(s), "pitch", "roll").select("event_id", "kind", "label", "pitch", "roll")


def tracks_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.positions(spark, sf_dir).select("id", "lat", "lon")
    centres = V.observers(spark, sf_dir).select(F.col("observer_id").alias("centre"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    return K.tracks_within_radius(p, centres, 250.0).select("centre", "id", (geo.half_up(F.col("angle") * 1e6) * 1.0 / 1e6).alias("angle"))


def cap_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cap_tracks(V.positions(spark, sf_dir).select("id", "observer_id"), "id")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 4).alias("source"), F.when(F.col("l_quantity") != 1, F.col("l_partkey")).alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").alias("fetched_at"), F.col("l_extendedprice").alias("value"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.read(spark, sf_dir, "nation").select(F.concat(F.lit("g"), (F.col("n_nationkey") % 3).cast("string")).alias("group"), (F.col("n_nationkey") % 4).cast("long").alias("source")).distinct()
    return K.expand_groups(n.groupBy("group").agg(F.collect_set("source").alias("sources")), _catalogue(spark, sf_dir))


def expand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).groupBy("group", "source").agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("named"))


def merge_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = lambda df: df.groupBy("group", "id", "pos").agg(F.max("value").alias("value"), F.min("fetched_at").alias("fetched_at"))
    rows = _expanded(spark, sf_dir)
    # dealt by what they are merged by, rows with an id move once; those without stay dealt by place
    named, nameless = rows.filter("id IS NOT NULL").repartition("group", "id"), rows.filter("id IS NULL")
    return K.merge_named(once(named)).unionByName(once(nameless).select("group", "id", "pos", "value", "fetched_at"))


def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _catalogue(spark, sf_dir).filter("id IS NOT NULL").select(F.element_at(F.array(F.lit("stations"), F.lit("science"), F.lit("visual"), F.lit("off")), (1 + F.col("source")).cast("int")).alias("group"), F.col("id").alias("catalog_id"), "pos", (F.col("pos") % 7 != 0).alias("ok"))
    return K.priority_dedup(p, ["stations", "science", "visual"], ["stations", "science", "visual"]).select("catalog_id", "group", "pos")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "embeddings")
    at = lambda k: F.element_at("embedding", k).cast("double")
    return e.select("vec_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (at(4) * 20 + 5).alias("magnitude"), (1000 + F.col("vec_id") * 100).cast("double").alias("temperature"))


def visible_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.visible_stars(_stars(spark, sf_dir)), "dx", "dy", "dz").select("vec_id", "dx", "dy", "dz", "code")


def asof_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events")
    seen = e.select((F.col("user_id") % 5).alias("body"), (F.col("event_id") * 13 % 100000).alias("ts"), F.col("event_id").alias("id"))
    sample = V.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("body"), (F.col("vec_id") * 60).alias("ts"), F.col("vec_id").alias("sample"))
    return K.asof_ephemeris(seen, sample, "body").select("id", "body", "ts", "sample")


def eclipse_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, s: (F.element_at("embedding", k).cast("double") * s)
    v = V.read(spark, sf_dir, "embeddings").select("vec_id", F.struct(at(1, 1e8).alias("x"), at(2, 1e8).alias("y"), at(3, 1e8).alias("z")).alias("sun"), F.struct(at(4, 1e6).alias("x"), at(5, 1e6).alias("y"), at(6, 1e6).alias("z")).alias("moon"))
    out = K.eclipse_geometry(v)
    return out.select("vec_id", *[F.round(c, 3).alias(c) for c in ("sun_distance", "moon_distance", "sun_moon_distance")], F.round("axis_distance", 1).alias("axis_distance"), *[F.round(c, 6).alias(c) for c in ("axis_x", "axis_y", "axis_z")])


def relative_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, s: (F.element_at("embedding", k).cast("double") * s)
    xyz = lambda first, s: F.struct(*[at(first + k, s).alias(c) for k, c in enumerate("xyz")])
    v = V.read(spark, sf_dir, "embeddings").select("vec_id", xyz(1, 1e6).alias("body"), xyz(4, 1e4).alias("observer"), (F.col("vec_id") % 50 * 10000).cast("double").alias("radius_km"))
    out = K.relative_bodies(v, "body", "observer", "radius_km")
    return out.select("vec_id", F.round("distance", 3).alias("distance"), *[F.round(f"direction.{c}", 6).alias(f"d{c}") for c in "xyz"], F.round("angular_radius", 6).alias("angular_radius"))


def visible_planets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _stars(spark, sf_dir).select("vec_id", (F.col("vec_id") % 4 > 0).alias("enabled"), (F.col("magnitude") - 6).alias("magnitude"), (F.col("vec_id") % 7 / 10.0).alias("diameter_deg"))
    return rounded(K.visible_planets(p).select("vec_id", "strength", "shown_deg", "opacity"), "strength", "shown_deg", "opacity")


def eclipse_events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("partial", "annular", "total", "hybrid", "lunar")]), (1 + F.col("o_orderkey") % 5).cast("int"))
    e = V.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("solar-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), kind).alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return K.eclipse_events_between(e, F.lit("1994-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "event_id", "year", "kind")


def valid_orbital_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that miss a field or hold another kind in it, by rules on their numbers."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = V.read(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_partkey").cast("string").alias("part"))
    off = lambda n: F.col("key") % n == 0
    fields = [f'"{name}": 1.5' for name in K.NUMBERS if name not in ("NORAD_CAT_ID", "BSTAR", "ECCENTRICITY", "MEAN_MOTION")]
    record = F.concat(
        F.when(off(11), F.lit("{")).otherwise('{"OBJECT_NAME": "A", '), F.lit('"OBJECT_ID": "B", "EPOCH": '), F.when(off(13), F.lit("7")).otherwise('"2024-01-01"'), F.lit(', "NORAD_CAT_ID": "'), "part", F.lit('", "BSTAR": '),
        F.when(off(7), F.lit('" "')).otherwise("-1e-4"), F.lit(', "ECCENTRICITY": '), F.when(off(17), F.lit('"abc"')).otherwise('" .5 "'), F.lit(', "MEAN_MOTION": '), F.when(off(19), F.lit("null")).otherwise("15"), F.lit(", " + ", ".join(fields) + "}"),
    )
    good, bad = K.valid_orbital_elements(li.select("key", record.alias("record")))
    return good.select("key", F.lit(True).alias("valid")).unionByName(bad.select("key", F.lit(False).alias("valid")))


def normalise_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one track for each event, as the reader parses them."""
    e, k = V.read(spark, sf_dir, "events"), F.col("event_id")
    some = lambda n, value: F.when(k % n != 0, value)
    none = F.array().cast("array<double>")
    line = lambda *v: F.when(k % 7 == 0, none).otherwise(F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v]).cast("array<double>"))
    body = F.to_json(F.struct(
        some(17, F.concat(F.lit(" a"), (k % 50).cast("string"))).alias("id"), F.when(k % 3 == 0, F.lit("  ")).alias("callsign"), F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("registration"),
        F.struct((k % 90).cast("double").alias("latitudeDegrees"), some(19, k % 180).cast("double").alias("longitudeDegrees"), some(4, k % 360).cast("double").alias("courseDegrees"), some(5, k * 3 % 360).cast("double").alias("headingDegrees")).alias("current"),
        F.struct((k * 1000).cast("double").alias("generatedAtMs"), F.when(k % 2 == 0, k * 1000 + 9).cast("double").alias("validUntilMs"), line(0, 1000, 500, 2000).alias("offsetMs"), line(1, F.when(k % 6 != 0, 2.0), 3, 4).alias("latitudeDegrees"), line(5, 6, 7).alias("longitudeDegrees"), line(90, 91).alias("courseDegrees")).alias("trajectory"),
    ))
    tracks = e.select("event_id", F.from_json(body, TRACK).alias("track"), F.lit(1).alias("received_ms"))
    out = K.normalise_tracks(tracks)
    last = F.element_at("points", -1)
    return out.select("event_id", "id", "callsign", "lat", "lon", "course", "heading", F.size("points").alias("points"), last["offset_ms"].alias("last_ms"), last["lat"].alias("last_lat"), last["course"].alias("last_course"), "valid_until_ms")


def contact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.contact_range(V.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("event_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("utc")))


QUERIES = {f.__name__: f for f in (latest_track_state, interpolate_tracks, to_earth_fixed, describe_tracks, tracks_within_radius, cap_tracks, expand_groups, merge_catalogues, priority_dedup, visible_stars, asof_ephemeris, relative_bodies, visible_planets, eclipse_events_between, valid_orbital_elements, normalise_tracks, eclipse_geometry, contact_range)}

_CAT = "cat AS (SELECT l_suppkey % 4 AS source, CASE WHEN l_quantity <> 1 THEN l_partkey END AS id, l_orderkey * 8 + l_linenumber AS pos, l_suppkey AS fetched_at, l_extendedprice AS value FROM lineitem), ex AS (SELECT g.group_name AS grp, cat.* FROM (SELECT DISTINCT 'g' || (n_nationkey % 3) AS group_name, n_nationkey % 4 AS source FROM nation) g JOIN cat USING (source))"
_MM = "((b.{c} - a.{c} + 180) - floor((b.{c} - a.{c} + 180) / 360) * 360 - 180)"

ORACLES = {
    "latest_track_state": "WITH o AS (SELECT user_id % 8 AS session, event_id AS seq, CASE WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'snapshot' WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS type, user_id AS track, event_id % 5 AS revision FROM events), m AS (SELECT session, max(seq) FILTER (type = 'snapshot') AS snap FROM o GROUP BY 1), l AS (SELECT o.*, row_number() OVER (PARTITION BY o.session, track ORDER BY seq DESC) AS t FROM o JOIN m ON o.session = m.session WHERE seq >= coalesce(snap, -1)) SELECT session, seq, type, track, revision FROM l WHERE t = 1 AND type <> 'remove'",
    "interpolate_tracks": f"""WITH raw AS (SELECT o_orderkey AS track, l_linenumber * 1000 AS offset_ms, (l_partkey * 7919 % 170001) / 1000.0::DOUBLE - 85 AS lat, (l_suppkey * 104729 % 360000) / 1000.0::DOUBLE - 180 AS lon, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey % 400 * 100.0::DOUBLE END AS altitude, (l_partkey % 360)::DOUBLE AS course FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pts AS (SELECT track, offset_ms, min(lat) AS lat, min(lon) AS lon, min(altitude) AS altitude, min(course) AS course FROM raw GROUP BY ALL),
tm AS (SELECT DISTINCT track, t.t AS at_ms FROM pts, (VALUES (500), (2500), (99000)) t(t)),
ends AS (SELECT tm.track, at_ms, coalesce(max(offset_ms) FILTER (offset_ms <= at_ms), min(offset_ms)) AS o1, coalesce(min(offset_ms) FILTER (offset_ms >= at_ms), max(offset_ms)) AS o2 FROM tm JOIN pts USING (track) GROUP BY ALL),
j AS (SELECT e.track, e.at_ms, a.lat AS alat, b.lat AS blat, a.lon AS alon, {_MM.format(c='lon')} AS dlon, a.altitude AS aalt, b.altitude AS balt, a.course AS ac, {_MM.format(c='course')} AS dc, o2 - o1 AS gap, CASE WHEN o2 > o1 THEN greatest(0, least(1, (e.at_ms - o1) / (o2 - o1)::DOUBLE)) ELSE 0 END AS s FROM ends e JOIN pts a ON a.track = e.track AND a.offset_ms = o1 JOIN pts b ON b.track = e.track AND b.offset_ms = o2)
SELECT track, at_ms::DOUBLE AS at_ms, round(alat + (blat - alat) * s, 6) AS lat, round((alon + dlon * s + 180) - floor((alon + dlon * s + 180) / 360) * 360 - 180, 6) AS lon, round(CASE WHEN aalt IS NOT NULL AND balt IS NOT NULL THEN aalt + (balt - aalt) * s ELSE coalesce(aalt, balt) END, 6) AS altitude, round((ac + dc * s) - floor((ac + dc * s) / 360) * 360, 6) AS course, round(CASE WHEN gap > 0 THEN dc / (gap / 1000.0::DOUBLE) ELSE 0 END, 6) AS turn_rate FROM j""",
    "to_earth_fixed": f"WITH {V.POSITIONS}, p AS (SELECT id, radians(lat) AS a, radians(lon) AS o, greatest(0, id % 900 - 100.0::DOUBLE) * 3 AS up, 1 - (6356.752314245::DOUBLE / 6378.137) * (6356.752314245::DOUBLE / 6378.137) AS e2 FROM positions), n AS (SELECT *, 6378.137 / sqrt(1 - e2 * sin(a) * sin(a)) AS n FROM p) SELECT id, round((n + up) * cos(a) * cos(o) / 6371.0088::DOUBLE, 6) AS ex, round((n * (1 - e2) + up) * sin(a) / 6371.0088::DOUBLE, 6) AS ey, round(-(n + up) * cos(a) * sin(o) / 6371.0088::DOUBLE, 6) AS ez FROM n",
    "describe_tracks": "WITH s AS (SELECT event_id, event_id % 3 AS c, event_id % 7 = 0 AS g, CASE WHEN event_id % 5 <> 0 THEN value * 300 END AS alt, (event_id % 500)::DOUBLE AS kt, event_id % 720 + 0.25::DOUBLE AS h, event_id % 3000 - 1500.0::DOUBLE AS v, event_id % 7 - 3.0::DOUBLE AS r FROM events) SELECT event_id, CASE WHEN c > 0 THEN 'vehicle' ELSE 'aircraft' END AS kind, CASE WHEN g THEN 'GND' WHEN alt IS NULL THEN 'ALT---' ELSE 'FL' || CASE WHEN floor(alt / 100 + 0.5) < 1000 THEN lpad(greatest(0, floor(alt / 100 + 0.5)::BIGINT)::VARCHAR, 3, '0') ELSE floor(alt / 100 + 0.5)::BIGINT::VARCHAR END END || ' ' || kt::BIGINT || 'KT ' || lpad((event_id % 360)::VARCHAR, 3, '0') || '°' AS label, round(CASE WHEN g OR kt <= 0 THEN 0 ELSE degrees(atan2(v * 0.00508, kt * 0.514444)) END, 6) AS pitch, round(CASE WHEN g THEN 0 ELSE degrees(atan(kt * 0.514444 * radians(r) / 9.80665)) END, 6) AS roll FROM s",
    "tracks_within_radius": f"WITH {V.OBSERVERS}, d AS (SELECT o.observer_id AS centre, p.id, 2 * asin(sqrt(least(1, pow(sin((radians(p.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - o.lon) / 2), 2)))) AS angle FROM positions p, observers o) SELECT centre, id, round(angle, 6) AS angle FROM d WHERE angle <= 250 * 1.852::DOUBLE / 6371.0088::DOUBLE",
    "cap_tracks": "SELECT event_id AS id, user_id AS observer_id FROM events ORDER BY event_id LIMIT 800",
    "expand_groups": f'WITH {_CAT} SELECT grp AS "group", source, count(*) AS rows, count(id) AS named FROM ex GROUP BY ALL',
    "merge_catalogues": f'WITH {_CAT}, u AS (SELECT grp, id, pos, max(value) AS value, min(fetched_at) AS fetched_at FROM ex GROUP BY ALL) SELECT grp AS "group", id, min(pos) AS pos, arg_max(value, pos) AS value, min(fetched_at) AS fetched_at FROM u WHERE id IS NOT NULL GROUP BY grp, id UNION ALL SELECT grp, id, pos, value, fetched_at FROM u WHERE id IS NULL',
    "priority_dedup": f"WITH {_CAT} SELECT id AS catalog_id, ['stations', 'science', 'visual'][source + 1] AS \"group\", pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, pos) AS t FROM cat WHERE id IS NOT NULL AND source < 3 AND pos % 7 <> 0) WHERE t = 1",
    "visible_stars": "WITH s AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE * 20 + 5 AS m, 1000 + vec_id * 100.0::DOUBLE AS t FROM embeddings), d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM s) SELECT vec_id, round(x / d, 6) AS dx, round(y / d, 6) AS dy, round(z / d, 6) AS dz, least(254, floor(ln(greatest(2000, least(50000, t)) / 2000) / ln(25) * 255 + 0.5)::BIGINT) AS code FROM d WHERE m <= 6.5 AND d > 1e-9",
    "asof_ephemeris": "WITH e AS (SELECT event_id AS id, user_id % 5 AS body, event_id * 13 % 100000 AS ts FROM events), s AS (SELECT vec_id % 5 AS body, vec_id * 60 AS ts, vec_id AS sample FROM embeddings) SELECT e.id, e.body, e.ts, s.sample FROM e ASOF LEFT JOIN s ON e.body = s.body AND e.ts >= s.ts",
    "contact_range": "WITH c AS (SELECT o_custkey % 500 AS event_id, epoch(o_orderdate)::BIGINT AS utc FROM orders) SELECT event_id, min(utc) AS first, max(utc) AS last, min(utc) < max(utc) AS valid FROM c GROUP BY 1",
    "eclipse_geometry": "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 1e8 AS sx, embedding[2]::DOUBLE * 1e8 AS sy, embedding[3]::DOUBLE * 1e8 AS sz, embedding[4]::DOUBLE * 1e6 AS mx, embedding[5]::DOUBLE * 1e6 AS my, embedding[6]::DOUBLE * 1e6 AS mz FROM embeddings), a AS (SELECT *, sqrt((mx - sx) ** 2 + (my - sy) ** 2 + (mz - sz) ** 2) AS l FROM v), b AS (SELECT *, (mx * (mx - sx) + my * (my - sy) + mz * (mz - sz)) / l AS along FROM a) SELECT vec_id, round(sqrt(sx * sx + sy * sy + sz * sz), 3) AS sun_distance, round(sqrt(mx * mx + my * my + mz * mz), 3) AS moon_distance, round(l, 3) AS sun_moon_distance, round(-along, 1) AS axis_distance, round((mx - sx) / l, 6) AS axis_x, round((my - sy) / l, 6) AS axis_y, round((mz - sz) / l, 6) AS axis_z FROM b",
    "relative_bodies": "WITH v AS (SELECT vec_id, vec_id % 50 * 10000.0::DOUBLE AS r, embedding[1]::DOUBLE * 1e6 - embedding[4]::DOUBLE * 1e4 AS x, embedding[2]::DOUBLE * 1e6 - embedding[5]::DOUBLE * 1e4 AS y, embedding[3]::DOUBLE * 1e6 - embedding[6]::DOUBLE * 1e4 AS z FROM embeddings), d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM v) SELECT vec_id, round(d, 3) AS distance, round(x / d, 6) AS dx, round(y / d, 6) AS dy, round(z / d, 6) AS dz, CASE WHEN d >= r THEN round(asin(r / d), 6) END AS angular_radius FROM d",
    "visible_planets": "WITH p AS (SELECT vec_id, embedding[4]::DOUBLE * 20 - 1 AS m, vec_id % 7 / 10.0::DOUBLE AS deg FROM embeddings WHERE vec_id % 4 > 0), s AS (SELECT *, greatest(0, least(1, (6.5::DOUBLE - m) / 11)) AS s FROM p WHERE m <= 6.5) SELECT vec_id, round(s, 6) AS strength, round(deg * (0.85::DOUBLE + 0.2::DOUBLE * s), 6) AS shown_deg, round(0.55::DOUBLE + 0.33::DOUBLE * s, 6) AS opacity FROM s",
    "eclipse_events_between": "SELECT o_orderkey, 'solar-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || ['partial', 'annular', 'total', 'hybrid'][1 + o_orderkey % 5] AS event_id, year(o_orderdate)::INT AS year, ['partial', 'annular', 'total', 'hybrid'][1 + o_orderkey % 5] AS kind FROM orders WHERE o_orderkey % 5 < 4 AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1997-01-01'",
    "valid_orbital_elements": "WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS key FROM lineitem) SELECT key, key % 11 > 0 AND key % 13 > 0 AND key % 7 > 0 AND key % 17 > 0 AND key % 19 > 0 AS valid FROM k",
    "normalise_tracks": """WITH e AS (SELECT event_id AS k FROM events WHERE event_id % 17 > 0 AND event_id % 19 > 0), p AS (SELECT k, CASE WHEN k % 4 > 0 THEN k % 360 ELSE 0 END::DOUBLE AS course FROM e)
SELECT k AS event_id, 'A' || (k % 50) AS id, CASE WHEN k % 2 = 0 THEN 'r' || k ELSE 'a' || (k % 50) END AS callsign, (k % 90)::DOUBLE AS lat, (k % 180)::DOUBLE AS lon, course, CASE WHEN k % 5 > 0 THEN (k * 3 % 360)::DOUBLE ELSE course END AS heading,
CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END AS points, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 6 = 0 THEN 500 ELSE 1000 END::DOUBLE AS last_ms, CASE WHEN k % 7 = 0 THEN (k % 90)::DOUBLE WHEN k % 6 = 0 THEN 3 ELSE 2 END AS last_lat,
CASE WHEN k % 7 = 0 OR k % 6 = 0 THEN course ELSE 91 END AS last_course, k * 1000.0::DOUBLE + CASE WHEN k % 2 = 0 THEN 9 WHEN k % 7 = 0 THEN 0 WHEN k % 6 = 0 THEN 500 ELSE 1000 END AS valid_until_ms FROM p""",
}
