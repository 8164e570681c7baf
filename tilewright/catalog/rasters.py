"""Queries on rasters and stored answers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import views as V
from tilewright.functions.shared import checkpoint
from tilewright.operators import rasters as R
from tilewright.operators import responses as P
from tilewright.plans import cover as C


def _zoom(spark: SparkSession, sf_dir: str) -> int:
    """The least zoom whose world has room for a tile for each vector."""
    most = V.read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return math.ceil(math.log2(math.sqrt(most + 1)))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each vector, row by row in the world of that zoom."""
    z = _zoom(spark, sf_dir)
    return V.read(spark, sf_dir, "embeddings").select(F.lit(z).alias("z"), (F.col("vec_id") % (1 << z)).alias("x"), F.floor(F.col("vec_id") / (1 << z)).alias("y"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda v: v.cast("double") * 1000).alias("elevation"))


def decode_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = V.read(spark, sf_dir, "pages").select("page_id", F.substring(F.md5(F.col("html").cast("binary")), 1, 16).cast("binary").alias("data"))
    return R.decode_elevation(data).select("page_id", F.posexplode("elevation").alias("pixel", "metres"))


def elevation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.elevation_bounds(_rasters(spark, sf_dir)).select("z", "x", "y", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "valid")


def raster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.raster_pyramid(_rasters(spark, sf_dir)).select("x", "y", "level", F.posexplode("elevation").alias("pixel", "metres")).withColumn("metres", F.round("metres", 4))


def sample_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_one_zoom(V.positions(spark, sf_dir).select("id", "lat", "lon"), _rasters(spark, sf_dir), _zoom(spark, sf_dir)).select("id", F.round("elevation_m", 4).alias("elevation_m"))


def ground_tracks_on_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.positions(spark, sf_dir).select("id", "lat", "lon", (F.col("id") % 3 == 0).alias("on_ground"), (F.col("id") % 900).alias("altitude"))
    return R.ground_tracks_on_one_zoom(s, _rasters(spark, sf_dir), _zoom(spark, sf_dir)).groupBy("on_ground").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("height"), 2).alias("height"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of three zooms: each vector fills a tile in every one whose world has room for it, twice as wide as high where its number is odd; some have no elevation."""
    top, out = _zoom(spark, sf_dir), []
    for z in {max(0, top - k) for k in range(3)}:
        wide = F.col("vec_id") % 2
        elevation = F.when(F.col("vec_id") % 9 > 0, F.transform("embedding", lambda v: v.cast("double") * 1000 + z))
        rows = V.read(spark, sf_dir, "embeddings").filter(F.col("vec_id") < (1 << (2 * z)))
        out.append(rows.select(F.lit(z).alias("z"), (F.col("vec_id") % (1 << z)).alias("x"), F.floor(F.col("vec_id") / (1 << z)).alias("y"), F.when(wide == 1, 16).otherwise(8).alias("width"), F.when(wide == 1, 4).otherwise(8).alias("height"), elevation.alias("elevation")))
    return reduce(DataFrame.unionByName, out)


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(C.balanced_cover(C.observer_targets(V.observers(spark, sf_dir))))  # read twice, and dear


def sample_through_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain that each observer's cover, of mixed zooms, shows under the positions."""
    at = V.positions(spark, sf_dir).select("id", "observer_id", "lat", "lon")
    out = R.sample_elevation(at, _covers(spark, sf_dir), _levels(spark, sf_dir), _zoom(spark, sf_dir), 10, ["observer_id"])
    return out.select("id", F.round("elevation_m", 4).alias("elevation_m"))


def ground_tracks_through_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.positions(spark, sf_dir).select("id", "observer_id", "lat", "lon", (F.col("id") % 3 == 0).alias("on_ground"), (F.col("id") % 900).alias("altitude"))
    out = R.ground_tracks_on_terrain(s, _covers(spark, sf_dir), _levels(spark, sf_dir), _zoom(spark, sf_dir), 10, ["observer_id"])
    return out.groupBy("on_ground").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("height"), 2).alias("height"))


def raster_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile with a border of one pixel: all its pixels."""
    out = R.raster_neighbours(_rasters(spark, sf_dir), 1)
    return out.select("x", "y", F.posexplode("elevation").alias("pixel", "metres")).withColumn("metres", F.round("metres", 6))


#: Every how many documents an answer has each field; it says the field's name and the document.
GEOCODE = {
    "display_name": 11, "name": 13, "category": 29, "addresstype": 17, "type": 19, "house_number": 8, "pedestrian": 12, "footway": 9, "cycleway": 10, "neighbourhood": 16, "quarter": 14, "suburb": 15,
    "city_district": 18, "borough": 20, "postcode": 21, "county": 22, "country": 23, "country_code": 5, "state": 24, "region": 25, "state_district": 26,
    "city": 27, "town": 28, "village": 30, "municipality": 31, "hamlet": 32, "ocean": 33, "sea": 7, "water": 34,
}


def flatten_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a place, from answers in which each field is there now and then; ``road`` is always blank."""
    top = ("display_name", "name", "category", "addresstype", "type")
    field = lambda n: F.when(F.col("doc_id") % GEOCODE[n] == 0, F.concat(F.lit(f" {n} "), F.col("doc_id").cast("string"))).alias(n)
    address = F.struct(F.lit(" ").alias("road"), *[field(n) for n in GEOCODE if n not in top]).alias("address")
    body = F.to_json(F.struct(*[field(n) for n in top], address)).alias("body")
    return P.flatten_geocode(V.read(spark, sf_dir, "documents").select("doc_id", body)).drop("body")


def flatten_web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored answer of a search for each event: what it says, what it rests on, and those that say nothing."""
    e = V.read(spark, sf_dir, "events")
    n = lambda k: (F.col("event_id") % k).cast("string")
    link = lambda url, title: F.struct(title.alias("title"), url.alias("url"))
    some = F.concat(F.lit("https://A"), n(7), F.lit(".test:443"))
    call = F.struct(F.lit("web_search_call").alias("type"), F.struct(F.array(link(some, F.when(F.col("event_id") % 3 == 0, F.lit(" t "))), link(F.lit("http://bad.test/"), F.lit("b"))).alias("sources")).alias("action"))
    note = F.struct(link(F.concat(F.lit("https://b.test/p?"), n(11)), F.lit("  ")).alias("url_citation"))
    late = F.struct(link(F.concat(F.lit("https://a"), n(7), F.lit(".test/")), F.lit("late")).alias("url_citation"))
    text = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" "), "event_type", F.lit("\n")))
    parts = F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"), F.array(late, note).alias("annotations")), F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text"), F.array(note).alias("annotations")), F.struct(F.lit("output_text").alias("type"), F.when(F.col("event_id") % 4 == 0, n(9)).alias("text"), F.array(note).alias("annotations")))
    message = F.struct(F.lit("message").alias("type"), parts.alias("content"))
    body = F.concat(F.lit('{"output":['), F.to_json(call), F.lit(","), F.to_json(message), F.lit("]}"))
    read = P.read_web_search(e.select("event_id", body.alias("body")))
    none = F.lit(None).cast("string")
    row = lambda kind, text, url: F.struct(F.lit(kind).alias("kind"), text.alias("text"), url.alias("url"))
    # one row of each kind from one reading of the body
    said = F.concat(F.array(row("answer", F.col("answer"), none)), F.transform(F.coalesce("sources", F.array().cast("array<struct<url:string,pos:int,title:string>>")), lambda s: row("source", s["title"], s["url"])))
    rows = F.when(F.col("answer").isNotNull(), said).otherwise(F.array(row("reject", none, none)))
    return read.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.kind", "r.text", "r.url")


def flatten_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    page = F.struct(F.when(F.col("turn") % 3 > 0, (10 - F.col("turn")).cast("double")).alias("index"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.when(F.col("turn") % 4 != 3, F.lit("  some\n text ")).alias("extract"), F.when(F.col("turn") % 2 == 0, F.lit("https://e.test/wiki/x")).otherwise("http://bad.test/").alias("fullurl"))
    one = c.dropDuplicates(["conv_id", "turn"]).groupBy("conv_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lpad(F.col("turn").cast("string"), 4, "0").alias("k"), page.alias("v"))))).alias("pages"))
    return P.flatten_search(one.select("conv_id", F.to_json(F.struct(F.struct("pages").alias("query"))).alias("body")), "e.test", "conv_id")


QUERIES = {f.__name__: f for f in (decode_elevation, elevation_bounds, raster_pyramid, sample_elevation, ground_tracks_on_terrain, sample_through_cut, ground_tracks_through_cut, raster_neighbours, flatten_geocode, flatten_search, flatten_web_search)}


def _geocode_sql() -> str:
    """The order in which fields speak for a column, in full."""
    by = {"feature_type": ["addresstype", "type"], "road": ["pedestrian", "footway", "cycleway"], "neighbourhood": ["neighbourhood", "quarter"], "district": ["city_district", "borough"]}
    by |= {"region": ["state", "region", "state_district"], "locality": ["city", "town", "village", "municipality", "hamlet"], "water": ["ocean", "sea", "water"]}
    by |= {c: [c] for c in ("display_name", "name", "category", "house_number", "suburb", "postcode", "county", "country", "country_code")}
    said = {c: "coalesce(" + ", ".join(f"CASE WHEN doc_id % {GEOCODE[f]} = 0 THEN '{f} ' || doc_id END" for f in fields) + ")" for c, fields in by.items()}
    said["country_code"] = f"upper({said['country_code']})"
    some = " OR ".join(f"doc_id % {k} = 0" for k in GEOCODE.values())
    return f"SELECT doc_id, {', '.join(f'{v} AS {c}' for c, v in said.items())} FROM documents WHERE {some}"


_R = """wide AS (SELECT CAST(ceil(log2(sqrt(coalesce(max(vec_id), 0) + 1))) AS INT) AS z FROM embeddings), world AS (SELECT z, 1 << z AS w FROM wide),
r AS (SELECT z, w, vec_id % w AS x, vec_id // w AS y, list_transform(embedding, lambda v: v::DOUBLE * 1000) AS e FROM embeddings, world)"""
_S = f"""WITH {V.POSITIONS}, {_R}, p AS (SELECT positions.*, (lon + 180) / 360 * w AS mx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * w AS my FROM positions, world),
q AS (SELECT p.*, r.e, greatest(0, least(7, (mx - floor(mx)) * 8 - 0.5)) AS px, greatest(0, least(7, (my - floor(my)) * 8 - 0.5)) AS py FROM p LEFT JOIN r ON r.x = floor(mx)::BIGINT AND r.y = floor(my)::BIGINT),
w AS (SELECT *, floor(px)::BIGINT AS w, floor(py)::BIGINT AS n, least(floor(px)::BIGINT + 1, 7) AS ea, least(floor(py)::BIGINT + 1, 7) AS so FROM q),
s AS (SELECT id, coalesce((e[n * 8 + w + 1] + (e[n * 8 + ea + 1] - e[n * 8 + w + 1]) * (px - w)) * (1 - (py - n)) + (e[so * 8 + w + 1] + (e[so * 8 + ea + 1] - e[so * 8 + w + 1]) * (px - w)) * (py - n), 0) AS m FROM w)"""
_THROUGH = f"""WITH RECURSIVE {V.FINEST}, {V.cover_sql()}, {_R},
lv AS (SELECT world.z - k.k AS z, 1 << (world.z - k.k) AS w FROM world, range(0, 3) k(k) WHERE k.k <= world.z),
rl AS (SELECT lv.z, vec_id % lv.w AS x, vec_id // lv.w AS y, CASE WHEN vec_id % 2 = 1 THEN 16 ELSE 8 END AS pw, CASE WHEN vec_id % 2 = 1 THEN 4 ELSE 8 END AS ph,
  CASE WHEN vec_id % 9 > 0 THEN list_transform(embedding, lambda v: v::DOUBLE * 1000 + lv.z) END AS e FROM embeddings, lv WHERE vec_id < lv.w * lv.w),
hit AS (SELECT p.id, p.lat, p.lon, c.z, least(c.z, world.z) AS sz FROM positions p JOIN cover c ON p.observer_id = c.cut_id AND {V.tx(z='c.z')} = c.x AND {V.ty(z='c.z')} = c.y, world),
m AS (SELECT *, (lon + 180) / 360 * (1 << sz) AS mx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << sz) AS my FROM hit),
q AS (SELECT m.*, rl.e, rl.pw, rl.ph, greatest(0, least(pw - 1, (mx - floor(mx)) * pw - 0.5)) AS px, greatest(0, least(ph - 1, (my - floor(my)) * ph - 0.5)) AS py FROM m LEFT JOIN rl ON rl.z = sz AND rl.x = floor(mx)::BIGINT AND rl.y = floor(my)::BIGINT),
k AS (SELECT *, floor(px)::BIGINT AS w, floor(py)::BIGINT AS n, least(floor(px)::BIGINT + 1, pw - 1) AS ea, least(floor(py)::BIGINT + 1, ph - 1) AS so FROM q),
s AS (SELECT id, coalesce((e[n * pw + w + 1] + (e[n * pw + ea + 1] - e[n * pw + w + 1]) * (px - w)) * (1 - (py - n)) + (e[so * pw + w + 1] + (e[so * pw + ea + 1] - e[so * pw + w + 1]) * (px - w)) * (py - n), 0) AS m FROM k)"""

ORACLES = {
    "sample_through_cut": f"{_THROUGH} SELECT id, round(coalesce(m, 0), 4) AS elevation_m FROM (SELECT id FROM positions) LEFT JOIN s USING (id)",
    "ground_tracks_through_cut": f"{_THROUGH} SELECT id % 3 = 0 AS on_ground, count(*) AS samples, round(sum(CASE WHEN id % 3 = 0 THEN coalesce(m, 0) ELSE id % 900 END), 2) AS height FROM (SELECT id FROM positions) LEFT JOIN s USING (id) GROUP BY 1",
    "decode_elevation": "WITH b AS (SELECT page_id, substr(md5(html), 1, 16) AS d FROM pages) SELECT page_id, k.k AS pixel, ascii(substr(d, 4 * k.k + 1, 1)) * 256.0::DOUBLE + ascii(substr(d, 4 * k.k + 2, 1)) + ascii(substr(d, 4 * k.k + 3, 1)) / 256.0::DOUBLE - 32768 AS metres FROM b, range(0, 4) k(k)",
    "elevation_bounds": f"WITH {_R} SELECT z, x, y, round(list_min(e), 6) AS low, round(list_max(e), 6) AS high, true AS valid FROM r",
    "raster_pyramid": f"""WITH {_R}, l0 AS (SELECT x, y, 0 AS level, k.k AS pixel, e[k.k + 1] AS m FROM r, range(0, 64) k(k)),
l1 AS (SELECT x, y, 1 AS level, (pixel // 16) * 4 + pixel % 8 // 2 AS pixel, avg(m) AS m FROM l0 GROUP BY ALL), l2 AS (SELECT x, y, 2 AS level, (pixel // 8) * 2 + pixel % 4 // 2 AS pixel, avg(m) AS m FROM l1 GROUP BY ALL), l3 AS (SELECT x, y, 3 AS level, 0 AS pixel, avg(m) AS m FROM l2 GROUP BY ALL)
SELECT x, y, level, pixel, round(m, 4) AS metres FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)""",
    "sample_elevation": f"{_S} SELECT id, round(m, 4) AS elevation_m FROM s",
    "ground_tracks_on_terrain": f"{_S} SELECT id % 3 = 0 AS on_ground, count(*) AS samples, round(sum(CASE WHEN id % 3 = 0 THEN m ELSE id % 900 END), 2) AS height FROM s GROUP BY 1",
    "raster_neighbours": f"""WITH {_R}, b AS (SELECT r.*, k.k AS pixel, k.k % 10 - 1 AS col, k.k // 10 - 1 AS row_ FROM r, range(0, 100) k(k)),
a AS (SELECT *, (x + CASE WHEN col < 0 THEN w - 1 WHEN col > 7 THEN 1 ELSE 0 END) % w AS ox, y + CASE WHEN row_ < 0 THEN -1 WHEN row_ > 7 THEN 1 ELSE 0 END AS oy FROM b)
SELECT a.x, a.y, a.pixel, round(coalesce(o.e[((row_ + 8) % 8) * 8 + (col + 8) % 8 + 1], a.e[greatest(0, least(7, row_)) * 8 + greatest(0, least(7, col)) + 1]), 6) AS metres FROM a LEFT JOIN r o ON o.x = a.ox AND o.y = a.oy""",
    "flatten_geocode": _geocode_sql(),
    "flatten_web_search": """WITH s AS (SELECT *, event_id % 5 > 0 AS first, event_id % 4 = 0 AS second FROM events), g AS (SELECT * FROM s WHERE first OR second)
SELECT event_id, 'answer' AS kind, CASE WHEN first AND second THEN event_type || chr(10) || event_id % 9 WHEN first THEN event_type ELSE (event_id % 9)::VARCHAR END AS text, NULL::VARCHAR AS url FROM g
UNION ALL SELECT event_id, 'source', CASE WHEN event_id % 3 = 0 THEN 't' ELSE 'a' || event_id % 7 || '.test' END, 'https://a' || event_id % 7 || '.test/' FROM g
UNION ALL SELECT event_id, 'source', 'b.test', 'https://b.test/p?' || event_id % 11 FROM g
UNION ALL SELECT event_id, 'reject', NULL, NULL FROM s WHERE NOT (first OR second)""",
    "flatten_search": "WITH c AS (SELECT conv_id, turn, any_value(role) AS role FROM conversations WHERE text IS NOT NULL GROUP BY ALL) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 > 0 THEN 10 - turn ELSE 0 END, turn) AS rank, role || ' ' || turn AS title, 'some text' AS summary, CASE WHEN turn % 2 = 0 THEN 'https://e.test/wiki/x' ELSE 'https://e.test/wiki/' || role || '_' || turn END AS url FROM c WHERE turn % 4 <> 3",
}
