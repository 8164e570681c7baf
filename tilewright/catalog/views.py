"""Inputs of the operators, derived from the given tables by integer arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("observer_id"), "ts", ((F.col("event_id") * 7919) % 170001 / 1000.0 - 85.0).alias("lat"), ((F.col("event_id") * 104729) % 360000 / 1000.0 - 180.0).alias("lon"))


POSITIONS = """positions AS (SELECT event_id AS id, user_id AS observer_id, ts, ((event_id * 7919) % 170001) / 1000.0::DOUBLE - 85.0::DOUBLE AS lat,
  ((event_id * 104729) % 360000) / 1000.0::DOUBLE - 180.0::DOUBLE AS lon FROM events)"""


def observers(spark: SparkSession, sf_dir: str, turn: int = 1) -> DataFrame:
    """The latest place of each observer; turn 2 is the one before it."""
    w = Window.partitionBy("observer_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    last = positions(spark, sf_dir).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") == turn)
    return last.select("observer_id", "lat", "lon", (4 + F.col("observer_id") % 7).cast("int").alias("max_zoom"))


OBSERVERS = f"""{POSITIONS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY observer_id ORDER BY ts DESC, id DESC) AS turn FROM positions),
observers AS (SELECT observer_id, lat, lon, 4 + observer_id % 7 AS max_zoom FROM ranked WHERE turn = 1)"""

#: Longitude and latitude to tiles, as SQL.
TX = "(CAST(floor(({lon} + 180) / 360 * (1 << {z})) AS BIGINT) % (1 << {z}))"
TY = "greatest(0, least((1 << {z}) - 1, CAST(floor((1 - ln(tan(radians(greatest(-85.05112878, least(85.05112878, {lat})))) + 1 / cos(radians(greatest(-85.05112878, least(85.05112878, {lat}))))) / pi()) / 2 * (1 << {z})) AS BIGINT)))"


def tx(lon: str = "lon", z: str = "z") -> str:
    return TX.format(lon=lon, z=z)


def ty(lat: str = "lat", z: str = "z") -> str:
    return TY.format(lat=lat, z=z)


#: Blocks of finest tiles; the view's latitudes are inside +-85, so zooms don't drop.
TARGETS = f"""{OBSERVERS},
rows_at AS (SELECT *, max_zoom AS zoom, {tx(z="max_zoom")} AS tx, {ty(z="max_zoom")} AS ty, (1 << max_zoom) AS w FROM observers),
modes AS (SELECT *, CASE WHEN w < 8 THEN 'normal' WHEN ty < 2 THEN 'north-boundary' WHEN ty > w - 3 THEN 'south-boundary' ELSE 'normal' END AS mode FROM rows_at),
targets AS (SELECT observer_id, mode, zoom, w,
  CASE WHEN mode = 'normal' THEN CASE WHEN w <= 8 THEN 0 ELSE tx - 3 END WHEN w < 8 THEN 0 ELSE CAST(floor((tx - 2) / 4.0) AS BIGINT) * 4 END AS block_x,
  CASE WHEN mode = 'normal' THEN CASE WHEN w <= 8 THEN 0 ELSE greatest(0, least(w - 8, ty - 3)) END WHEN mode = 'north-boundary' THEN 0 ELSE w - least(8, w) END AS block_y,
  least(8, w) AS side FROM modes)"""

FINEST = f"""{TARGETS},
finest AS (SELECT DISTINCT observer_id, zoom AS z, ((block_x + i.i) % w + w) % w AS x, block_y + j.j AS y
  FROM targets, range(0, 8) i(i), range(0, 8) j(j) WHERE i.i < side AND j.j < side AND block_y + j.j BETWEEN 0 AND w - 1)"""

#: The cover as a fixed point: every tile of a family asks for the tiles around the place that it faces, one zoom up, with their families.
COVER_STEP = """{name}_all(cut_id, z, x, y) AS (
  SELECT DISTINCT observer_id, z, (x // 2) * 2 + i.i, (y // 2) * 2 + j.j FROM {finest}, range(0, 2) i(i), range(0, 2) j(j) WHERE z > 0
  UNION
  SELECT DISTINCT cut_id, z - 1, (ax // 2) * 2 + i.i, (ay // 2) * 2 + j.j FROM (
    SELECT cut_id, z, ((x // 2 + dx.d * CASE WHEN x % 2 = 0 THEN -1 ELSE 1 END) % (1 << (z - 1)) + (1 << (z - 1))) % (1 << (z - 1)) AS ax, y // 2 + dy.d * CASE WHEN y % 2 = 0 THEN -1 ELSE 1 END AS ay
    FROM {name}_all, range(0, 2) dx(d), range(0, 2) dy(d) WHERE z > 1) s, range(0, 2) i(i), range(0, 2) j(j) WHERE ay BETWEEN 0 AND (1 << (z - 1)) - 1),
{name}_made AS (SELECT cut_id, z, x, y FROM {name}_all UNION SELECT DISTINCT observer_id, 0, 0, 0 FROM {finest}),
{name} AS (SELECT m.cut_id, m.z, m.x, m.y FROM {name}_made m ANTI JOIN (SELECT DISTINCT cut_id, z - 1 AS z, x // 2 AS x, y // 2 AS y FROM {name}_made WHERE z > 0) p USING (cut_id, z, x, y))"""


def cover_sql(name: str = "cover", finest: str = "finest") -> str:
    return COVER_STEP.format(name=name, finest=finest)


def two_covers_sql() -> str:
    """old_cut and new_cut: the covers of the place before the latest and of the latest."""
    later = FINEST
    earlier = FINEST.split(",\nranked", 1)[1].replace("turn = 1", "turn = 2")
    for name in ("ranked", "observers", "rows_at", "modes", "targets", "finest"):
        earlier = earlier.replace(f"{name} AS", f"{name}_b AS").replace(f"FROM {name}", f"FROM {name}_b")
    earlier = "ranked_b" + earlier[2:] if earlier.startswith("_b") else "ranked_b" + earlier
    return f"{later},\n{earlier},\n{cover_sql('new_cut')},\n{cover_sql('old_cut', 'finest_b')}"
