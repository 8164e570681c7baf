"""Orders of fetches, leaves by zoom, horizons, and readers and writers that had no test."""

import math
import struct
import zlib

from pyspark.sql import functions as F

from tilewright.operators import tiles
from tilewright.sources import files


def test_fetches_by_priority_then_sequence(spark):
    rows = [("a", 1, 5), ("a", 9, 7), ("a", 9, 2), ("a", None, 1), ("b", 3, 3), ("b", 3, 1), ("c", 99, 0)]
    df = spark.createDataFrame(rows, "provider string, priority int, sequence long")
    got = [tuple(r) for r in tiles.fetch_order(df).collect()]
    assert got == [("c", 99, 0), ("a", 9, 2), ("a", 9, 7), ("b", 3, 1), ("b", 3, 3), ("a", 1, 5), ("a", None, 1)]
    first = {tuple(r) for r in tiles.fetch_order(df, {"a": 2, "b": 1}).collect()}
    assert first == {("a", 9, 2, 1), ("a", 9, 7, 2), ("b", 3, 1, 1)}
    assert tiles.fetch_order(df, {}).count() == 0 and tiles.fetch_order(df.limit(0), {"a": 1}).count() == 0


def test_a_long_provider_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("provider"), (F.col("id") % 7).alias("priority"), F.col("id").alias("sequence"))
    plan = tiles.fetch_order(df, {"a": 4})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_leaves_by_zoom(spark):
    cut = spark.createDataFrame([("c", 1, 0, 0, "outer"), ("c", 1, 1, 0, "outer"), ("c", 2, 0, 2, "finest"), ("d", 0, 0, 0, "finest")], "k string, z int, x long, y long, role string")
    got = sorted(map(tuple, tiles.leaves_by_zoom(cut, ["k"]).collect()))
    assert got == [("c", 1, "outer", 2, 0.5), ("c", 2, "finest", 1, 0.0625), ("d", 0, "finest", 1, 1.0)]


def test_horizon(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (5.0, -3.0), (1000.0, 2.0)], "radius_m double, height_m double")
    got = [r.asDict() for r in tiles.with_horizon(df).collect()]
    assert math.isclose(got[0]["horizon_deg"], 60) and math.isclose(got[0]["horizon_diameter_m"], 2 * math.pi / 3)
    assert got[1]["horizon_rad"] == got[2]["horizon_rad"] == 0
    assert math.isclose(got[3]["horizon_source_km"], 6371.0088 * math.acos(1000 / 1002))


def png(width, height):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + b"".join(bytes([x, y, 9]) for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_raster_tiles(spark, tmp_path):
    for at, data in {"3/1/2.png": png(4, 4), "3/1/3.png": png(2, 4), "3/5/0.png": b"no image", "other/a.png": png(4, 4)}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(data)
    good, bad = files.read_raster_tiles(spark, str(tmp_path), 4)
    row = good.collect()
    assert [(r["z"], r["x"], r["y"], r["width"], r["height"], r["channels"]) for r in row] == [(3, 1, 2, 4, 4, 3)]
    assert bytes(row[0]["data"][:6]) == bytes([9, 0, 0, 9, 0, 1])  # rows from the top, blue first
    assert sorted("/".join(r["origin"].split("/")[-3:])[-9:] for r in bad.collect()) == ["3/1/3.png", "3/5/0.png", "her/a.png"]


def test_track_state_is_written_by_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("s", "A", 1)], "session string, id string, seq long").coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema("session string, id string, seq long").parquet(folder)
    files.write_track_state(stream(), f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
    spark.createDataFrame([("s", "A", 2), ("s", "B", 2)], "session string, id string, seq long").coalesce(1).write.mode("append").parquet(folder)
    files.write_track_state(stream(), f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("session", "id").agg(F.max_by("seq", "batch").alias("seq"))
    assert sorted(map(tuple, got.collect())) == [("s", "A", 2), ("s", "B", 2)]
