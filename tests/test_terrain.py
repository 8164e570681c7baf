"""Terrain under points through a cut, against a loop over zooms and pixels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators.rasters import ground_tracks_on_terrain, sample_elevation

LIMIT = 85.05112878


def place(lat, lon, z):
    w, rad = 1 << z, math.radians(max(-LIMIT, min(LIMIT, lat)))
    return ((lon + 180) % 360) / 360 * w, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * w


def plain(lat, lon, cut, rasters, top, deepest):
    if lat is None or lon is None or not math.isfinite(lat) or not math.isfinite(lon) or abs(lat) > LIMIT:
        return 0.0
    for z in range(deepest, -1, -1):
        mx, my = place(lat, lon, z)
        x, y = int(mx) % (1 << z), max(0, min((1 << z) - 1, int(my)))
        if (z, x, y) not in cut:
            continue
        up = max(0, z - top)
        found = rasters.get((z - up, x >> up, y >> up))
        if found is None or found[2] is None:
            return 0.0
        w, h, e = found
        u, v = ((x % (1 << up)) + mx - x) / (1 << up), ((y % (1 << up)) + my - y) / (1 << up)
        px, py = max(0, min(w - 1, u * w - 0.5)), max(0, min(h - 1, v * h - 0.5))
        west, north = int(px), int(py)
        east, south = min(west + 1, w - 1), min(north + 1, h - 1)
        upper = e[north * w + west] + (e[north * w + east] - e[north * w + west]) * (px - west)
        lower = e[south * w + west] + (e[south * w + east] - e[south * w + west]) * (px - west)
        return upper + (lower - upper) * (py - north)
    return 0.0


def divided(r, z, x, y, deepest):
    """Leaves of a random quadtree below a tile."""
    if z < deepest and (z < 2 or r.random() < 0.5):
        return [leaf for i in (0, 1) for j in (0, 1) for leaf in divided(r, z + 1, 2 * x + i, 2 * y + j, deepest)]
    return [(z, x, y)]


@pytest.mark.parametrize("top", [0, 2, 5])
def test_terrain_is_that_of_the_deepest_tile(spark, top):
    r = random.Random(top)
    cuts = {c: set(divided(r, 0, 0, 0, 5)) for c in ("a", "b")}
    cuts["b"] = {t for t in cuts["b"] if r.random() < 0.9}  # holes
    rasters = {}
    for z in range(top + 1):
        for x in range(1 << z):
            for y in range(1 << z):
                w, h = r.choice([(1, 1), (8, 8), (9, 17), (20, 3)])
                if z == 0 or r.random() < 0.9:
                    rasters[z, x, y] = (w, h, None if z and r.random() < 0.1 else [r.uniform(-100, 3000) for _ in range(w * h)])
    points = [(k, r.choice("ab"), r.uniform(-89, 89), r.uniform(-180, 180)) for k in range(300)]
    odd = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (0.0, float("inf")), (85.2, 0.0), (LIMIT, -180.0), (-LIMIT, 180.0), (0.0, 0.0), (84.9, 179.999999), (10.0, 10.0), (10.0, 10.0)]
    points += [(1000 + k, "a", *p) for k, p in enumerate(odd)] + [(2000, "none", 1.0, 1.0), (2001, None, 1.0, 1.0)]
    df = spark.createDataFrame(points, "id long, cut_id string, lat double, lon double")
    cut = spark.createDataFrame([(c, *t) for c, tiles in cuts.items() for t in tiles], "cut_id string, z int, x long, y long")
    grid = spark.createDataFrame([(*t, w, h, e) for t, (w, h, e) in rasters.items()], "z int, x long, y long, width int, height int, elevation array<double>")
    got = {row["id"]: row["elevation_m"] for row in sample_elevation(df, cut, grid, top, 5, ["cut_id"]).collect()}
    assert len(got) == len(points)
    for k, c, lat, lon in points:
        assert got[k] == pytest.approx(plain(lat, lon, cuts.get(c, set()), rasters, top, 5), abs=1e-6), (k, c, lat, lon)
    assert any(v != 0 for v in got.values())
    samples = df.withColumns({"on_ground": F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1), "altitude": F.col("id")})
    heights = {row["id"]: row["height"] for row in ground_tracks_on_terrain(samples, cut, grid, top, 5, ["cut_id"]).collect()}
    assert all(heights[k] == (pytest.approx(got[k]) if k % 3 == 1 else k) for k in got)


def test_no_points_no_rasters_clashing_names(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    cut = spark.createDataFrame([(0, 0, 0)], "z int, x long, y long")
    grid = spark.createDataFrame([], "z int, x long, y long, width int, height int, elevation array<double>")
    assert [r["elevation_m"] for r in sample_elevation(df, cut, grid, 3, 3).collect()] == [0.0]
    assert sample_elevation(df.limit(0), cut, grid, 3, 3).collect() == []
    with pytest.raises(ValueError):
        sample_elevation(df.withColumn("z", F.lit(1)), cut, grid, 3, 3)
