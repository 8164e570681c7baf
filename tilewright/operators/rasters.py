"""Elevation rasters: a row for each tile with its values as an array, row by row; pixel bytes are decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators.tiles import map_to_source_tiles, with_covering_tile

#: What a provider's elevation can be, where a tile's own isn't known.
LOWEST, HIGHEST = -32768.0, 32767 + 255 / 256


def decode_elevation(tiles: DataFrame, channels: int = 4) -> DataFrame:
    """data (bytes, ``channels`` a pixel, the first three of them red, green and blue) as elevation array<double> in metres."""
    keep = [c for c in tiles.columns if c != "data"]
    schema = tiles.drop("data").withColumn("elevation", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("data").to_pylist():
                p = None if data is None else np.frombuffer(data, np.uint8).reshape(-1, channels).astype(float)
                out.append(None if p is None else p[:, 0] * 256 + p[:, 1] + p[:, 2] / 256 - 32768)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))], schema.names)

    return tiles.select(*keep, "data").mapInArrow(run, schema)


def elevation_bounds(tiles: DataFrame) -> DataFrame:
    """low and high of each tile, the provider's own where there is no elevation, and whether they are sound."""
    finite = F.filter("elevation", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    low, high = F.coalesce(F.array_min(finite), F.lit(LOWEST)), F.coalesce(F.array_max(finite), F.lit(HIGHEST))
    return tiles.withColumns({"low": low, "high": high}).withColumn("valid", F.col("low") <= F.col("high"))


def raster_pyramid(tiles: DataFrame) -> DataFrame:
    """(z, x, y, level, width, height, elevation): each level is half of the one before, by box means, down to one value."""
    schema = "z int, x long, y long, level int, width int, height int, elevation array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for r in batch.to_pylist():
                now, level = np.array(r["elevation"], float).reshape(r["height"], r["width"]), 0
                while True:
                    rows.append((r["z"], r["x"], r["y"], level, now.shape[1], now.shape[0], now.ravel()))
                    if now.shape == (1, 1):
                        break
                    h, w = max(1, now.shape[0] // 2), max(1, now.shape[1] // 2)
                    ys, xs = np.arange(h) * now.shape[0] // h, np.arange(w) * now.shape[1] // w
                    counts = np.outer(np.diff(np.append(ys, now.shape[0])), np.diff(np.append(xs, now.shape[1])))
                    now, level = np.add.reduceat(np.add.reduceat(now, ys, 0), xs, 1) / counts, level + 1
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], ["z", "x", "y", "level", "width", "height", "elevation"])

    return tiles.select("z", "x", "y", "width", "height", "elevation").mapInArrow(run, schema)


#: Rows of a batch that are taken as Python objects at a time, which need many times the memory of Arrow's.
AT_A_TIME = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, AT_A_TIME):
            yield batch.slice(first, AT_A_TIME)


#: Pixels of a raster travel to points in squares of this side, each with the next row and column along.
SQUARE = 8


def _squares(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __bx, __by, __side, __pixels): squares of the rasters' pixels, so that the four around any point are in one of them."""
    w, h = F.col("width"), F.col("height")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((h - 1) / SQUARE).cast("int")))
    split = rasters.filter(F.col("elevation").isNotNull() & (w > 0) & (h > 0)).withColumn("__by", tiles).withColumn("__bx", F.explode(F.sequence(F.lit(0), F.floor((w - 1) / SQUARE).cast("int"))))
    side = F.least(F.lit(SQUARE + 1), w - F.col("__bx") * SQUARE)
    last = F.least(F.col("__by") * SQUARE + SQUARE, h - 1)
    rows = F.transform(F.sequence(F.col("__by") * SQUARE, last), lambda r: F.slice("elevation", (r * w + F.col("__bx") * SQUARE + 1).cast("int"), side.cast("int")))
    return split.select(*keys, "__bx", "__by", side.alias("__side"), F.flatten(rows).alias("__pixels"))


def _bilinear(at: DataFrame, rasters: DataFrame, keys: list[str], u: Column, v: Column) -> DataFrame:
    """at with elevation_m: between the four pixels around (u, v) of the raster with the same keys, u and v in [0, 1] from its north-west corner; 0 without such a raster.

    What is shuffled of a raster is its squares, and only of rasters that a point asks for; a point meets one square, so no raster is copied for each point, and points
    that share a raster are dealt out by their squares.
    """
    asked = at.select(*keys).filter(F.col(keys[-1]).isNotNull()).distinct()
    held = rasters.select(*keys, "width", "height", "elevation").join(asked, keys, "left_semi")
    sizes = held.filter(F.col("elevation").isNotNull()).select(*keys, "width", "height")
    met = at.join(sizes, keys, "left")
    px = geo.clamp(u * F.col("width") - 0.5, F.lit(0.0), F.col("width") - 1)
    py = geo.clamp(v * F.col("height") - 0.5, F.lit(0.0), F.col("height") - 1)
    met = met.withColumns({"__px": px, "__py": py}).withColumns({"__bx": F.floor(F.floor("__px") / SQUARE).cast("int"), "__by": F.floor(F.floor("__py") / SQUARE).cast("int")})
    met = met.join(_squares(held, keys), [*keys, "__bx", "__by"], "left")
    west, north = F.floor("__px"), F.floor("__py")
    east, south = F.least(west + 1, F.col("width") - 1), F.least(north + 1, F.col("height") - 1)
    value = lambda col, row: F.element_at("__pixels", ((row - F.col("__by") * SQUARE) * F.col("__side") + col - F.col("__bx") * SQUARE + 1).cast("int"))
    mix = lambda a, b, s: a + (b - a) * s
    dx, dy = F.col("__px") - west, F.col("__py") - north
    upper, lower = mix(value(west, north), value(east, north), dx), mix(value(west, south), value(east, south), dx)
    return met.withColumn("elevation_m", F.when(F.col("__pixels").isNotNull(), mix(upper, lower, dy)).otherwise(0.0))


def sample_one_zoom(points: DataFrame, rasters: DataFrame, zoom: int) -> DataFrame:
    """points with elevation_m: bilinear among the four pixels around them in the raster of their tile; 0 without a raster or off the map."""
    on = geo.finite("lat") & geo.finite("lon") & (F.abs(F.col("lat")) <= geo.MAX_LATITUDE)
    at = points.select("*", *[F.when(on, c).alias(n) for n, c in {"__z": F.lit(zoom), "__x": geo.tile_x("lon", F.lit(zoom)), "__y": geo.tile_y("lat", F.lit(zoom))}.items()])
    own = rasters.withColumnsRenamed({"z": "__z", "x": "__x", "y": "__y"})
    out = _bilinear(at, own, ["__z", "__x", "__y"], geo.mercator_x("lon", F.lit(zoom)) - F.col("__x"), geo.mercator_y("lat", F.lit(zoom)) - F.col("__y"))
    return out.select(*points.columns, "elevation_m")


def sample_elevation(points: DataFrame, cut: DataFrame, rasters: DataFrame, max_source_zoom: int, max_zoom: int, keys: list[str] | None = None) -> DataFrame:
    """points with elevation_m: the terrain that a cut shows under them.

    The deepest tile of the cut over a point is drawn from the raster of its ancestor at ``max_source_zoom`` at most, cropped to the tile's part of it; there the height is
    bilinear among the four pixels around the point. Covered by a tile without a raster, or by none (off the map, a null or infinite place), a point has 0.
    ``keys`` choose a point's cut. A cut may have holes. points: (lat, lon, keys, ...), cut: (keys, z, x, y), rasters: (z, x, y, width, height, elevation).
    """
    keys = keys or []
    refused = {"z", "x", "y", "source", "elevation_m"} & set(points.columns)
    if refused:
        raise ValueError(f"points have columns that are about to be added: {', '.join(sorted(refused))}; rename them first")
    there = geo.finite("lat") & geo.finite("lon")
    placed = points.withColumns({"__lat": F.when(there, F.col("lat").cast("double")), "__lon": F.when(there, F.col("lon").cast("double"))})
    at = map_to_source_tiles(with_covering_tile(placed, cut, max_zoom, keys, "__lat", "__lon"), max_source_zoom)
    inside = {"__u": geo.mercator_x("__lon", "z") - F.col("x"), "__v": geo.mercator_y("__lat", "z") - F.col("y")}
    at = at.withColumns({**inside, "__z": F.col("source.source_z"), "__x": F.col("source.source_x"), "__y": F.col("source.source_y")})
    crop = lambda offset, local: (F.col(f"source.{offset}") + F.col(local)) / F.col("source.scale")
    own = rasters.withColumnsRenamed({"z": "__z", "x": "__x", "y": "__y"})
    return _bilinear(at, own, ["__z", "__x", "__y"], crop("offset_x", "__u"), crop("offset_y", "__v")).select(*points.columns, "elevation_m")


def _on_terrain(samples: DataFrame, sample, altitude: str) -> DataFrame:
    ground = F.coalesce("on_ground", F.lit(False))
    low = sample(samples.filter(ground)).withColumnRenamed("elevation_m", "height")
    return low.unionByName(samples.filter(~ground).withColumn("height", F.col(altitude).cast("double")))


def ground_tracks_on_one_zoom(samples: DataFrame, rasters: DataFrame, zoom: int, altitude: str = "altitude") -> DataFrame:
    """height: the terrain's under samples on the ground, the altitude of the others."""
    return _on_terrain(samples, lambda ground: sample_one_zoom(ground, rasters, zoom), altitude)


def ground_tracks_on_terrain(samples: DataFrame, cut: DataFrame, rasters: DataFrame, max_source_zoom: int, max_zoom: int, keys: list[str] | None = None, altitude: str = "altitude") -> DataFrame:
    """height: what the cut shows under samples on the ground, the altitude of the others."""
    return _on_terrain(samples, lambda ground: sample_elevation(ground, cut, rasters, max_source_zoom, max_zoom, keys), altitude)


def raster_neighbours(tiles: DataFrame, border: int) -> DataFrame:
    """(z, x, y, width, height, elevation) with a border from the eight neighbours; x wraps; where none is, the own edge is continued."""
    w = geo.width("z")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = tiles.select("z", "x", "y", "width", "height", "elevation").withColumn("d", steps)
    sent = sent.withColumns({"x": F.pmod(F.col("x") - F.col("d.i"), w), "y": F.col("y") - F.col("d.j")}).filter((F.col("y") >= 0) & (F.col("y") < w))
    held = sent.join(tiles.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    parts = held.groupBy("z", "x", "y").agg(F.max(F.when((F.col("d.i") == 0) & (F.col("d.j") == 0), F.struct("width", "height"))).alias("size"), F.collect_list(F.struct(F.col("d.i").alias("i"), F.col("d.j").alias("j"), "width", "height", "elevation")).alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for r in batch.to_pylist():
                near = {(p["i"], p["j"]): np.array(p["elevation"], float).reshape(p["height"], p["width"]) for p in r["around"]}
                own = near[0, 0]
                h, wd = own.shape
                out = np.pad(own, border, mode="edge")
                for (i, j), other in near.items():
                    if (i, j) != (0, 0) and other.shape == own.shape:
                        ys = {-1: (slice(0, border), slice(h - border, h)), 0: (slice(border, border + h), slice(0, h)), 1: (slice(border + h, None), slice(0, border))}[j]
                        xs = {-1: (slice(0, border), slice(wd - border, wd)), 0: (slice(border, border + wd), slice(0, wd)), 1: (slice(border + wd, None), slice(0, border))}[i]
                        out[ys[0], xs[0]] = other[ys[1], xs[1]]
                rows.append((r["z"], r["x"], r["y"], out.shape[1], out.shape[0], out.ravel()))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["z", "x", "y", "width", "height", "elevation"])

    return parts.mapInArrow(run, "z int, x long, y long, width int, height int, elevation array<double>")
