"""Readers and writers. A reader gives fixed columns; what it can't take goes to a table of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "generatedAtMs double, validUntilMs double, offsetMs array<double>, latitudeDegrees array<double>, longitudeDegrees array<double>, altitudeFt array<double>, courseDegrees array<double>, headingDegrees array<double>"
CURRENT = "latitudeDegrees double, longitudeDegrees double, altitudeFt double, onGround boolean, groundSpeedKt double, courseDegrees double, headingDegrees double, verticalRateFpm double"
TRACK = f"struct<id:string, revision:double, observedAtMs:double, callsign:string, registration:string, aircraftType:string, emitterCategory:string, current:struct<{CURRENT.replace(' double', ':double').replace(' boolean', ':boolean')}>, trajectory:struct<{POINTS.replace(' double', ':double').replace(' array', ':array')}>>"
MESSAGE = f"type string, version int, session string, seq long, tracks array<{TRACK}>, upsert array<{TRACK}>, remove array<string>, message string"
KINDS = ("session.ready", "track.snapshot", "track.delta", "error")


def read_track_messages(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of one JSON text a line. A message of another version is rejected; one of an unknown type is left out."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    parsed = lines.select(F.col("value").alias("body"), F.from_json("value", MESSAGE).alias("m"))
    good = F.coalesce(F.col("m.version") == 1, F.lit(False))
    return parsed.filter(good & F.col("m.type").isin(*KINDS)).select("m.*"), parsed.filter(~good).select("body")


def read_orbital_catalogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): source_group from the file's name, pos in its array and the record as a map; a file that is no array is rejected."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("source_group"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    parsed = files.withColumn("rec", F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<map<string,string>>")))
    return parsed.select("source_group", "fetched_at", F.posexplode("rec").alias("pos", "rec")), parsed.filter("rec IS NULL").select("source_group", "value")


def read_raster_tiles(spark: SparkSession, path: str, tile_pixels: int) -> tuple[DataFrame, DataFrame]:
    """(tiles (z, x, y, width, height, channels, data), rejects) of images at z/x/y.*; what is no image and other sizes are rejected. Spark passes over files of no bytes."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    part = lambda k: F.regexp_extract("origin", r"(\d+)/(\d+)/(\d+)\.[^/.]+$", k)
    tiles = images.select("origin", part(1).try_cast("int").alias("z"), part(2).try_cast("long").alias("x"), part(3).try_cast("long").alias("y"), "width", "height", F.col("nChannels").alias("channels"), "data")
    good = F.coalesce(F.col("z").isNotNull() & (F.col("width") == tile_pixels) & (F.col("height") == tile_pixels) & (F.octet_length("data") > 0), F.lit(False))
    return tiles.filter(good).drop("origin"), tiles.filter(~good).select("origin", "width", "height")


def read_star_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "magnitude", "temperature")])


def read_response_archive(spark: SparkSession, path: str) -> DataFrame:
    """(request_key, body) of one stored response a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("request_key"), F.col("value").alias("body"))


LOG = "seq long, revision long, kind string, z int, x long, y long, provider string, request_id string, status int, retry_after_ms long, ts_ms long, duration_ms double"


def read_request_log(spark: SparkSession, path: str, kind: str = "json", streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).schema(LOG).format(kind).load(path)


METRICS = "session string, ts_ms long, seq long, interval_ms double, rendered boolean"


def read_metric_log(spark: SparkSession, path: str, kind: str = "json", streaming: bool = False) -> DataFrame:
    """Samples of frames, as ``rolling_frame_window`` takes them."""
    return (spark.readStream if streaming else spark.read).schema(METRICS).format(kind).load(path)


def write_pyramid(df: DataFrame, path: str) -> None:
    """Levels of rasters, a folder for each zoom and level, so that a reader of coarse levels reads little."""
    df.write.mode("overwrite").partitionBy("z", "level").parquet(path)


def write_cut(df: DataFrame, path: str) -> None:
    """One folder for each zoom, so that a reader of some zooms skips the rest."""
    df.write.mode("overwrite").partitionBy("z").parquet(path)


def write_track_state(stream: DataFrame, path: str, checkpoint: str):
    """Each batch of a state stream as a folder of its own; the latest batch of a session and track holds."""
    return stream.writeStream.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
