"""Readers and writers on files of their own."""

import json

from pyspark.sql import functions as F

from tilewright.operators.tracks import normalise_tracks, valid_orbital_elements
from tilewright.sources import files


def test_track_messages(spark, tmp_path):
    track = {"id": " ab1 ", "revision": 3, "current": {"latitudeDegrees": 1.5, "longitudeDegrees": 2, "onGround": False}, "trajectory": {"offsetMs": [0, 5, 5, 9], "latitudeDegrees": [1, 2, 3, 4], "longitudeDegrees": [1, 2, 3, 4]}}
    lines = [{"version": 1, "type": "track.snapshot", "session": "s", "seq": 1, "tracks": [track, {"id": "x", "current": {"latitudeDegrees": "no"}}]}, {"version": 2, "type": "track.delta"}, {"version": 1, "type": "other"}]
    (tmp_path / "m.json").write_text("\n".join([*map(json.dumps, lines), "{bad"]))
    good, bad = files.read_track_messages(spark, str(tmp_path))
    assert [r["type"] for r in good.collect()] == ["track.snapshot"] and bad.count() == 2
    tracks = normalise_tracks(good.select("session", "seq", F.explode("tracks").alias("track"), F.lit(7).alias("received_ms"))).collect()
    assert len(tracks) == 1 and tracks[0]["id"] == "AB1" and tracks[0]["callsign"] == "ab1" and [p["offset_ms"] for p in tracks[0]["points"]] == [0, 5, 9]
    assert tracks[0]["generated_at_ms"] == 7 and tracks[0]["valid_until_ms"] == 16


def test_catalogues_and_elements(spark, tmp_path):
    (tmp_path / "stations.json").write_text('[{"NORAD_CAT_ID": 5, "OBJECT_NAME": "A"},\n{"NORAD_CAT_ID": 6}]')
    (tmp_path / "broken.json").write_text('{"error": 1}')
    rows, bad = files.read_orbital_catalogues(spark, str(tmp_path))
    assert sorted((r["source_group"], r["pos"], r["rec"]["NORAD_CAT_ID"]) for r in rows.collect()) == [("stations", 0, "5"), ("stations", 1, "6")]
    assert [r["source_group"] for r in bad.collect()] == ["broken"]
    number = ("MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "NORAD_CAT_ID", "ELEMENT_SET_NO", "BSTAR", "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT")
    whole = dict.fromkeys(number, 1.5) | {"OBJECT_NAME": "A", "OBJECT_ID": "B", "EPOCH": "C"}
    tries = [whole, whole | {"BSTAR": " 1e-4 "}, whole | {"EPOCH": 5}, whole | {"BSTAR": ""}, whole | {"BSTAR": "1d"}, whole | {"BSTAR": "Infinity"}, {k: v for k, v in whole.items() if k != "EPOCH"}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tries)] + [(7, None), (8, "{"), (9, "[]")], "i int, record string")
    good, rest = valid_orbital_elements(df)
    assert sorted(r["i"] for r in good.collect()) == [0, 1] and rest.count() == 8


def test_stars_responses_logs(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 4, 5)], "x int, y int, z int, magnitude int, temperature int").write.parquet(f"{tmp_path}/stars")
    assert files.read_star_catalogue(spark, f"{tmp_path}/stars").dtypes == [(c, "double") for c in ("x", "y", "z", "magnitude", "temperature")]
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "k1.json").write_text('{"a":\n1}')
    assert [tuple(r) for r in files.read_response_archive(spark, f"{tmp_path}/answers").collect()] == [("k1", '{"a":\n1}')]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"seq": 1, "kind": "request", "z": 3}\n{"seq": "x"}')
    assert [(r["seq"], r["kind"], r["z"], r["status"]) for r in files.read_request_log(spark, f"{tmp_path}/log").collect()] == [(1, "request", 3, None), (None, None, None, None)]
    assert files.read_metric_log(spark, f"{tmp_path}/log").columns == ["session", "ts_ms", "seq", "interval_ms", "rendered"]


def test_cuts_and_pyramids(spark, tmp_path):
    cut = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "z int, x long, y long")
    files.write_cut(cut, f"{tmp_path}/cut")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/cut").select("z", "x", "y").collect())) == [(1, 0, 0), (2, 1, 1)]
    levels = spark.createDataFrame([(3, 1, 2, 0, 2, 1, [1.0, 2.0]), (3, 1, 2, 1, 1, 1, [1.5])], "z int, x long, y long, level int, width int, height int, elevation array<double>")
    files.write_pyramid(levels, f"{tmp_path}/pyramid")
    assert [r["elevation"] for r in spark.read.parquet(f"{tmp_path}/pyramid").filter("level = 1").collect()] == [[1.5]]
