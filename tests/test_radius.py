"""Pairs within a radius meet by cells in tasks, whatever the centres' size is thought to be."""

import math
import random

from tilewright.operators.tracks import tracks_within_radius


def test_centres_do_not_go_through_the_driver(spark):
    r = random.Random(8)
    place = lambda i: (i, math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    tracks, centres = [place(i) for i in range(400)], [place(i) for i in range(60)]
    met = tracks_within_radius(spark.createDataFrame(tracks, "id long, lat double, lon double"), spark.createDataFrame(centres, "centre long, c_lat double, c_lon double"), 700.0)
    unit = lambda lat, lon: (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    angle = lambda a, b: 2 * math.asin(min(1.0, math.dist(unit(*map(math.radians, a)), unit(*map(math.radians, b))) / 2))
    want = {(c, i) for c, *a in centres for i, *b in tracks if angle(a, b) <= 700 * 1.852 / 6371.0088}
    got = [(p["centre"], p["id"]) for p in met.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
