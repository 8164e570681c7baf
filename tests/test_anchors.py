import math
import random

from test_streaming import streamed

from tilewright.functions import geo
from tilewright.streaming.anchors import NAMES, Anchor, anchor_stream, anchor_targets


def moves():
    r = random.Random(8)
    rows, at = [], {k: [r.uniform(-70, 70), r.uniform(-180, 180)] for k in range(4)}
    for k in range(140):
        who = r.randrange(4)
        at[who][0] = max(-89.99, min(89.99, at[who][0] + (r.uniform(-60, 60) if k % 17 == 0 else r.uniform(-2, 2))))
        at[who][1] += r.uniform(-3, 3)
        rows.append((who, k, k, at[who][0], (at[who][1] + 180) % 360 - 180, 9 if k % 40 else 5, 200.0 + k))
    return rows


def test_stream_is_its_batch_twin(spark, tmp_path):
    df = spark.createDataFrame(moves(), "observer_id long, ts long, seq long, lat double, lon double, max_zoom int, target_m double")
    got = streamed(spark, df, tmp_path, "anchors", anchor_stream, "append")
    assert sorted(map(tuple, got.select(*NAMES).collect())) == sorted(map(tuple, anchor_targets(df).select(*NAMES).collect()))
    assert anchor_targets(df.limit(0)).count() == 0


def lon_of(tile, z):
    return (tile + 0.5) / 2**z * 360 - 180


def test_a_block_moves_only_when_its_inside_is_left():
    a = Anchor()
    assert a.observe(0.0, lon_of(500, 10), 10, 100.0) and a.block_x == 497
    assert not a.observe(0.0, lon_of(503, 10), 10, 100.0) and a.block_x == 497
    assert a.observe(0.0, lon_of(504, 10), 10, 100.0) and a.block_x == 501
    assert not a.observe(0.0, lon_of(502, 10), 10, 100.0)
    assert a.observe(0.0, lon_of(501, 10), 10, 100.0) and a.block_x == 497
    assert a.observe(0.0, lon_of(100, 10), 10, 100.0) and a.block_x == 96
    assert not a.observe(0.0, lon_of(100, 10), 10, 100.0)
    assert a.observe(0.0, lon_of(100, 10), 11, 100.0) and a.zoom == 11


def test_a_block_follows_over_the_seam():
    a = Anchor()
    a.observe(10.0, 179.9, 6, 100.0)
    before = a.block_x
    a.observe(10.0, -179.9, 6, 100.0)
    assert a.block_x == before and before > 50


def test_pole_and_dead_band():
    a, enter = Anchor(), math.degrees(math.acos(math.cos(math.radians(geo.MAX_LATITUDE)) / 4))
    a.observe(enter - 0.5, 20.0, 8, 100.0)
    assert a.mode == "north-boundary" and not a.locked and a.held == 20.0
    a.observe(enter + 0.2, 90.0, 8, 100.0)
    assert a.locked and a.held == 20.0
    a.observe(enter - 0.5, 95.0, 8, 100.0)
    assert a.locked and a.held == 20.0  # left only at twice the width
    a.observe(86.0, 95.0, 8, 100.0)
    assert not a.locked and a.held == 95.0


def test_imagery_zoom_waits():
    a, world = Anchor(), 2 * math.pi * geo.EARTH_RADIUS_KM * 1000
    a.observe(0.0, 0.0, 8, world / 2**10)
    assert a.imagery == 10
    a.observe(0.0, 0.1, 8, world / 2**10.5)
    assert a.imagery == 10
    a.observe(0.0, 0.2, 8, world / 2**10.6)
    assert a.imagery == 11
