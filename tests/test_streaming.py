import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from tilewright.operators.tracks import latest_track_state
from tilewright.streaming.state import ROCKS, catalogue_freshness, catalogue_freshness_stream, drop_stale, frame_telemetry_stream, held_tracks, track_state_stream


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, tmp_path, name, make, mode):
    for k, part in enumerate([df.filter(F.col("seq") < 40), df.filter((F.col("seq") >= 40) & (F.col("seq") < 90)), df.filter(F.col("seq") >= 90)]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table(name)
    return spark.createDataFrame(found.collect(), found.schema)  # a memory table can't be joined with itself


def test_track_state_is_its_batch_twin(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("abc"), k, r.choice(["upsert"] * 8 + ["remove", "remove", "snapshot"]), f"t{r.randrange(9)}", r.randrange(5)) for k in range(140)]
    rows += [("a", 141, "snapshot", t, 7) for t in ("t1", "t2")] + [("a", 142, "upsert", " T3 ", 1), ("a", 142, "remove", "t1", None), ("a", 142, "upsert", "t1", 3), ("b", 150, "snapshot", None, None)]
    rows += [("c", 151, "snapshot", "q", 1), ("c", 152, "upsert", "q", None), ("c", 153, "upsert", None, 4), ("c", 154, "upsert", "  ", 4), ("c", 155, "remove", "absent", None)]
    ops = spark.createDataFrame(rows, "session string, seq long, type string, track string, revision long")
    got = streamed(spark, ops, tmp_path, "track_state", track_state_stream, "update")
    sound = ops.withColumn("track", F.nullif(F.upper(F.trim("track")), F.lit(""))).filter("track IS NOT NULL AND (revision IS NOT NULL OR type = 'remove') OR type = 'snapshot'")
    twin = latest_track_state(sound).filter("track IS NOT NULL").select("session", "track", "seq", "revision")
    assert sorted(map(tuple, held_tracks(got).collect())) == sorted(map(tuple, twin.collect()))
    assert {r["track"] for r in twin.filter("session = 'a'").collect()} == {"T1", "T2", "T3"} and twin.filter("session = 'b'").count() == 0
    assert got.groupBy("session", "epoch", "track", "seq").count().filter("count > 1").count() == 0


def test_stale_revisions_go(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(4), k, k // 20 + r.randrange(-2, 2)) for k in range(140)]
    events = spark.createDataFrame(rows, "key long, seq long, revision long")
    got = {(x["key"], x["seq"]) for x in streamed(spark, events, tmp_path, "stale", drop_stale, "append").collect()}
    high, want = {}, set()
    for key, seq, revision in rows:
        if revision >= high.get(key, -99):
            want.add((key, seq))
        high[key] = max(high.get(key, -99), revision)
    assert got == want


def test_telemetry_windows(spark, tmp_path):
    r = random.Random(5)
    rows = [(k % 2, k, float(r.randrange(4, 40)), r.choice([None, *map(float, range(9))]), r.random() < 0.7) for k in range(120)]
    df = spark.createDataFrame(rows, "session long, seq long, interval_ms double, cpu_ms double, rendered boolean").withColumn("ts", F.timestamp_seconds(F.col("seq") / 4))
    got = streamed(spark, df, tmp_path, "telemetry", lambda s: frame_telemetry_stream(s, 90.0), "append")
    found = {(x["session"], x["start"]): x for x in got.collect()}
    twin = {(x["session"], x["start"]): x for x in frame_telemetry_stream(df, 90.0).collect()}
    assert len(found) > 30 and all(twin[k] == v for k, v in found.items())
    rough = {(x["session"], x["start"]): x for x in frame_telemetry_stream(df, 90.0, accuracy=5).collect()}
    for (session, start), x in twin.items():
        own = [row for row, at in zip(rows, df.select("ts").collect(), strict=True) if row[0] == session and start <= at["ts"] < x["end"]]
        assert x["frames"] == len(own) and x["rendered_frames"] == sum(row[4] for row in own) and x["over_budget"] == sum(row[2] > 1.05 * 1000 / 90 for row in own)
        assert x["fps"] == (pytest.approx((len(own) - 1) * 4 / (own[-1][1] - own[0][1])) if len(own) > 1 else None)
        for k, name in ((2, "interval"), (3, "cpu")):
            there = sorted(row[k] for row in own if row[k] is not None)
            for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                assert x[f"{name}_{p}"] == (there[max(0, ceil(len(there) * q) - 1)] if there else None)
                if there:  # a coarse sketch is off by its stated ranks at most
                    at, off = ceil(len(there) * q), len(there) / 5
                    assert there[max(0, int(at - off) - 1)] <= rough[session, start][f"{name}_{p}"] <= there[min(len(there) - 1, ceil(at + off))]
            assert x[f"{name}_max"] == (there[-1] if there else None) and x[f"{name}_latest"] == own[-1][k]


KINDS = "group string, seq long, ts_ms long, kind string, rows long"


def test_freshness_by_events(spark):
    rows = [
        ("off", 1, 0, "request", None), ("ready", 1, 0, "enable", None), ("out", 1, 0, "enable", None), ("out", 2, 5, "request", None),
        ("fresh", 1, 0, "enable", None), ("fresh", 2, 5, "request", None), ("fresh", 3, 950, "loaded", 7), ("old", 1, 0, "enable", None), ("old", 2, 1, "request", None), ("old", 3, 2, "loaded", 3),
        ("bad", 1, 0, "enable", None), ("bad", 2, 1, "request", None), ("bad", 3, 2, "failed", None), ("stale", 1, 0, "enable", None), ("stale", 2, 1, "request", None), ("stale", 3, 2, "loaded", 4), ("stale", 4, 3, "request", None), ("stale", 5, 4, "failed", None),
        ("back", 1, 0, "enable", None), ("back", 2, 1, "request", None), ("back", 3, 2, "disable", None), ("back", 4, 3, "loaded", 9), ("back", 5, 4, "enable", None), ("back", 6, 5, "odd", None),
    ]
    got = {r["group"]: (r["status"], r["rows"], r["stale"], r["due"]) for r in catalogue_freshness(spark.createDataFrame(rows, KINDS), F.lit(1000), 100).collect()}
    assert got == {
        "ready": ("ready", 0, False, True), "out": ("loading", 0, False, False), "fresh": ("loaded", 7, False, False), "old": ("loaded", 3, False, True), "bad": ("unavailable", 0, False, False),
        "stale": ("unavailable", 4, True, False), "back": ("ready", 0, False, True),
    }
    assert catalogue_freshness(spark.createDataFrame([], KINDS), F.lit(1)).collect() == []


def test_time_alone_makes_rows_due(spark, tmp_path):
    r = random.Random(7)
    rows = [(f"g{r.randrange(5)}", k, 1000 * k, r.choice(["enable", "enable", "request", "request", "loaded", "loaded", "failed", "disable"]), r.randrange(50)) for k in range(110)]
    rows += [("quiet", 20, 20_000, "enable", 0), ("quiet", 21, 21_000, "request", 0), ("quiet", 22, 22_000, "loaded", 5), ("beat", 400, 400_000, "enable", 0), ("beat", 500, 500_000, "disable", 0)]
    events = spark.createDataFrame(rows, KINDS).withColumn("ts", F.timestamp_millis("ts_ms"))
    stream = lambda s: catalogue_freshness_stream(s.withWatermark("ts", "1 second"), 30_000)
    got = streamed(spark, events, tmp_path, "fresh", stream, "update")
    quiet = [tuple(x)[1:] for x in got.filter("group = 'quiet'").orderBy("at_ms").collect()]
    assert quiet == [(22_000, "loaded", 5, 22_000, False, False), (52_000, "loaded", 5, 22_000, False, True)]  # nothing of it arrived at 52 s
    last = {x["group"]: x for x in got.groupBy("group").agg(F.max_by(F.struct("status", "rows", "fetched_at_ms", "stale", "due"), F.col("at_ms") * 2 + F.col("due").cast("int")).alias("s")).select("group", "s.*").collect()}
    twin = {x["group"]: x for x in catalogue_freshness(events, F.lit(499_000), 30_000).collect()}
    for group in set(twin) - {"beat"}:
        assert tuple(last[group])[1:] == tuple(twin[group])[1:], group
