"""Scans and sliding windows against plain loops over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators.frames import MEASURES, rolling_frame_window, two_places
from tilewright.operators.logs import provider_outages, route_cut_changes, running_load
from tilewright.operators.outages import provider_circuit

LOG = "provider string, seq long, ts_ms long, started_ms long, kind string, systemic boolean, retryable boolean, retry_after_ms long"


def breaker(rows):
    """One event after the other."""
    out, now = [], None
    for seq, ts, started, kind, systemic, retryable, hint in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "cancellation" or (now and now["fatal"]):
            continue
        if kind == "failure" and systemic:
            if now is None:
                now = {"from": ts, "until": None, "closed": None, "failures": 0, "fatal": False}
                out.append(now)
            now["failures"] += 1
            deadline = ts + max(0, hint or 0)
            now["until"] = deadline if now["until"] is None else max(now["until"], deadline)
            if retryable is False:
                now["fatal"], now["until"] = True, None
        elif now is not None and (ts if started is None else started) >= now["until"]:
            now["closed"], now = ts, None
    return [(o["from"], o["until"], o["closed"], o["failures"], o["fatal"]) for o in out]


def events(seed, n, fatal):
    r = random.Random(seed)
    rows, ts = [], 0
    for seq in range(n):
        ts += r.choice([0, 1, 5, 40])
        kind = r.choice(["success"] * 5 + ["failure"] * 3 + ["cancellation"])
        rows.append((seq, ts, r.choice([None, ts - r.randrange(60)]), kind, r.choice([True, True, False, None]), False if r.random() < fatal else r.choice([True, None]), r.choice([None, -5, 0, 10, 60, 300])))
    return rows


@pytest.mark.parametrize("bucket_ms", [1, 37, 400, 10**9])
def test_breaker_buckets_do_not_show(spark, bucket_ms):
    logs = {f"p{k}": events(k, 150, 0.0 if k < 4 else 0.05) for k in range(7)}
    df = spark.createDataFrame([(p, *row) for p, rows in logs.items() for row in rows] + [("p0", 999, None, 1, "failure", True, False, None)], LOG)
    got = {}
    for r in provider_circuit(df, "provider", bucket_ms).collect():
        got.setdefault(r["provider"], []).append((r["open_from"], r["open_until"], r["closed_at"], r["failures"], r["fatal"]))
    want = {p: sorted(breaker(rows), key=str) for p, rows in logs.items()}
    assert {p: sorted(rows, key=str) for p, rows in got.items()} == {p: rows for p, rows in want.items() if rows}


def test_breaker_rules(spark):
    rows = [
        ("hint", 1, 1000, 900, "failure", True, True, 5000), ("hint", 2, 1100, 950, "failure", True, True, 100), ("hint", 3, 7000, 5999, "success", None, None, None), ("hint", 4, 7100, 6000, "failure", False, True, None),
        ("none", 1, 1000, 900, "failure", True, True, None), ("none", 2, 1001, 1000, "success", None, None, None),
        ("shut", 1, 1000, 900, "failure", True, False, None), ("shut", 2, 9000, 8000, "success", None, None, None), ("shut", 3, 9001, 8000, "failure", True, True, 5),
        ("fine", 1, 1000, 900, "failure", False, True, 5), (None, 1, 10, 5, "failure", True, True, 7),
    ]
    got = {r["provider"]: tuple(r)[1:] for r in provider_circuit(spark.createDataFrame(rows, LOG), "provider").collect()}
    assert got == {"hint": (1000, 6000, 7100, 2, False), "none": (1000, 1000, 1001, 1, False), "shut": (1000, None, None, 1, True), None: (10, 17, None, 1, False)}
    assert provider_circuit(spark.createDataFrame([], LOG), "provider").collect() == []


def test_running_load_and_outages_in_cells(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), k, r.choice(["request", "in-flight", "response", "failure", "cancellation", "other"]), k * 300, r.choice([200, 429, 503, None]), r.choice([None, 20_000])) for k in range(300)]
    df = spark.createDataFrame(rows, "provider string, seq long, kind string, ts_ms long, status int, retry_after_ms long")
    series = {x["seq"]: (x["queued"], x["in_flight"], x["outstanding"]) for x in running_load(df, "provider", 7).collect()}
    held = {}
    for provider, seq, kind, *_ in rows:
        q, f = held.get(provider, (0, 0))
        held[provider] = q, f = q + (kind == "request") - (kind in ("in-flight", "cancellation")), f + (kind == "in-flight") - (kind in ("response", "failure"))
        assert series[seq] == (q, f, q + f)
    one = {tuple(x) for x in provider_outages(df.filter("provider IS NOT NULL"), "provider", 900, 10**9).collect()}
    assert one == {tuple(x) for x in provider_outages(df.filter("provider IS NOT NULL"), "provider", 900, 1500).collect()} and len(one) > 2


def plain_windows(rows, window):
    out = {}
    for s, ts, seq, *_ in rows:
        inside = sorted((r for r in rows if r[0] == s and ts - window <= r[1] <= ts), key=lambda r: (r[1], r[2]))
        span = inside[-1][1] - inside[0][1]
        row = [len(inside), span, sum(r[3] is not None and r[3] > 1.05 * 1000 / 90 for r in inside), sum(bool(r[5]) for r in inside), two_places((len(inside) - 1) * 1000 / span) if span else None]
        for k in (3, 4):
            there = sorted(r[k] for r in inside if r[k] is not None)
            rank = [there[max(0, -int(-len(there) * p // 1) - 1)] for p in (0.5, 0.95, 0.99)] if there else []
            row += [two_places(v) for v in (inside[-1][k], sum(there) / len(there), *rank, there[-1])] if there else [None] * 6
        out[s, seq] = tuple(row)
    return out


def test_frame_windows_slide(spark):
    r = random.Random(6)
    rows, ts = [], {"a": 0, "b": 95_000, None: 7}
    for seq in range(400):
        s = r.choice(["a", "a", "b", None])
        ts[s] += r.choice([0, 11, 11, 300, 4000])
        rows.append((s, ts[s], seq, r.choice([None, *[k / 4 for k in range(30, 60)]]), r.choice([None, *[k / 8 for k in range(20)]]), r.choice([True, False, None])))
    df = spark.createDataFrame(rows, "session string, ts_ms long, seq long, interval_ms double, cpu_ms double, rendered boolean")
    for block in (20_000, 3_000):  # blocks longer and shorter than the window
        got = {(x["session"], x["seq"]): tuple(x)[6:] for x in rolling_frame_window(df, "session", 90.0, 10_000, block).collect()}
        assert got == plain_windows(rows, 10_000)
    assert rolling_frame_window(df.limit(0), "session", 90.0).collect() == [] and len(MEASURES) == 2


def test_cut_changes_meet_phases(spark):
    cuts = [("t", 1, 0, 1, 0, 0), ("t", 1, 0, 1, 1, 0), ("t", 4, 50, 1, 0, 0), ("t", 9, 99, 2, 0, 0), ("t", 9, 101, 2, 0, 1), ("i", 1, 0, 0, 0, 0), ("i", 2, 150, 0, 0, 0), ("i", 3, 200, 1, 1, 1)]
    df = spark.createDataFrame(cuts, "pipeline string, rev long, ts_ms long, z int, x long, y long")
    phases = spark.createDataFrame([("warm", 20), ("ride", 99), ("late", 200)], "phase string, from_ms long")
    got = {(r["pipeline"], r["phase"]): (r["revisions"], r["added"], r["removed"]) for r in route_cut_changes(df, phases, "pipeline").collect()}
    assert got == {("t", "warm"): (1, 0, 1), ("t", "ride"): (1, 2, 1), ("i", "ride"): (1, 0, 0), ("i", "late"): (1, 1, 1)}
    own = phases.withColumn("pipeline", F.lit("i"))
    assert {(r["pipeline"], r["phase"]) for r in route_cut_changes(df, own, "pipeline").collect()} == {("t", None), ("i", "ride"), ("i", "late")}
