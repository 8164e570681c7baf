"""Keyed state over streams. Each operator has a batch twin in the operators, and gives the same state when its stream has been read to the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators.frames import MEASURES


#: State that is kept by row, or that has timers, needs this store: spark.sql.streaming.stateStore.providerClass.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tracks(StatefulProcessor):
    """A session's epoch, and a row for each of its tracks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "seq long")
        self.tracks = handle.getMapState("tracks", "track string", "seq long, revision long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows))
        rank = ops["type"].map({"snapshot": 0, "remove": 1}).fillna(2)
        epoch, touched = self.epoch.get()[0] if self.epoch.exists() else None, {}
        for seq, kind, track, revision in ops.assign(rank=rank).sort_values(["seq", "rank"], kind="stable")[["seq", "type", "track", "revision"]].itertuples(index=False):
            if kind == "snapshot" and seq != epoch:
                epoch = int(seq)
                self.epoch.update((epoch,))
                self.tracks.clear()
                touched = {None: (epoch, None, False)}
            if track is None or pd.isna(track):
                continue
            if kind == "remove":
                self.tracks.removeKey((track,))
                touched[track] = (int(seq), None, False)
            elif not pd.isna(revision):
                self.tracks.updateValue((track,), (int(seq), int(revision)))
                touched[track] = (int(seq), int(revision), True)
        made = [(key[0], epoch, track, *value) for track, value in touched.items()]
        yield pd.DataFrame(made, columns=["session", "epoch", "track", "seq", "revision", "held"]).astype({"epoch": "Int64", "revision": "Int64"})

    def close(self) -> None:
        pass


def track_state_stream(ops: DataFrame) -> DataFrame:
    """(session, epoch, track, seq, revision, held): the tracks of a session as they change.

    ops: (session, seq long, type, track string, revision long), type snapshot, upsert or remove; a snapshot may be several rows of one seq, or one without a track. Ids are trimmed and in upper case.
    A snapshot begins an epoch, named by its seq: what was held before is gone, which one row without a track says, so that no batch gives out a whole session.
    Within a message removals come before upserts; the order of seq decides, not the revision. Malformed tracks, without an id or a revision, are skipped and what was known of them stays.

    State grows by a row for each held track and a batch reads and writes the rows that it touches. What a reader holds is, of each session's
    latest epoch, each track's latest row, if it says ``held``. Runs in update mode on the store named by ROCKS.
    """
    narrow = ops.select("session", F.col("seq").cast("long").alias("seq"), "type", F.nullif(F.upper(F.trim("track")), F.lit("")).alias("track"), F.col("revision").cast("long").alias("revision"))
    out = f"session {ops.schema['session'].dataType.simpleString()}, epoch long, track string, seq long, revision long, held boolean"
    return narrow.groupBy("session").transformWithStateInPandas(_Tracks(), out, "Update", "None")


def held_tracks(changes: DataFrame) -> DataFrame:
    """(session, track, seq, revision): what is held after all changes that track_state_stream gave out."""
    newest = changes.groupBy("session").agg(F.max("epoch").alias("__epoch"))
    now = changes.join(newest, "session").filter(F.col("epoch").eqNullSafe(F.col("__epoch")) & F.col("track").isNotNull())
    last = now.groupBy("session", "track").agg(F.max_by(F.struct("seq", "revision", "held"), "seq").alias("__last"))
    return last.filter("__last.held").select("session", "track", "__last.seq", "__last.revision")


def drop_stale(events: DataFrame, key: str = "key") -> DataFrame:
    """The events whose revision isn't below the highest one that the key has had so far, in order of seq. events: (key long, seq long, revision long)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        known = state.get[0] if state.exists else -(1 << 62)
        before = rows["revision"].cummax().shift(fill_value=known).clip(lower=known)
        state.update((int(max(known, rows["revision"].max())),))
        yield rows[rows["revision"] >= before][[key, "seq", "revision"]]

    return events.select(key, "seq", "revision").groupBy(key).applyInPandasWithState(step, f"{key} long, seq long, revision long", "revision long", "append", GroupStateTimeout.NoTimeout)


def frame_telemetry_stream(samples: DataFrame, target_hz: float, delay: str = "10 seconds", accuracy: int = 1000) -> DataFrame:
    """Windows of ten seconds, one begun each second, of each session: frames, rate, rendered and over-budget frames, and latest, mean, p50, p95, p99 and max of both measures.

    samples: (session, ts, seq, interval_ms, cpu_ms, rendered). Percentiles come from a sketch that merges, so a window's state has a fixed size and late samples, waited for during
    ``delay``, only add to it: the rank of what is given is off by at most frames / ``accuracy``, so they are exact up to ``accuracy`` frames. The same call on a table is the batch twin.
    """
    out = samples.withWatermark("ts", delay).groupBy("session", F.window("ts", "10 seconds", "1 second"))
    micros = F.unix_micros("ts")
    parts = [F.count(F.lit(1)).alias("frames"), (F.max(micros) - F.min(micros)).alias("__span"), F.count_if("rendered").alias("rendered_frames"), F.count_if(F.col("interval_ms") > 1.05 * 1000 / target_hz).alias("over_budget")]
    for name, measure in MEASURES.items():
        parts += [F.max_by(measure, F.struct("ts", "seq")).alias(f"{name}_latest"), F.avg(measure).alias(f"{name}_mean"), F.percentile_approx(measure, [0.5, 0.95, 0.99], accuracy).alias(f"__{name}"), F.max(measure).alias(f"{name}_max")]
    df = out.agg(*parts)
    ranks = [F.col(f"__{name}")[k].alias(f"{name}_{p}") for name in MEASURES for k, p in enumerate(("p50", "p95", "p99"))]
    plain = [f"{name}_{p}" for name in MEASURES for p in ("latest", "mean", "max")]
    fps = F.when(F.col("__span") > 0, (F.col("frames") - 1) * 1e6 / F.col("__span")).alias("fps")
    return df.select("session", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "frames", fps, "rendered_frames", "over_budget", *plain, *ranks)


#: Fixed value: how long a catalogue's rows count as fresh.
TTL_MS = 2 * 3600 * 1000


def _status(enabled: Column, requesting: Column, failed: Column, fetched: Column) -> Column:
    return F.when(~enabled, "off").when(requesting, "loading").when(failed, "unavailable").when(fetched.isNotNull(), "loaded").otherwise("ready")


def catalogue_freshness(events: DataFrame, now_ms: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """(group, status, rows, fetched_at_ms, stale, due) of each group after its events.

    events: (group, seq, ts_ms, kind, rows), kind enable, disable, request, loaded or failed. A group is off until it is enabled, loading while a request is out, unavailable after one that
    failed, and else loaded, or ready if it never was. Requests of a group that is off and answers that no request waits for are ignored; disabling calls a request back. rows and
    fetched_at_ms are those of the last load and stay. It is stale if it is unavailable and has rows, and due if it is enabled, neither loading nor unavailable, and has no rows younger than ``ttl_ms`` at ``now_ms``.
    """
    w = Window.partitionBy("group").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    known = events.filter(kind.isin("enable", "disable", "request", "loaded", "failed"))
    switched = known.withColumn("__on", F.coalesce(F.last(F.when(kind.isin("enable", "disable"), kind == "enable"), ignorenulls=True).over(before), F.lit(False)))
    heard = switched.filter((kind != "request") | F.col("__on"))
    held = F.last(F.when(kind != "enable", kind == "request"), ignorenulls=True).over(before)
    taken = heard.withColumn("__held", F.coalesce(held, F.lit(False))).filter(~kind.isin("loaded", "failed") | F.col("__held"))
    last = lambda value, *kinds: F.max_by(F.when(kind.isin(*kinds), value), F.when(kind.isin(*kinds), F.col("seq")))
    now = taken.groupBy("group").agg(
        F.coalesce(last(kind == "enable", "enable", "disable"), F.lit(False)).alias("__on"), F.coalesce(last(kind == "request", "request", "loaded", "failed", "disable"), F.lit(False)).alias("__out"),
        F.coalesce(last(kind == "failed", "request", "loaded", "failed"), F.lit(False)).alias("__failed"), last(F.col("ts_ms"), "loaded").alias("fetched_at_ms"), F.coalesce(last(F.col("rows"), "loaded"), F.lit(0)).alias("rows"),
    )
    old = F.coalesce(now_ms - F.col("fetched_at_ms") >= ttl_ms, F.lit(True))
    stale, due = F.col("__failed") & (F.col("rows") > 0), F.col("__on") & ~F.col("__out") & ~F.col("__failed") & old
    return now.select("group", _status(F.col("__on"), F.col("__out"), F.col("__failed"), F.col("fetched_at_ms")).alias("status"), F.col("rows").cast("long").alias("rows"), "fetched_at_ms", stale.alias("stale"), due.alias("due"))


class _Freshness(StatefulProcessor):
    """One group: what was last heard of it, and a timer for when its rows will be too old."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "enabled boolean, requesting boolean, failed boolean, fetched_at_ms long, rows long")

    def _row(self, key: tuple, at_ms: int, state: tuple, due: bool) -> pd.DataFrame:
        enabled, requesting, failed, fetched, rows = state
        status = "off" if not enabled else "loading" if requesting else "unavailable" if failed else "ready" if fetched is None else "loaded"
        row = (key[0], at_ms, status, rows, fetched, failed and rows > 0, due)
        return pd.DataFrame([row], columns=["group", "at_ms", "status", "rows", "fetched_at_ms", "stale", "due"]).astype({"fetched_at_ms": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.now.get()) if self.now.exists() else [False, False, False, None, 0]
        at = 0
        for kind, ts, count in pd.concat(list(rows)).sort_values("seq")[["kind", "ts_ms", "rows"]].itertuples(index=False):
            at = int(ts)
            if kind == "enable":
                state[0] = True
            elif kind == "disable":
                state[0] = state[1] = False
            elif kind == "request" and state[0]:
                state[1:3] = True, False
            elif kind == "failed" and state[1]:
                state[1:3] = False, True
            elif kind == "loaded" and state[1]:
                state[1:] = False, False, at, 0 if pd.isna(count) else int(count)
        self.now.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = state[0] and not state[1] and not state[2]
        due_at = at if state[3] is None else state[3] + self.ttl_ms
        if waiting and due_at > at:
            self.handle.registerTimer(due_at)
        yield self._row(key, at, tuple(state), waiting and due_at <= at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, expiredTimerInfo.getExpiryTimeInMs(), tuple(self.now.get()), True)

    def close(self) -> None:
        pass


def catalogue_freshness_stream(events: DataFrame, ttl_ms: int = TTL_MS, time_mode: str = "EventTime") -> DataFrame:
    """(group, at_ms, status, rows, fetched_at_ms, stale, due) whenever a group's events or time alone change it.

    events as in catalogue_freshness, with a watermark on a column ``ts`` for event time, which passes as any group's events come; with "ProcessingTime" the clock alone makes
    rows due, and ts_ms must be of that clock. A group has one small row of state and at most one timer, which says ``due`` when nothing else arrives. Runs in update mode on the store named by ROCKS.
    """
    out = f"group {events.schema['group'].dataType.simpleString()}, at_ms long, status string, rows long, fetched_at_ms long, stale boolean, due boolean"
    return events.groupBy("group").transformWithStateInPandas(_Freshness(ttl_ms), out, "Update", time_mode)
