"""Frame samples in trailing windows: exact order statistics that slide along."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MEASURES = {"interval": "interval_ms", "cpu": "cpu_ms"}
SUMMARY = ["latest", "mean", "p50", "p95", "p99", "max"]


def two_places(value: float | None) -> float | None:
    """Rounded to two places, halves up."""
    return None if value is None else floor(value * 100 + 0.5) / 100


class _Sliding:
    """The values of a window in order, kept while they come and go."""

    def __init__(self, values: list[float | None]):
        self.values = values
        self.held: list[float] = []
        self.sums = np.concatenate([[0.0], np.cumsum([v or 0.0 for v in values])])

    def add(self, at: int) -> None:
        if self.values[at] is not None:
            insort(self.held, self.values[at])

    def drop(self, at: int) -> None:
        if self.values[at] is not None:
            del self.held[bisect_left(self.held, self.values[at])]

    def summary(self, first: int, end: int) -> list[float | None]:
        """Of the rows from first to before end: latest, mean, nearest-rank percentiles, maximum."""
        n = len(self.held)
        if not n:
            return [None] * len(SUMMARY)
        rank = [self.held[max(0, ceil(n * p) - 1)] for p in (0.5, 0.95, 0.99)]
        return [two_places(v) for v in (self.values[end - 1], float(self.sums[end] - self.sums[first]) / n, *rank, self.held[-1])]


def rolling_frame_window(samples: DataFrame, session: str, target_hz: float, window_ms: int = 10_000, block_ms: int = 60_000) -> DataFrame:
    """For each sample the window that ends with it: frames, span, rate, frames over budget, rendered frames, and latest, mean, p50, p95, p99 and max of interval and CPU time.

    samples: (session, ts_ms, seq, interval_ms, cpu_ms, rendered). Samples of one time are in each other's windows; a window holds its start. Over budget is an interval more than
    5 % over the target's. A null measure is no part of its summary, though its frame counts; all numbers have two places.

    A session is cut into blocks of time, and a block gets the samples of one window before it along, so no session is one task, and what is sent twice is
    window_ms / block_ms of all. In a block the window's values are kept in order as samples come and go; no row has a list of its own.
    """
    block = lambda ms: F.floor(ms / block_ms).cast("long")
    sent = samples.filter(F.col("ts_ms").isNotNull()).withColumn("__block", F.explode(F.sequence(block(F.col("ts_ms")), block(F.col("ts_ms") + window_ms))))
    counted = [StructType.fromDDL(d)[0] for d in ("frames long", "span_ms long", "over_budget long", "rendered_frames long", "fps double")]
    summed = [StructType.fromDDL(f"{m}_{s} double")[0] for m in MEASURES for s in SUMMARY]
    columns = samples.columns
    schema = StructType([*samples.schema.fields, *counted, *summed])
    names, budget = schema.names, 1.05 * 1000 / target_hz

    def run(group: pa.Table) -> pa.Table:
        ts, seq = (group.column(c).to_numpy(zero_copy_only=False) for c in ("ts_ms", "seq"))
        group = group.take(pa.array(np.lexsort((seq, ts))))
        ts, own_block = group.column("ts_ms").to_pylist(), group.column("__block")[0].as_py()
        measures = [_Sliding(group.column(c).to_pylist()) for c in MEASURES.values()]
        over = np.concatenate([[0], np.cumsum([v is not None and v > budget for v in measures[0].values])])
        shown = np.concatenate([[0], np.cumsum([bool(v) for v in group.column("rendered").to_pylist()])])
        first, end, picked, out = 0, 0, [], []
        while end < len(ts):
            now, start = ts[end], end
            while end < len(ts) and ts[end] == now:
                for m in measures:
                    m.add(end)
                end += 1
            while ts[first] < now - window_ms:
                for m in measures:
                    m.drop(first)
                first += 1
            if now // block_ms == own_block:
                span, frames = now - ts[first], end - first
                fps = two_places((frames - 1) * 1000 / span) if span > 0 else None
                row = (frames, span, int(over[end] - over[first]), int(shown[end] - shown[first]), fps, *(v for m in measures for v in m.summary(first, end)))
                out += [row] * (end - start)
                picked += range(start, end)
        kept = group.take(pa.array(picked, pa.int64())).select(columns)  # a block of none of its own gives none
        made = list(zip(*out, strict=True)) if out else [[]] * (5 + len(MEASURES) * len(SUMMARY))
        kinds = [pa.int64()] * 4 + [pa.float64()] * (1 + len(MEASURES) * len(SUMMARY))
        return pa.table([*kept.columns, *[pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)]], names)

    return sent.groupBy(session, "__block").applyInArrow(run, schema)
