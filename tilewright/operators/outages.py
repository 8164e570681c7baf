"""When providers are shut out: scans over logs of any length, made of one small row for each bucket of time.

A request breaker is closed, open until a deadline, or disabled for good. What a whole bucket of events does to it has one form, whatever
the events are: a breaker that enters closed leaves as ``c``; one that enters open until u also leaves as c, if u is at most the latest start
of a request that would close it (``probe``), and otherwise stays open until the later of u and the bucket's own furthest deadline (``reach``), or is
disabled if the bucket has a fatal answer. For where a request starts late enough for every failure before it in the bucket, a breaker that was closed at first is closed after it
too, so both go on alike. So buckets are summed up apart from each other, their rows are folded in order, and with the state that each starts in the events are read once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CLOSED, OPEN, DISABLED = 0, 1, 2
ANSWER, FAILURE, FATAL = 0, 1, 2
STATE = ["kind", "until", "since", "opener"]


def _next(state: tuple, code: int, ts: int, seq: int, value: int) -> tuple:
    """The state after an event: (kind, until, since, opener). value: a failure's deadline, an answer's start."""
    kind, until, since, opener = state
    if kind == DISABLED:
        return state
    if code == ANSWER:
        return (CLOSED, None, None, None) if kind == OPEN and value >= until else state
    if kind == CLOSED:
        since, opener, until = ts, seq, value
    return (DISABLED, None, since, opener) if code == FATAL else (OPEN, max(until, value), since, opener)


def _events(group: pa.Table) -> Iterator[tuple[int, int, int, int]]:
    """(code, ts, seq, value) in order."""
    columns = [group.column(c).to_numpy(zero_copy_only=False) for c in ("__code", "__ts", "__seq", "__value")]
    order = np.lexsort((columns[2], columns[1]))
    return zip(*(c[order].tolist() for c in columns), strict=True)


def _summed_up(group: pa.Table) -> tuple:
    """probe, reach, whether there is a fatal answer, and the state after the events of a breaker that was closed before."""
    state, probe, reach, fatal = (CLOSED, None, None, None), None, None, False
    for code, ts, seq, value in _events(group):
        state = _next(state, code, ts, seq, value)
        if code == ANSWER:
            if (reach is None or value >= reach) and (probe is None or value > probe):
                probe = value
        else:
            reach, fatal = value if reach is None else max(reach, value), code == FATAL
        if fatal:
            break
    return probe, reach, fatal, *state


def _after(state: tuple, summary: tuple) -> tuple:
    """The state after a whole bucket."""
    probe, reach, fatal, *closed = summary
    kind, until, since, opener = state
    if kind == DISABLED:
        return state
    if kind == CLOSED or (probe is not None and probe >= until):
        return tuple(closed)
    return (DISABLED, None, since, opener) if fatal else (OPEN, until if reach is None else max(until, reach), since, opener)


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


def provider_circuit(log: DataFrame, provider: str, bucket_ms: int = 600_000) -> DataFrame:
    """(provider, open_from, open_until, closed_at, failures, fatal): each time in which a provider's breaker let no ordinary request through.

    log: (provider, seq, ts_ms of the answer, started_ms of the request, kind, systemic, retryable, retry_after_ms), kind success, failure or cancellation. A systemic failure opens
    the breaker until its hint is over, at once without one; later, shorter hints don't shorten that. A systemic failure that can't be retried
    disables the provider for good; open_until is null then. The first success, or failure of one tile alone, of a request that started at or after the
    deadline closes the breaker; answers to earlier requests don't. Cancellations say nothing. Rows without a time count for nothing.
    closed_at is null while it is open. Events are ordered by (ts_ms, seq), inside buckets only; no task holds more than a bucket of a provider, or one row for each of its buckets.
    """
    systemic = (F.col("kind") == "failure") & F.coalesce("systemic", F.lit(False))
    fatal = systemic & ~F.coalesce("retryable", F.lit(True))
    code = F.when(fatal, FATAL).when(systemic, FAILURE).otherwise(ANSWER)
    deadline = F.col("ts_ms") + F.greatest(F.lit(0), F.coalesce("retry_after_ms", F.lit(0)))
    value = F.when(systemic, deadline).otherwise(F.coalesce("started_ms", "ts_ms"))
    long = lambda c, name: c.cast("long").alias(name)
    told = log.filter(F.col("kind").isin("success", "failure") & F.col("ts_ms").isNotNull())
    events = told.select(F.col(provider).alias("__provider"), long(F.floor(F.col("ts_ms") / bucket_ms), "__cell"), long(code, "__code"), long(F.col("ts_ms"), "__ts"), long(F.col("seq"), "__seq"), long(value, "__value"))
    who = StructField("__provider", events.schema["__provider"].dataType)
    keys, summary = ["__provider", "__cell"], ["probe", "reach", "fatal", *STATE]

    def table(fields: StructType, rows: list[tuple], group: pa.Table) -> pa.Table:
        """Rows of longs behind the group's provider."""
        same = group.column("__provider").combine_chunks().take(pa.array([0] * len(rows), pa.int64())) if group.num_rows else group.column("__provider").combine_chunks()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields.names[1:]]
        return pa.table([same, *[pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in columns]], fields.names)

    one = StructType([who, *_longs("__cell", *summary)])
    starts = StructType([who, *_longs("__cell", *STATE)])
    parts = StructType([who, *_longs("opener", "since", "until", "closed_at", "failures", "fatal")])

    def sum_up(group: pa.Table) -> pa.Table:
        return table(one, [(group.column("__cell")[0].as_py(), *_summed_up(group))], group)

    def fold(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("__cell", *summary)), strict=True))
        state, out = (CLOSED, None, None, None), []
        for cell, *own in rows:
            out.append((cell, *state))
            state = _after(state, tuple(own))
        return table(starts, out, group)

    def fill(group: pa.Table) -> pa.Table:
        state = tuple(group.column(c)[0].as_py() for c in STATE)
        found: dict[int, list] = {}
        for code, ts, seq, value in _events(group):
            before, state = state, _next(state, code, ts, seq, value)
            if before[0] == DISABLED:
                break
            if code != ANSWER or before[0] != state[0]:
                kind, until, since, opener = before if state[0] == CLOSED else state
                own = found.setdefault(opener, [opener, since, None, None, 0, 0])
                if state[0] == CLOSED:
                    own[3] = ts
                else:
                    own[2], own[4], own[5] = until, own[4] + 1, int(kind == DISABLED)
        return table(parts, [tuple(v) for v in found.values()], group)

    starting = events.groupBy(*keys).applyInArrow(sum_up, one).groupBy("__provider").applyInArrow(fold, starts)
    known = starting.withColumnsRenamed({"__provider": "__p", "__cell": "__c"})
    there = events.join(known, F.col("__provider").eqNullSafe(F.col("__p")) & (F.col("__cell") == F.col("__c"))).drop("__p", "__c")
    pieces = there.groupBy(*keys).applyInArrow(fill, parts)
    out = pieces.groupBy("__provider", "opener").agg(F.min("since").alias("open_from"), F.max("until").alias("open_until"), F.max("closed_at").alias("closed_at"), F.sum("failures").alias("failures"), (F.max("fatal") == 1).alias("fatal"))
    return out.select(F.col("__provider").alias(provider), "open_from", F.when(~F.col("fatal"), F.col("open_until")).alias("open_until"), "closed_at", "failures", "fatal")


def running_sums(log: DataFrame, key: str, order: list[str], cell: Column, **sums: Column) -> DataFrame:
    """log with the sum of each value over the key's rows up to and with its own, by ``order``.

    ``cell`` is a column that grows with the order: rows are ordered inside the cells of a key only, each of which starts with the sums of the cells before, one row each.
    """
    values = {f"__v_{name}": F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    at = log.withColumns({"__cell": cell, **values})
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(key, "__cell").agg(*[F.sum(v).alias(v) for v in values])
    starts = totals.select(F.col(key).alias("__k"), F.col("__cell").alias("__c"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy(key, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = at.withColumns({f"{v}_within": F.sum(v).over(within) for v in values})
    out = summed.join(starts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__cell").eqNullSafe(F.col("__c")))
    return out.select(*log.columns, *[(F.col(f"__v_{name}_within") + F.col(f"__v_{name}_before")).alias(name) for name in sums])
