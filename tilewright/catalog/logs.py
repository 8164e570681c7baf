"""Queries on request logs, timings and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import views as V
from tilewright.operators import frames, outages
from tilewright.operators import logs as L
from tilewright.streaming import state

FRESHNESS_KINDS = ["enable", "request", "loaded", "enable", "request", "failed", "request", "loaded", "disable"]
CACHE_KINDS = ["cache-lookup", "cache-hit", "memory-hit", "shared", "persistent-hit", "persistent-write"]
KINDS = {"click": "request", "view": "in-flight", "purchase": "response", "error": "failure", "signup": "cancellation"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    status = F.element_at(F.array(*[F.lit(s).cast("int") for s in (None, 200, 404, 429, 403, 503)]), (1 + F.col("event_id") % 6).cast("int"))
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") % 2).alias("provider"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), kind.alias("kind"), status.alias("status"), F.floor(F.col("value") * 100).alias("retry_after_ms"), F.floor("value").alias("duration_ms"), "value", (F.col("event_id") % 5).alias("revision"))


LOG = """log AS (SELECT user_id AS key, event_id % 2 AS provider, event_id AS seq, epoch_ms(ts) AS ts_ms,
  CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'in-flight' WHEN 'purchase' THEN 'response' WHEN 'error' THEN 'failure' ELSE 'cancellation' END AS kind,
  [NULL, 200, 404, 429, 403, 503][1 + event_id % 6] AS status, CAST(floor(value * 100) AS BIGINT) AS retry_after_ms, CAST(floor(value) AS BIGINT) AS duration_ms, value, event_id % 5 AS revision FROM events)"""


def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duration_summary(_log(spark, sf_dir), ["key"], "value", ["ts_ms", "seq"])


def timings_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half minute of the log, by host."""
    p = V.read(spark, sf_dir, "pages")
    timings = p.select(F.timestamp_seconds("page_id").alias("ts"), F.when(F.col("page_id") % 5 > 0, F.col("url")).alias("url"), F.octet_length("html").alias("transfer_bytes"), (F.octet_length("html") * 2).alias("encoded_bytes"), (F.col("page_id") % 97).cast("double").alias("duration_ms"))
    return L.timings_by_host(timings).select(F.unix_seconds("until").alias("until"), F.col("host"), "requests", "transfer_bytes", "encoded_bytes", "latest", "mean", "p50", "p95", "p99", "max")


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.failure_counts(_log(spark, sf_dir).filter("kind = 'failure'"), ["key"])
    return out.select("key", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"), "opaque", "last_status")


def provider_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is one of a cache."""
    caches = F.element_at(F.array(*[F.lit(k) for k in CACHE_KINDS]), (1 + F.col("seq") % len(CACHE_KINDS)).cast("int"))
    log = _log(spark, sf_dir).withColumns({"bytes": F.col("duration_ms") * 10, "kind": F.when(F.col("seq") % 3 == 0, caches).otherwise(F.col("kind"))})
    return L.provider_metrics(log, ["provider"])


def classify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("network", F.col("seq") % 4 == 0)
    return L.classify_failures(log, F.col("provider") == 1).select("seq", "systemic", "retryable", "scope")


def cache_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.read(spark, sf_dir, "pages")
    control = F.element_at(F.array(F.lit(None).cast("string"), F.lit("public, max-age=60"), F.lit("no-store"), F.lit("private, max-age=5")), (1 + F.col("page_id") % 4).cast("int"))
    url = F.when(F.col("page_id") % 6 == 0, F.replace("url", F.lit(".com/"), F.lit(".com:8443/"))).when((F.col("page_id") % 6 == 1) & F.col("url").startswith("https:"), F.replace("url", F.lit(".com/"), F.lit(".com:443/"))).otherwise(F.col("url"))
    log = p.select("page_id", url.alias("url"), (F.col("page_id") * 1000).alias("ts_ms"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 3 == 0, "text/html").otherwise("image/webp").alias("content_type"), F.octet_length("html").alias("body_bytes"), control.alias("cache_control"), F.when(F.col("page_id") % 8 == 0, F.col("page_id") * 1000 + 5000).alias("expires_ms"))
    return L.cache_identity(log, ["ref"]).select("page_id", "lifetime_ms", "cacheable", "expires_at", "identity")


def expand_tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.read(spark, sf_dir, "part").select((F.col("p_partkey") % 9).cast("int").alias("z"), (F.col("p_partkey") * 7 % 300).alias("x"), (F.col("p_partkey") * 11 % 300).alias("y")).distinct()
    return L.expand_tile_urls(t, "https://tiles.test/{x}/{z}/{y}.webp", 2, 8, tms=True)[0]


def coalesce_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.operators import tiles as T

    at = T.assign_tiles(V.positions(spark, sf_dir), [6, 9]).select("z", "x", "y", F.col("id").alias("seq"), F.col("observer_id").alias("consumer"))
    return L.coalesce_demand(at, 7)


def rolling_frame_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures in quarters and eighths of a millisecond, whose sums are exact in any order."""
    log = _log(spark, sf_dir).select(
        "key", (F.col("seq") * 37 % 100003).alias("ts_ms"), "seq", (F.floor(F.col("value") * 4) / 4).alias("interval_ms"),
        F.when(F.col("seq") % 11 > 0, (F.col("seq") * 13 % 257) / 8).alias("cpu_ms"), (F.col("seq") % 5 > 0).alias("rendered"),
    )
    return frames.rolling_frame_window(log, "key", 90.0).drop("key", "ts_ms", "interval_ms", "cpu_ms", "rendered")


def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.revision_changes(_log(spark, sf_dir), "key", ["seq"]).select("key", "seq", "revision", "previous")


def cut_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.operators import tiles as T

    at = T.assign_tiles(V.positions(spark, sf_dir), [2]).select(F.col("observer_id").alias("cut_id"), (F.col("id") % 5).alias("rev"), "z", "x", "y").distinct()
    return L.cut_churn(at, ["cut_id"])


def running_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of each provider, and so its peaks."""
    return L.running_load(_log(spark, sf_dir), "provider", 1000).groupBy("provider").agg(F.max("queued").alias("queued"), F.max("in_flight").alias("in_flight"), F.max("outstanding").alias("outstanding"), F.min("outstanding").alias("least"))


def repeat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeat_requests(_log(spark, sf_dir), "key")


def provider_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.provider_outages(_log(spark, sf_dir).withColumn("ts_ms", F.col("seq") * 900), "provider")


def provider_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven providers; one answer in five is a failure, one in 1,009 a fatal one; hints are up to 40 seconds, a request takes up to 10."""
    seq = F.col("seq")
    kind = F.when(seq % 5 == 0, "failure").when(seq % 13 == 1, "cancellation").otherwise("success")
    log = _log(spark, sf_dir).select(
        (seq % 7).alias("provider"), "seq", (seq * 900).alias("ts_ms"), (seq * 900 - seq * 7919 % 10_000).alias("started_ms"), kind.alias("kind"), (seq % 15 > 0).alias("systemic"),
        (seq % 1009 > 0).alias("retryable"), F.when(seq % 3 > 0, seq * 104729 % 40_000).alias("retry_after_ms"),
    )
    return outages.provider_circuit(log, "provider")


def route_cut_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines, a revision for each five hundred positions, a phase of the ride for each region."""
    from tilewright.operators import tiles as T

    at = T.assign_tiles(V.positions(spark, sf_dir), [4]).select((F.col("id") % 2).alias("pipeline"), F.floor(F.col("id") / 500).alias("rev"), (F.floor(F.col("id") / 500) * 350_000).alias("ts_ms"), "z", "x", "y").distinct()
    phases = V.read(spark, sf_dir, "region").select(F.col("r_name").alias("phase"), (F.col("r_regionkey") * 1_200_000 + 100).cast("long").alias("from_ms"))
    return L.route_cut_changes(at, phases, "pipeline")


def reconcile_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = V.read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"))
    held = V.read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "ready").otherwise("in-flight").alias("state"))
    return L.reconcile_requirements(needed, held, ["key"]).select("key", "state", "action")


def reuse_by_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = V.read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 5).cast("long").alias("required"))
    inventory = V.read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 6).alias("uploaded"), (F.col("p_partkey") % 4 == 0).alias("visible"))
    return L.reuse_by_revision(demand, inventory, "key").select("key", "action")


def cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select(F.col("key").alias("identity"), "provider", "seq", (F.col("seq") * 700).alias("ts_ms"), "duration_ms", "status", F.lit(60000).alias("lifetime_ms"), (F.col("provider") == 1).alias("has_fallback"))
    return L.cache_outcomes(log, "has_fallback").select("seq", "outcome")


def route_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumns({"ts_ms": F.col("seq") * 700, "z": (F.col("seq") % 4).cast("int")})
    out = L.route_audit(log, "provider", {"ride": (500_000, 2_000_000)})
    return out.withColumn("starts_by_zoom", F.array_join(F.transform(F.map_entries("starts_by_zoom"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","))


def catalogue_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each user, its events as they come, at the end of the log; rows count for an hour."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in FRESHNESS_KINDS]), (1 + F.col("seq") * 7919 % len(FRESHNESS_KINDS)).cast("int"))
    events = _log(spark, sf_dir).select(F.col("key").alias("group"), "seq", (F.col("seq") * 700).alias("ts_ms"), kinds.alias("kind"), (F.col("seq") % 50).alias("rows"))
    end = events.agg(F.max("ts_ms")).first()[0] or 0
    return state.catalogue_freshness(events, F.lit(end), 3_600_000)


QUERIES = {f.__name__: f for f in (duration_summary, timings_by_host, failure_counts, provider_metrics, classify_failures, cache_identity, expand_tile_urls, coalesce_demand, rolling_frame_window, revision_changes, cut_churn, running_load, repeat_requests, provider_outages, provider_circuit, reconcile_requirements, reuse_by_revision, cache_outcomes, route_audit, route_cut_changes, catalogue_freshness)}

_SUM = lambda v, o: f"round(arg_max({v}, {o}), 2) AS latest, round(avg({v}), 2) AS mean, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY {v}), 2) AS p50, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY {v}), 2) AS p95, round(percentile_disc(0.99) WITHIN GROUP (ORDER BY {v}), 2) AS p99, round(max({v}), 2) AS max"



def _frames(v: str, name: str) -> str:
    two = lambda x, part: f"floor({x} * 100 + 0.5) / 100 AS {name}_{part}"
    rank = lambda p: f"percentile_disc({p}) WITHIN GROUP (ORDER BY {v})"
    parts = {"latest": f"arg_max_null({v}, (b.ts_ms, b.seq))", "mean": f"avg({v})", "p50": rank(0.5), "p95": rank(0.95), "p99": rank(0.99), "max": f"max({v})"}
    return ", ".join(two(x, part) for part, x in parts.items())


ORACLES = {
    "duration_summary": f"WITH {LOG} SELECT key, {_SUM('value', '(ts_ms, seq)')} FROM log GROUP BY key",
    "timings_by_host": f"WITH t AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN url END AS url, strlen(html) AS b, (page_id % 97)::DOUBLE AS d FROM pages) SELECT CAST(ceil(page_id / 30.0) AS BIGINT) * 30 AS until, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), 'same-origin') AS host, count(*) AS requests, sum(b)::BIGINT AS transfer_bytes, sum(2 * b)::BIGINT AS encoded_bytes, {_SUM('d', '(page_id, url)')} FROM t GROUP BY 1, 2",
    "failure_counts": f"WITH {LOG}, f AS (SELECT * FROM log WHERE kind = 'failure'), c AS (SELECT key, status, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT key, arg_max_null(status, seq) AS last_status FROM f GROUP BY key) SELECT c.key, coalesce(string_agg(status || ':' || n, ',' ORDER BY status) FILTER (status IS NOT NULL), '') AS counts, coalesce(sum(n) FILTER (status IS NULL), 0)::BIGINT AS opaque, any_value(last_status) AS last_status FROM c JOIN l USING (key) GROUP BY c.key",
    "provider_metrics": f"WITH {LOG}, k AS (SELECT provider, duration_ms, CASE WHEN seq % 3 = 0 THEN {CACHE_KINDS}[1 + seq % 6] ELSE kind END AS kind FROM log) SELECT provider, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'in-flight') AS loads, count(*) FILTER (kind = 'response') AS responses, count(*) FILTER (kind = 'failure') AS failures, count(*) FILTER (kind = 'cancellation') AS cancellations, count(*) FILTER (kind = 'cache-lookup') AS cache_lookups, count(*) FILTER (kind = 'cache-hit') AS cache_hits, count(*) FILTER (kind = 'memory-hit') AS memory_hits, count(*) FILTER (kind = 'shared') AS shared, count(*) FILTER (kind = 'persistent-hit') AS persistent_hits, count(*) FILTER (kind = 'persistent-write') AS persistent_writes, coalesce(sum(duration_ms * 10) FILTER (kind = 'response'), 0)::BIGINT AS bytes, count(*) FILTER (kind = 'response') * 262144 AS decoded_bytes FROM k GROUP BY provider",
    "classify_failures": f"WITH {LOG}, c AS (SELECT seq, CASE WHEN status IS NULL THEN provider = 1 OR seq % 4 = 0 WHEN status = 404 THEN false WHEN provider = 1 THEN true ELSE status IN (400, 401, 403, 410, 429) OR status >= 500 END AS systemic, coalesce(status NOT IN (400, 401, 403, 410, 404), true) AS retryable FROM log) SELECT *, CASE WHEN NOT retryable THEN CASE WHEN systemic THEN 'provider' ELSE 'tile' END END AS scope FROM c",
    "cache_identity": """WITH p AS (SELECT page_id, url, split_part(CASE WHEN page_id % 6 = 0 THEN replace(url, '.com/', '.com:8443/') ELSE url END, '#', 1) AS u, strlen(html) AS body, [NULL, 'public, max-age=60', 'no-store', 'private, max-age=5'][1 + page_id % 4] AS control FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda x: x <> '' AND split_part(x, '=', 1) <> 'ref')) AS kept, CASE WHEN control LIKE '%no-store%' OR control LIKE 'private%' THEN 0 WHEN control IS NOT NULL THEN 60000 WHEN page_id % 8 = 0 THEN 5000 ELSE 86400000 END AS life FROM p)
SELECT page_id, life AS lifetime_ms, page_id % 7 <> 0 AND page_id % 3 <> 0 AND body > 0 AND life > 0 AS cacheable, page_id * 1000 + life AS expires_at, sha256(split_part(u, '?', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) AS identity FROM q""",
    "expand_tile_urls": "WITH t AS (SELECT DISTINCT p_partkey % 9 AS z, p_partkey * 7 % 300 AS x, p_partkey * 11 % 300 AS y FROM part) SELECT z, x, y, 'https://tiles.test/' || x || '/' || z || '/' || ((1 << z) - 1 - y) || '.webp' AS url FROM t WHERE z BETWEEN 2 AND 8 AND x < (1 << z) AND y < (1 << z)",
    "coalesce_demand": f"WITH {V.POSITIONS}, t AS (SELECT z.z AS z, {V.tx(z='z.z')} AS x, {V.ty(z='z.z')} AS y, id, observer_id FROM positions, (VALUES (6), (9)) z(z)) SELECT least(z, 7) AS source_z, x >> (z - least(z, 7)) AS source_x, y >> (z - least(z, 7)) AS source_y, count(DISTINCT observer_id) AS consumers, max(z) AS priority, min(id) AS first_seq, count(*) - 1 AS shared FROM t GROUP BY 1, 2, 3",
    "rolling_frame_window": f"""WITH {LOG}, s AS (SELECT key, seq * 37 % 100003 AS ts_ms, seq, floor(value * 4) / 4 AS i, CASE WHEN seq % 11 > 0 THEN (seq * 13 % 257) / 8.0::DOUBLE END AS c, seq % 5 > 0 AS shown FROM log),
w AS (SELECT a.seq, count(*) AS frames, max(b.ts_ms) - min(b.ts_ms) AS span_ms, count(*) FILTER (b.i > 1.05::DOUBLE * 1000 / 90.0::DOUBLE) AS over_budget, count(*) FILTER (b.shown) AS rendered_frames,
  {_frames('b.i', 'interval')}, {_frames('b.c', 'cpu')} FROM s a JOIN s b ON a.key = b.key AND b.ts_ms BETWEEN a.ts_ms - 10000 AND a.ts_ms GROUP BY a.seq)
SELECT *, CASE WHEN span_ms > 0 THEN floor((frames - 1) * 1000 / span_ms::DOUBLE * 100 + 0.5) / 100 END AS fps FROM w""",
    "revision_changes": f"WITH {LOG}, p AS (SELECT key, seq, revision, lag(revision) OVER (PARTITION BY key ORDER BY seq) AS previous FROM log) SELECT * FROM p WHERE revision IS DISTINCT FROM previous",
    "cut_churn": f"WITH {V.POSITIONS}, t AS (SELECT DISTINCT observer_id AS cut_id, id % 5 AS rev, {V.tx(z='2')} AS x, {V.ty(z='2')} AS y FROM positions), r AS (SELECT *, lag(rev) OVER (PARTITION BY cut_id ORDER BY rev) AS was FROM (SELECT DISTINCT cut_id, rev FROM t)) SELECT cut_id, rev, (SELECT count(*) FROM t a WHERE a.cut_id = r.cut_id AND a.rev = r.rev AND NOT EXISTS (SELECT 1 FROM t b WHERE b.cut_id = r.cut_id AND b.rev = r.was AND b.x = a.x AND b.y = a.y)) AS added, (SELECT count(*) FROM t a WHERE a.cut_id = r.cut_id AND a.rev = r.was AND NOT EXISTS (SELECT 1 FROM t b WHERE b.cut_id = r.cut_id AND b.rev = r.rev AND b.x = a.x AND b.y = a.y)) AS removed FROM r WHERE was IS NOT NULL",
    "running_load": f"WITH {LOG}, d AS (SELECT provider, seq, sum(CASE WHEN kind = 'request' THEN 1 WHEN kind IN ('in-flight', 'cancellation') THEN -1 ELSE 0 END) OVER w AS q, sum(CASE WHEN kind = 'in-flight' THEN 1 WHEN kind IN ('response', 'failure') THEN -1 ELSE 0 END) OVER w AS f FROM log WINDOW w AS (PARTITION BY provider ORDER BY seq)) SELECT provider, max(q)::BIGINT AS queued, max(f)::BIGINT AS in_flight, max(q + f)::BIGINT AS outstanding, min(q + f)::BIGINT AS least FROM d GROUP BY provider",
    "repeat_requests": f"WITH {LOG}, p AS (SELECT key, kind, lag(kind) OVER (PARTITION BY key ORDER BY seq) AS last FROM log) SELECT key, count(*) FILTER (kind = 'request') AS starts, greatest(0, count(*) FILTER (kind = 'request') - 1) AS duplicates, count(*) FILTER (kind = 'request' AND last IN ('cancellation', 'failure')) AS restarts FROM p GROUP BY key",
    "provider_outages": f"WITH {LOG}, h AS (SELECT provider, seq, seq * 900 AS ts_ms, seq * 900 + greatest(5000, retry_after_ms) AS until FROM log WHERE status IN (429, 503)), m AS (SELECT *, coalesce(ts_ms > max(until) OVER (PARTITION BY provider ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM h), i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY provider ORDER BY ts_ms, seq) AS n FROM m) SELECT provider, min(ts_ms) AS open_from, max(until) AS open_until, count(*) AS failures FROM i GROUP BY provider, n",
    "provider_circuit": f"""WITH RECURSIVE {LOG}, e AS (SELECT seq % 7 AS provider, seq, seq * 900 AS ts, row_number() OVER (PARTITION BY seq % 7 ORDER BY seq) AS n,
  CASE WHEN seq % 5 = 0 AND seq % 15 > 0 THEN CASE WHEN seq % 1009 = 0 THEN 2 ELSE 1 END ELSE 0 END AS code,
  CASE WHEN seq % 5 = 0 AND seq % 15 > 0 THEN seq * 900 + CASE WHEN seq % 3 > 0 THEN seq * 104729 % 40000 ELSE 0 END ELSE seq * 900 - seq * 7919 % 10000 END AS v FROM log WHERE seq % 5 = 0 OR seq % 13 <> 1),
f(provider, n, kind, until, since, opener, ts, was, outage) AS (
  SELECT DISTINCT provider, 0::BIGINT, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0, NULL::BIGINT FROM e
  UNION ALL
  SELECT f.provider, e.n, CASE WHEN kind = 2 OR code = 2 THEN 2 WHEN code = 1 THEN 1 WHEN kind = 1 AND v < f.until THEN 1 ELSE 0 END,
    CASE WHEN kind < 2 AND code = 1 THEN greatest(coalesce(f.until, v), v) WHEN kind = 1 AND code = 0 AND v < f.until THEN f.until END,
    CASE WHEN kind = 0 AND code > 0 THEN e.ts WHEN kind = 1 AND code = 0 AND v >= f.until THEN NULL ELSE since END,
    CASE WHEN kind = 0 AND code > 0 THEN e.seq WHEN kind = 1 AND code = 0 AND v >= f.until THEN NULL ELSE opener END,
    e.ts, kind, CASE WHEN kind < 2 AND (code > 0 OR kind = 1 AND v >= f.until) THEN CASE WHEN kind = 0 THEN e.seq ELSE opener END END
  FROM f JOIN e ON e.provider = f.provider AND e.n = f.n + 1)
SELECT provider, min(since) AS open_from, CASE WHEN max(kind) < 2 THEN max(until) END AS open_until, max(ts) FILTER (kind = 0) AS closed_at, count(*) FILTER (kind > 0) AS failures, max(kind) = 2 AS fatal
FROM f WHERE outage IS NOT NULL GROUP BY provider, outage""",
    "catalogue_freshness": f"""WITH RECURSIVE {LOG}, e AS (SELECT key, seq * 700 AS t, {FRESHNESS_KINDS}[1 + seq * 7919 % {len(FRESHNESS_KINDS)}] AS kind, seq % 50 AS rows, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM log),
f(key, n, enabled, out, failed, fetched, rows) AS (
  SELECT DISTINCT key, 0::BIGINT, false, false, false, NULL::BIGINT, 0::BIGINT FROM e
  UNION ALL
  SELECT f.key, e.n, CASE kind WHEN 'enable' THEN true WHEN 'disable' THEN false ELSE enabled END, CASE WHEN kind = 'request' THEN enabled ELSE out AND kind = 'enable' END,
    CASE WHEN kind = 'request' AND enabled THEN false WHEN out AND kind IN ('failed', 'loaded') THEN kind = 'failed' ELSE failed END,
    CASE WHEN out AND kind = 'loaded' THEN e.t ELSE fetched END, CASE WHEN out AND kind = 'loaded' THEN e.rows ELSE f.rows END
  FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1),
z AS (SELECT f.*, (SELECT max(t) FROM e) AS now FROM f QUALIFY n = max(n) OVER (PARTITION BY key))
SELECT key AS "group", CASE WHEN NOT enabled THEN 'off' WHEN out THEN 'loading' WHEN failed THEN 'unavailable' WHEN fetched IS NOT NULL THEN 'loaded' ELSE 'ready' END AS status, rows, fetched AS fetched_at_ms,
  failed AND rows > 0 AS stale, enabled AND NOT out AND NOT failed AND coalesce(now - fetched >= 3600000, true) AS due FROM z""",
    "route_cut_changes": f"""WITH {V.POSITIONS}, t AS (SELECT DISTINCT id % 2 AS pipeline, id // 500 AS rev, {V.tx(z='4')} AS x, {V.ty(z='4')} AS y FROM positions),
r AS (SELECT *, lag(rev) OVER (PARTITION BY pipeline ORDER BY rev) AS was FROM (SELECT DISTINCT pipeline, rev FROM t)),
d AS (SELECT pipeline, rev, count(*) FILTER (side = 'now') AS added, count(*) FILTER (side = 'was') AS removed FROM (
  SELECT 'now' AS side, r.pipeline, r.rev FROM r JOIN t USING (pipeline, rev) WHERE was IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.pipeline = r.pipeline AND b.rev = r.was AND b.x = t.x AND b.y = t.y)
  UNION ALL SELECT 'was', r.pipeline, r.rev FROM r JOIN t a ON a.pipeline = r.pipeline AND a.rev = r.was WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.pipeline = r.pipeline AND b.rev = r.rev AND b.x = a.x AND b.y = a.y)) GROUP BY ALL),
c AS (SELECT r.pipeline, r.rev * 350000 AS ts, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM r LEFT JOIN d USING (pipeline, rev) WHERE was IS NOT NULL),
p AS (SELECT r_name AS phase, r_regionkey * 1200000 + 100 AS from_ms FROM region)
SELECT pipeline, phase, count(*) AS revisions, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM c ASOF LEFT JOIN p ON c.ts >= p.from_ms GROUP BY ALL""",
    "reconcile_requirements": "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ready' ELSE 'in-flight' END END AS state, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'keep' WHEN p_partkey % 3 <> 0 THEN 'request' WHEN p_size % 2 = 0 THEN 'discard' ELSE 'cancel' END AS action FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    "reuse_by_revision": "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 > 0 AND p_partkey % 6 >= p_size % 5 THEN 'reuse' ELSE 'new' END WHEN p_partkey % 4 = 0 THEN 'keep' ELSE 'free' END AS action FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    "cache_outcomes": f"WITH {LOG}, e AS (SELECT key, provider, seq, seq * 700 AS ts, seq * 700 + duration_ms AS fin, status FROM log), w AS (SELECT *, max(CASE WHEN status BETWEEN 200 AND 299 THEN fin + 60000 END) OVER h AS fresh, max(fin) OVER h AS flight, max(CASE WHEN status IN (429, 503) THEN fin + 5000 END) OVER c AS cool FROM e WINDOW h AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY provider ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT seq, CASE WHEN fresh > ts THEN 'HIT' WHEN cool > ts AND provider = 1 THEN 'FALLBACK' WHEN flight > ts THEN 'COALESCED' WHEN coalesce(status IN (429, 503), false) AND provider = 1 THEN 'FALLBACK' ELSE 'MISS' END AS outcome FROM w",
    "route_audit": f"""WITH {LOG}, w AS (SELECT provider, key, seq, kind, revision, seq * 700 AS t, seq % 4 AS z, lag(kind) OVER (PARTITION BY provider, key ORDER BY seq) AS last, max(CASE WHEN kind = 'request' THEN revision END) OVER (PARTITION BY provider, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM log),
c AS (SELECT provider, count(*) FILTER (kind = 'request') AS starts, count(*) FILTER (kind = 'response') AS successes, count(*) FILTER (kind = 'cancellation') AS aborts, count(*) FILTER (kind = 'failure') AS failures, count(DISTINCT key) FILTER (kind = 'request') AS unique_keys,
count(*) FILTER (kind = 'request' AND last = 'cancellation') AS restarts, count(*) FILTER (kind = 'response' AND newest > revision) AS stale_successes, count(*) FILTER (kind = 'request' AND t BETWEEN 500000 AND 2000000) AS starts_in_ride, count(*) FILTER (kind = 'request' AND t > 2000000) AS starts_after_ride FROM w GROUP BY provider),
z AS (SELECT provider, string_agg(z || ':' || n, ',' ORDER BY z) AS starts_by_zoom FROM (SELECT provider, z, count(*) AS n FROM w WHERE kind = 'request' GROUP BY ALL) GROUP BY provider)
SELECT c.*, starts_by_zoom, greatest(0, starts - successes - aborts - failures) AS pending, starts - unique_keys AS duplicates FROM c LEFT JOIN z USING (provider)""",
}
