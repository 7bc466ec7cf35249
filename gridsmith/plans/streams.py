"""Streams over the events table, run to their end, beside their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.plans.extraction import folder
from gridsmith.registry import query
from gridsmith.session import Tables
from gridsmith.streaming import limits, stateful

c = F.col


def spans(t: Tables, n: int = 4) -> list[DataFrame]:
    """The events in n parts in order of time, rows without a time in the first."""
    events = t.events.withColumn("ts", c("ts").cast("timestamp"))  # event times need a zone
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if first is None:
        return [events]
    at = F.coalesce(F.floor((F.unix_micros("ts") - first) * n / (last - first + 1)), F.lit(0))
    return [events.filter(at == i) for i in range(n)]


def drained(t: Tables, shape: Callable[[DataFrame], DataFrame], parts: list[DataFrame], mode: str = "append") -> DataFrame:
    """All rows that a stream gives whose input arrives part by part. Each part is written by
    many tasks and taken as a whole by a run that goes on from the checkpoint of the last one."""
    given, path, marks = folder(t), folder(t), folder(t)
    out = None
    for part in parts:
        part.write.mode("append").parquet(given)
        out = shape(t.spark.readStream.schema(part.schema).parquet(given))
        q = out.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).queryName("q" + uuid.uuid4().hex).start()
        q.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(path)


_SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"


@query("r1_session_limit", _SESSIONS)
def r1(t: Tables) -> DataFrame:
    return limits.sessions(t.events, "2 hours", 5).select("user_id", "start", "n")


#: A session ends with the stream only if the watermark, ten minutes behind, has passed its end.
_CLOSED = _SESSIONS.replace("SELECT user_id, min(ts) AS start, count(*) AS n FROM s", 'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, count(*) > 5 AS limited FROM s') + " HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query("r1_session_limit_stream", _CLOSED)
def r1_stream(t: Tables) -> DataFrame:
    return drained(t, lambda e: limits.sessions(e, "2 hours", 5), spans(t))


_HEALTH = "WITH e AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events WHERE event_type IN ('error','purchase')) SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM e"


@query("r2_health_state", _HEALTH)
def r2(t: Tables) -> DataFrame:
    return drained(t, limits.health, spans(t)).select("user_id", "event_id", c("failures").cast("long").alias("failures"))


@query("r2_health_batch", _HEALTH)
def r2_batch(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t.events.filter(c("event_type").isin("error", "purchase")).withColumn("k", F.count_if(c("event_type") == "purchase").over(w))
    w2 = Window.partitionBy("user_id", "k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("user_id", "event_id", F.count_if(c("event_type") == "error").over(w2).alias("failures"))


_REST = "(event_id % 9 + 1) * 3600000"

#: A provider that rests is back when an event after that time or the watermark, ten minutes behind, says so.
_PROVIDERS = f"""WITH w AS (SELECT (epoch_us(max(ts)) // 1000) - 600000 AS mark FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
e AS (SELECT user_id AS provider, event_id, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'limited' END AS kind, {_REST} AS rest FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
k AS (SELECT *, count(*) FILTER (WHERE kind = 'success') OVER o AS k, lead(t) OVER (PARTITION BY provider, kind <> 'failure' ORDER BY t, event_id) AS after, max(t) OVER (PARTITION BY provider) AS last FROM e WINDOW o AS (PARTITION BY provider ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, count(*) FILTER (WHERE kind = 'failure') OVER o AS failures, last_value(CASE WHEN kind = 'limited' THEN t + rest END IGNORE NULLS) OVER o AS until FROM k WINDOW o AS (PARTITION BY provider, k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT provider, k, t + rest AS t, (SELECT count(*) FROM s f WHERE f.provider = s.provider AND f.k = s.k AND f.kind = 'failure' AND f.t < s.t + s.rest) AS failures FROM s, w WHERE kind = 'limited' AND (after IS NULL OR after >= t + rest) AND (last >= t + rest OR t + rest < mark)),
a AS (SELECT provider, event_id, kind, t, failures, CASE WHEN t < until THEN until END AS until, k FROM s UNION ALL SELECT provider, NULL, 'rested', t, failures, NULL, k FROM r)
SELECT provider, event_id, kind, make_timestamp(t * 1000) AS "at", CAST(failures AS INTEGER) AS failures, make_timestamp(until * 1000) AS until, CASE WHEN until IS NOT NULL THEN 'rate_limited' WHEN failures >= 3 THEN 'unhealthy' WHEN k > 0 THEN 'active' ELSE 'untested' END AS status FROM a"""


@query("r2_provider_health", _PROVIDERS)
def r2_providers(t: Tables) -> DataFrame:
    """Purchases succeed, errors fail, signups meet a limit and rest one to nine hours."""
    kind = F.when(c("event_type") == "purchase", "success").when(c("event_type") == "error", "failure").when(c("event_type") == "signup", "limited")
    out = stateful.with_store(t.spark, lambda: drained(t, lambda e: stateful.health(e, "user_id", kind, F.expr(_REST)), spans(t)))
    return out.select("provider", "event_id", "kind", c("at").cast("timestamp_ntz").alias("at"), "failures", c("until").cast("timestamp_ntz").alias("until"), "status")


#: One event after another, for all caches at once.
_CACHE = """WITH RECURSIVE e AS (SELECT user_id AS cache, event_id, (epoch_us(ts) // 1000) AS at, 'd' || (event_id * 7 % 30) AS name, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
w(cache, event_id, n, hit, held) AS (
  SELECT DISTINCT cache, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS STRUCT("at" BIGINT, event_id BIGINT, name VARCHAR)[]) FROM e
  UNION ALL
  SELECT cache, event_id, n, hit, CASE WHEN hit THEN held WHEN len(more) > 10 THEN list_sort(more)[3:] ELSE more END FROM (
    SELECT e.cache, e.event_id, e.n, w.held, len(list_filter(w.held, lambda x: x.name = e.name AND e.at - x.at <= 345600000)) > 0 AS hit,
      list_append(list_filter(w.held, lambda x: e.at - x.at <= 345600000 AND x.name <> e.name), {'at': e.at, 'event_id': e.event_id, 'name': e.name}) AS more
    FROM w JOIN e ON e.cache = w.cache AND e.n = w.n + 1))
SELECT cache, event_id, hit, CAST(len(held) AS INTEGER) AS size FROM w WHERE n > 0"""


@query("r3_cache_stream", _CACHE)
def r3_stream(t: Tables) -> DataFrame:
    """A cache of ten entries and four days for each user, of which the two oldest go when it is full."""
    name = F.concat(F.lit("d"), c("event_id") * 7 % 30)
    return stateful.with_store(t.spark, lambda: drained(t, lambda e: stateful.cached(e, c("user_id"), name, 345_600_000, 10), spans(t))).drop("gone")


@query("r4_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def r4(t: Tables) -> DataFrame:
    return drained(t, lambda e: limits.first_seen(e, ["user_id", "event_type"], "60 days"), spans(t)).select("user_id", "event_type")


@query("r6_tail_sampling", "SELECT event_id, event_type FROM events WHERE event_type = 'error' OR value > 2000 OR CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:8] AS UBIGINT) % 10 = 0")
def r6(t: Tables) -> DataFrame:
    return drained(t, limits.sampled, spans(t)).select("event_id", "event_type")


@query("r7_cross_run_memory", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def r7(t: Tables) -> DataFrame:
    return drained(t, lambda e: limits.remembered(e, t.supplier.select(c("s_suppkey").alias("user_id")), "user_id"), spans(t)).select("event_id")


_R8 = """WITH e AS (SELECT *, date_trunc('hour', ts) AS start FROM events WHERE ts IS NOT NULL), m AS (SELECT date_trunc('milliseconds', max(ts) FILTER (WHERE event_id % 10 > 0)) - INTERVAL 1 DAY AS early, date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS last FROM e)
SELECT start, count(*) AS n FROM e, m WHERE start + INTERVAL 1 HOUR <= last AND (event_id % 10 > 0 OR start + INTERVAL 1 HOUR > early) GROUP BY 1"""


@query("r8_late_events", _R8)
def r8(t: Tables) -> DataFrame:
    """Every tenth event arrives after all others and counts only if its hour is still open."""
    events, k = t.events.withColumn("ts", c("ts").cast("timestamp")), c("event_id") % 10
    return drained(t, limits.hourly, [events.filter(k > 0), events.filter(k == 0)])
