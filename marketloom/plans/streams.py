"""Streaming queries: each drains a file stream once and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.files import KeyedTable, scratch
from ..sources.logical import twin
from ..streaming import jobs


def _ticks(spark, sf_dir) -> DataFrame:
    e = jobs.stream_of(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_type")


@query("stream_bars", twin("SELECT symbol, ts::DATE AS start, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, count(*)::BIGINT AS n FROM ticks GROUP BY ALL"))
def stream_bars(spark, sf_dir) -> DataFrame:
    """Bars of every window, the open ones included."""
    out = jobs.drain_upserts(jobs.bars_from_ticks(_ticks(spark, sf_dir)), "bars", ["symbol", "start"])
    return out.select("symbol", F.to_date("start").alias("start"), "open", "high", "low", "close", "n")


@query("stream_dedupe", twin("SELECT symbol, event_type FROM ticks GROUP BY ALL"))
def stream_dedupe(spark, sf_dir) -> DataFrame:
    return jobs.drain(jobs.deduplicated(_ticks(spark, sf_dir), ["symbol", "event_type"]).select("symbol", "event_type"), "dedupe")


_HITS = ("h", "SELECT symbol, id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS n FROM ticks")
_LOG = ("lg", """SELECT symbol, id, n, t, [t] AS q, true AS admitted, NULL::BIGINT AS retry FROM h WHERE n = 1
  UNION ALL SELECT symbol, id, n, t, CASE WHEN len(f) < 3 THEN list_append(f, t) ELSE f END, len(f) < 3, CASE WHEN len(f) >= 3 THEN greatest(1, ceil(f[1] + 21600 - t))::BIGINT END
  FROM (SELECT h.symbol, h.id, h.n, h.t, list_filter(lg.q, lambda x: x > h.t - 21600) AS f FROM lg JOIN h ON h.symbol = lg.symbol AND h.n = lg.n + 1)""")


@query("stream_rate_limit", twin("SELECT symbol, id, admitted, retry FROM lg", _HITS, _LOG, recursive=True))
def stream_rate_limit(spark, sf_dir) -> DataFrame:
    """At most three hits of a symbol in any six hours; what is refused does not count."""
    return jobs.drain(jobs.limited(_ticks(spark, sf_dir), "symbol", 3, 6 * 3600.0), "rate")


@query("stream_hits", twin("SELECT symbol, start, count(*)::BIGINT AS n FROM (SELECT symbol, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM ticks) GROUP BY ALL HAVING count(*) > 6"))
def stream_hits(spark, sf_dir) -> DataFrame:
    """Windows of six hours, every three, with more than six hits."""
    out = jobs.drain_upserts(jobs.hits_per_window(_ticks(spark, sf_dir)), "hits", ["symbol", "start"])
    return out.where("n > 6").select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_sessions", twin("SELECT symbol, count(*)::BIGINT AS sessions, sum(k)::BIGINT AS hits FROM (SELECT symbol, s, count(*) AS k FROM (SELECT symbol, ts, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT symbol, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL 2 HOUR, true))::INT AS new FROM ticks)) GROUP BY ALL) GROUP BY symbol"))
def stream_sessions(spark, sf_dir) -> DataFrame:
    out = jobs.drain_complete(jobs.sessions(_ticks(spark, sf_dir)), "sessions")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("hits"))


@query("stream_alerts", twin("SELECT symbol, level, direction, arg_min(price, (ts, id)) AS price, min(id) AS id FROM ticks JOIN (SELECT * FROM (VALUES ('S1', 60::DOUBLE, 'above'), ('S2', 5::DOUBLE, 'below'), ('S3', 90::DOUBLE, 'above'), ('S4', 1000000::DOUBLE, 'above')) v(symbol, level, direction)) USING (symbol) WHERE CASE WHEN direction = 'above' THEN price >= level ELSE price <= level END GROUP BY ALL"))
def stream_alerts(spark, sf_dir) -> DataFrame:
    levels = spark.createDataFrame([("S1", 60.0, "above"), ("S2", 5.0, "below"), ("S3", 90.0, "above"), ("S4", 1e6, "above")], "symbol string, level double, direction string")
    return jobs.drain(jobs.alerts_once(_ticks(spark, sf_dir), levels), "alerts")


@query("stream_upsert", twin("SELECT symbol, ts::DATE AS day, arg_max(price, (ts, id)) AS price FROM ticks GROUP BY ALL"))
def stream_upsert(spark, sf_dir) -> DataFrame:
    """The last price of each symbol and day, kept by a stream in a keyed table that is laid out by day."""
    t = _ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("day"), "price", "ts", "id")
    table = KeyedTable(spark, scratch(spark, "ticks"), ["symbol", "day"], "symbol string, day date, price double, ts timestamp, id bigint", buckets=1, part=F.col("day"))
    jobs.upsert_into(t, table, [F.desc("ts"), F.desc("id")], "ticks", scratch(spark, "ticks-checkpoint"))
    return table.read().select("symbol", "day", "price")


@query("stream_cache", twin("""SELECT id, key, CASE WHEN op = 'set' AND ts <= since + to_seconds(ttl) THEN 'hit' ELSE 'miss' END AS result, CASE WHEN op = 'set' AND ts <= since + to_seconds(ttl) THEN value END AS value FROM (
  SELECT g.id, g.key, g.ts, arg_max(w.op, (w.ts, w.id)) AS op, arg_max(w.ts, (w.ts, w.id)) AS since, arg_max(w.ttl, (w.ts, w.id)) AS ttl, arg_max(w.value, (w.ts, w.id)) AS value
  FROM (SELECT * FROM o WHERE op = 'get') g LEFT JOIN (SELECT * FROM o WHERE op <> 'get') w ON w.key = g.key AND (w.ts, w.id) < (g.ts, g.id) GROUP BY ALL)""",
  ("o", "SELECT id, symbol AS key, ts, CASE WHEN id % 5 < 2 THEN 'set' WHEN id % 5 = 2 AND id % 3 = 0 THEN 'invalidate' ELSE 'get' END AS op, price AS value, (1 + id % 4) * 1800 AS ttl FROM ticks")))
def stream_cache(spark, sf_dir) -> DataFrame:
    """What a cache of the newest prices, each with its time to live, answers to every request."""
    i = F.col("id")
    op = F.when(i % 5 < 2, "set").when((i % 5 == 2) & (i % 3 == 0), "invalidate").otherwise("get")
    o = _ticks(spark, sf_dir).withWatermark("ts", "1 hour").select(F.col("symbol").alias("key"), "id", "ts", op.alias("op"), F.col("price").alias("value"), ((1 + i % 4) * 1800).alias("ttl"))
    out = jobs.drain(jobs.expiring_cache(o), "cache")
    return out.where("result <> 'expired'").select("id", "key", "result", "value")
