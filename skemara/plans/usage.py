"""Usage and latency queries over a request log made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.operators import usage as U
from skemara.plans.derived import LOG_SQL, request_log
from skemara.registry import query, table
from skemara.sources.scratch import scratch
from skemara.streaming import usage as streams

_STATS = "count(*) AS requests, sum(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS errors, avg(duration_ms) AS avg_ms, quantile_cont(duration_ms, 0.5) AS p50_ms, quantile_cont(duration_ms, 0.95) AS p95_ms"


@query(f"SELECT {_STATS} FROM {LOG_SQL}")
def u1_totals(spark: SparkSession, sf: str) -> DataFrame:
    return U.totals(request_log(spark, sf))


@query(f"SELECT op, {_STATS} FROM {LOG_SQL} GROUP BY op ORDER BY requests DESC, op LIMIT 50")
def u2_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    return U.summary_by(request_log(spark, sf), "op")


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS requests, sum(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS errors FROM {LOG_SQL} GROUP BY 1")
def u3_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return U.per_period(request_log(spark, sf)).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(f"SELECT route, method, {_STATS} FROM {LOG_SQL} GROUP BY route, method ORDER BY requests DESC, route, method LIMIT 50")
def u4_by_route(spark: SparkSession, sf: str) -> DataFrame:
    return U.summary_by(request_log(spark, sf), "route", "method")


@query(f"SELECT run_id, count(*) AS requests FROM {LOG_SQL} WHERE trim(run_id) <> '' GROUP BY run_id")
def u5_runs(spark: SparkSession, sf: str) -> DataFrame:
    return U.runs(request_log(spark, sf))


@query(f"SELECT query_text, count(*) AS requests, count(DISTINCT run_id) AS runs FROM {LOG_SQL} WHERE query_text <> '' GROUP BY query_text ORDER BY requests DESC, query_text LIMIT 50")
def u6_top_queries(spark: SparkSession, sf: str) -> DataFrame:
    return U.top_queries(request_log(spark, sf), "query_text", "run_id")


@query(f"SELECT request_id, ts, query_text FROM {LOG_SQL} ORDER BY ts DESC, request_id DESC LIMIT 50")
def u7_recent(spark: SparkSession, sf: str) -> DataFrame:
    return U.recent(request_log(spark, sf)).select("request_id", "ts", "query_text")


@query(f"""SELECT request_id, ts, route FROM {LOG_SQL} WHERE starts_with(run_id, 'run1') AND contains(lower(route), 'pur') AND upper(method) = 'GET' AND success
AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00' ORDER BY ts DESC, request_id DESC LIMIT 20 OFFSET 5""")
def u8_page(spark: SparkSession, sf: str) -> DataFrame:
    return U.page(request_log(spark, sf), run_prefix="run1", route_has="PUR", method="get", success=True, since="2024-01-02", until="2024-01-28", limit=20, offset=5).select("request_id", "ts", "route")


@query(f"SELECT query_text, max(ts) AS ts, arg_max(request_id, (ts, request_id)) AS request_id FROM {LOG_SQL} GROUP BY query_text")
def u9_latest(spark: SparkSession, sf: str) -> DataFrame:
    return U.latest_of(request_log(spark, sf).select("query_text", "ts", "request_id"), "query_text")


@query("SELECT event_id AS request_id, ts, json_extract_string(props, '$.page') AS page FROM events ORDER BY ts DESC, event_id DESC LIMIT 200000")
def u10_export(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumnRenamed("event_id", "request_id")
    return U.export(log, ["request_id", "ts", "props"], {"props": "page string"}).select("request_id", "ts", F.col("props.page").alias("page"))


@query(f"""WITH v AS (SELECT op, list_sort(list(duration_ms)) AS v, count(*) AS n, sum(duration_ms) AS total, avg(duration_ms) AS mean, min(duration_ms) AS least, max(duration_ms) AS most FROM {LOG_SQL} GROUP BY op)
SELECT op, n, total, mean, least, most, v[CAST(least(n * 50 // 100 + 1, n) AS INT)] AS p50, v[CAST(least(n * 95 // 100 + 1, n) AS INT)] AS p95, v[CAST(least(n * 99 // 100 + 1, n) AS INT)] AS p99 FROM v""")
def u11_latency(spark: SparkSession, sf: str) -> DataFrame:
    return U.latency(request_log(spark, sf))


@query(f"""WITH r AS (SELECT op, duration_ms, row_number() OVER (PARTITION BY op ORDER BY ts DESC, request_id DESC) AS k FROM {LOG_SQL}),
v AS (SELECT op, list_sort(list(duration_ms)) AS v, count(*) AS n FROM r WHERE k <= 100 GROUP BY op)
SELECT op, n, v[CAST(least(n * 50 // 100 + 1, n) AS INT)] AS p50, v[CAST(least(n * 95 // 100 + 1, n) AS INT)] AS p95 FROM v""")
def u11_latency_window(spark: SparkSession, sf: str) -> DataFrame:
    return U.latency_of_window(request_log(spark, sf))


@query(f"""SELECT 'engine_requests_total{{op="' || op || '"}} ' || CAST(count(*) AS VARCHAR) AS line FROM {LOG_SQL} GROUP BY op""")
def u12_exposition(spark: SparkSession, sf: str) -> DataFrame:
    return U.exposition(U.snapshot(request_log(spark, sf))).filter(F.contains("line", F.lit("requests_total")))


@query(f"""SELECT op, count(*) AS requests, avg(CASE WHEN success THEN 0.0 ELSE 1.0 END) AS error_rate, count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1.0) AS per_minute FROM {LOG_SQL} GROUP BY op""")
def u12_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return U.snapshot(request_log(spark, sf))


@query("""SELECT event_id, substr(event_type || repeat('x', CAST(event_id % 20 AS INT)), 1, 12) AS query_text, '***' AS token, event_type AS op FROM events""")
def u13_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select("event_id", F.concat("event_type", F.repeat(F.lit("x"), (F.col("event_id") % 20).cast("int"))).alias("query_text"), F.col("props").alias("response"), F.create_map(F.lit("Auth_Token"), F.col("props"), F.lit("op"), F.col("event_type")).alias("params"))
    return U.log_rows(rows, query_chars=12).select("event_id", "query_text", F.col("params")["Auth_Token"].alias("token"), F.col("params")["op"].alias("op"))


@query(f"SELECT request_id, duration_ms FROM {LOG_SQL} WHERE duration_ms > 90")
def u14_slow(spark: SparkSession, sf: str) -> DataFrame:
    return U.slow(request_log(spark, sf), 90).select("request_id", "duration_ms")


def _streamed(spark: SparkSession, sf: str, shape, mode: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    run = scratch(spark, "stream")
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    streams.drain(shape(source), f"{run}/out", f"{run}/state", mode)
    out = spark.read.parquet(f"{run}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


@query("""WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2)
SELECT * FROM s WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def u15_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return _streamed(spark, sf, lambda s: streams.windowed(s, "ts", "event_type", "value"), "append").withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
s AS (SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM g GROUP BY user_id, k)
SELECT * FROM s WHERE ended <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def u15_stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, lambda s: streams.sessions(s, "ts", "user_id"), "append")


@query("SELECT event_id, event_type FROM events")
def u15_stream_once(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, lambda s: streams.once(s, "ts", "event_id").select("event_id", "event_type"), "append")


def _as_log(events: DataFrame) -> DataFrame:
    """The request log's columns over a stream of events."""
    kind, id_ = F.col("event_type"), F.col("event_id")
    return events.select("ts", kind.alias("op"), F.concat(F.lit("/api/"), kind).alias("route"), F.when(id_ % 3 == 0, "POST").otherwise("GET").alias("method"), F.col("value").alias("duration_ms"), ((kind != "error") & (id_ % 17 != 0)).alias("success"))


_LN = f"ln({streams.GROWTH}::DOUBLE)"


def _stream_sql(keys: str) -> str:
    """SQL of the closed days' summaries; a percentile is the middle of the bucket of the value at its index."""
    by = f", {keys}" if keys else ""
    step = lambda p: f"CAST(floor(ln(abs(v[1 + (len(v) - 1) * {p} // 100]) / {streams.TINY}) / {_LN}) AS INT)"
    at = lambda p: f"CASE WHEN v[1 + (len(v) - 1) * {p} // 100] < 0 THEN -1 ELSE 1 END * {streams.TINY} * pow({streams.GROWTH}::DOUBLE, {step(p)}) * {2 * streams.GROWTH / (1 + streams.GROWTH)!r}::DOUBLE"
    return f"""WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period{by}, count(*) AS requests, sum(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS errors, avg(duration_ms) AS mean, min(duration_ms) AS least, max(duration_ms) AS most, list_sort(list(duration_ms)) AS v FROM {LOG_SQL} GROUP BY 1{by})
SELECT period{by}, requests, errors, round(mean, 6) AS mean, least, most, round({at(50)}, 6) AS p50, round({at(95)}, 6) AS p95 FROM s WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def _stream_summary(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    out = _streamed(spark, sf, lambda s: streams.summaries(_as_log(s), "ts", keys, "duration_ms", "success"), "append")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95")})


@query(_stream_sql(""))
def u15_stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, errors, mean and percentiles of each closed day."""
    return _stream_summary(spark, sf, [])


@query(_stream_sql("op"))
def u15_stream_operations(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_summary(spark, sf, ["op"])


@query(_stream_sql("route, method"))
def u15_stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_summary(spark, sf, ["route", "method"])
