"""Usage and latency analytics over request logs (ts, op, duration_ms, success and more)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemara.functions.scalar import floor_quantile, redact


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(~F.col("success"), 1).otherwise(0)).alias("errors"), F.avg("duration_ms").alias("avg_ms"),
        F.percentile("duration_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("duration_ms", F.lit(0.95)).alias("p95_ms"),
    ]


def totals(log: DataFrame) -> DataFrame:
    """One row: requests, errors, mean, median and 95th percentile."""
    return log.agg(*_stats())


def summary_by(log: DataFrame, *keys: str, top: int | None = 50) -> DataFrame:
    """The totals per key, the busiest `top`; ties in order of the keys."""
    out = log.groupBy(*keys).agg(*_stats())
    return out.orderBy(F.desc("requests"), *keys).limit(top) if top else out


def per_period(log: DataFrame, unit: str = "day") -> DataFrame:
    """Requests and errors per day or hour."""
    return log.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(*_stats()[:2])


def runs(log: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Requests per run, runs without a name left out."""
    return log.filter(F.col(run_col).isNotNull() & (F.trim(run_col) != "")).groupBy(run_col).agg(F.count(F.lit(1)).alias("requests"))


def top_queries(log: DataFrame, query_col: str, run_col: str, top: int = 50) -> DataFrame:
    """Most frequent queries with the number of runs that asked them."""
    return log.filter(F.col(query_col) != "").groupBy(query_col).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct(run_col).alias("runs")).orderBy(F.desc("requests"), query_col).limit(top)


def recent(log: DataFrame, top: int = 50, key: str = "request_id") -> DataFrame:
    """The latest rows."""
    return log.orderBy(F.desc("ts"), F.desc(key)).limit(top)


def page(log: DataFrame, run=None, run_prefix=None, route_has=None, query_has=None, method=None, status=None, success=None, since=None, until=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, latest first, under the filters that are given."""
    tests = [
        (run, lambda v: F.col("run_id") == v), (run_prefix, lambda v: F.startswith("run_id", F.lit(v))), (route_has, lambda v: F.contains(F.lower("route"), F.lit(v.lower()))),
        (query_has, lambda v: F.contains(F.lower("query_text"), F.lit(v.lower()))), (method, lambda v: F.upper("method") == v.upper()), (status, lambda v: F.col("status_code") == v),
        (success, lambda v: F.col("success") == v), (since, lambda v: F.col("ts") >= F.lit(v).cast("timestamp")), (until, lambda v: F.col("ts") <= F.lit(v).cast("timestamp")),
    ]
    for value, test in tests:
        if value is not None:
            log = log.filter(test(value))
    return log.orderBy(F.desc("ts"), F.desc("request_id")).offset(offset).limit(limit)


def latest_of(log: DataFrame, key: str = "request_id") -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", *(c for c in rest if c not in ("ts", "props")))).alias("_r")).select(key, "_r.*")


def latency(log: DataFrame, op: str = "op", last: int | None = None) -> DataFrame:
    """Per operation: count, total, mean, extremes and floor-index percentiles of its durations, of the last `last` only if given."""
    if last:
        newest = Window.partitionBy(op).orderBy(F.desc("ts"), F.desc("request_id"))
        log = log.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    d = F.col("duration_ms")
    # Ranks are counted per distinct duration, so that no operation's values are gathered in one row.
    per = log.groupBy(op, d.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    run = per.withColumn("upto", F.sum("c").over(Window.partitionBy(op).orderBy("d"))).withColumn("n", F.sum("c").over(Window.partitionBy(op)))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("d"))).alias(f"p{p}")
    return run.groupBy(op).agg(F.sum("c").alias("n"), F.sum(F.col("d") * F.col("c")).alias("total"), (F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"), at(50), at(95), at(99))


def latency_of_window(log: DataFrame, op: str = "op", last: int = 100) -> DataFrame:
    """Median of the last `last` durations per operation, from a bounded array."""
    newest = Window.partitionBy(op).orderBy(F.desc("ts"), F.desc("request_id"))
    kept = log.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    values = F.array_sort(F.collect_list("duration_ms"))
    return kept.groupBy(op).agg(values.alias("_v")).select(op, F.size("_v").cast("long").alias("n"), floor_quantile(F.col("_v"), 50).alias("p50"), floor_quantile(F.col("_v"), 95).alias("p95"))


def snapshot(log: DataFrame) -> DataFrame:
    """Per operation: requests, error rate, requests a minute over the log's span."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("requests"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"), (F.count(F.lit(1)) / F.greatest(span, F.lit(1.0))).alias("per_minute"))


def exposition(snap: DataFrame, prefix: str = "engine") -> DataFrame:
    """The snapshot as lines of the Prometheus text format."""
    line = lambda name, value: F.concat(F.lit(f"{prefix}_{name}{{op=\""), F.col("op"), F.lit('"} '), value.cast("string"))
    return snap.select(F.explode(F.array(line("requests_total", F.col("requests")), line("error_rate", F.bround(F.col("error_rate"), 4)))).alias("line"))


def slow(log: DataFrame, over_ms: float) -> DataFrame:
    return log.filter(F.col("duration_ms") > over_ms)


def log_rows(log: DataFrame, query_chars: int = 5000, response_chars: int = 100_000) -> DataFrame:
    """Rows as they are appended: long texts cut, secret parameters starred out."""
    return log.withColumns({"query_text": F.substring("query_text", 1, query_chars), "response": F.substring("response", 1, response_chars), "params": redact(F.col("params"))})


def export(log: DataFrame, columns: list[str], json_columns: dict[str, str] | None = None, rows: int = 200_000) -> DataFrame:
    """Chosen columns, JSON texts parsed by their schema; `rows` at most, latest first."""
    parsed = {c: F.from_json(c, s) for c, s in (json_columns or {}).items()}
    return log.orderBy(F.desc("ts"), F.desc("request_id")).limit(rows).withColumns(parsed).select(*columns)
