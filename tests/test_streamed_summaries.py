"""Summaries of a stream against exact ones: stated error, late rows, odd values."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from skemara.sources.scratch import scratch
from skemara.streaming import usage

DAY = datetime.datetime(2024, 1, 1)
LOG = "ts timestamp, op string, ms double, ok boolean"


def test_buckets_are_within_the_error(spark):
    r = random.Random(1)
    values = [r.choice([-1, 1]) * math.exp(r.uniform(-18, 25)) for _ in range(3000)] + [0.0, 1e-12, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", usage.middle(usage.bucket(F.col("v"))).alias("m"), usage.bucket(F.col("v")).alias("b")).collect()
    most = (usage.GROWTH - 1) / (usage.GROWTH + 1) + 1e-9
    assert all(abs(x["m"] - x["v"]) <= most * abs(x["v"]) or abs(x["v"]) < usage.TINY and x["m"] == 0 for x in rows)
    assert [x["b"] for x in sorted(rows, key=lambda x: x["v"])] == sorted(x["b"] for x in rows)


def test_closed_windows_with_late_rows(spark):
    r = random.Random(2)
    rows = [(DAY + datetime.timedelta(hours=r.uniform(0, 72)), r.choice("ab"), None if k % 50 == 0 else 0.0 if k % 41 == 0 else r.expovariate(0.01), r.random() < 0.8) for k in range(3000)]
    rows.sort()
    # Some rows come a few minutes after their time; the last one moves the watermark past the third day.
    order = sorted(rows, key=lambda x: x[0] + datetime.timedelta(minutes=r.uniform(0, 8))) + [(DAY + datetime.timedelta(hours=90), "a", 1.0, True)]
    run = scratch(spark, "summaries")
    for k in range(6):
        spark.createDataFrame(order[k * 501 : (k + 1) * 501], LOG).coalesce(1).write.parquet(f"{run}/in/{k}")
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{run}/in/*")
    usage.drain(usage.summaries(source, "ts", ["op"], "ms", "ok"), f"{run}/out", f"{run}/state")
    got = {(x["period"], x["op"]): x for x in spark.read.parquet(f"{run}/out").collect()}
    want = {}
    for ts, op, ms, ok in rows:
        want.setdefault((ts.replace(hour=0, minute=0, second=0, microsecond=0), op), []).append((ms, ok))
    assert set(got) == set(want) and len(got) == 6
    for at, some in want.items():
        x, values = got[at], sorted(v for v, _ in some if v is not None)
        assert (x["requests"], x["errors"], x["least"], x["most"]) == (len(some), sum(not ok for _, ok in some), values[0], values[-1])
        assert x["mean"] == pytest.approx(sum(values) / len(values))
        for p in (50, 95):
            assert x[f"p{p}"] == pytest.approx(values[(len(values) - 1) * p // 100], rel=0.0101)


def test_over_all_rows_of_a_window(spark):
    run = scratch(spark, "summaries")
    spark.createDataFrame([(DAY, "a", None, False), (DAY + datetime.timedelta(days=2), "a", 1.0, True)], LOG).write.parquet(f"{run}/in")
    usage.drain(usage.summaries(spark.readStream.schema(LOG).parquet(f"{run}/in"), "ts", [], "ms", "ok"), f"{run}/out", f"{run}/state")
    assert [(x["requests"], x["errors"], x["mean"], x["p50"]) for x in spark.read.parquet(f"{run}/out").collect()] == [(1, 1, None, None)]
