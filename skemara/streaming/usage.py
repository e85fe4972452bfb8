"""The usage summaries as streams over a growing log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files that arrive under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Ratio of a histogram bucket's bounds; a percentile is within (GROWTH - 1) / (GROWTH + 1) of a value of its rank, about one in a hundred. Values below TINY count as 0.
GROWTH, TINY = 1.02, 1e-9


def bucket(value: Column) -> Column:
    """Number of a value's bucket: 0 for next to nothing, then by the logarithm of its size, negative values by negative numbers."""
    size = F.abs(value)
    step = F.floor(F.log(size / TINY) / math.log(GROWTH)).cast("int") + 1
    return F.when(value.isNull(), F.lit(None)).when(size < TINY, 0).when(value < 0, -step).otherwise(step)


def middle(number: Column) -> Column:
    """The value that stands for a bucket: no value of it is further off than the ratio above."""
    size = F.lit(TINY) * F.pow(F.lit(GROWTH), F.abs(number) - 1) * (2 * GROWTH / (1 + GROWTH))
    return F.when(number == 0, 0.0).when(number < 0, -size).otherwise(size)


def histogram_percentile(buckets: Column, percent: int) -> Column:
    """Of an ascending array of (number, n): the middle of the bucket that has the value at index floor((n - 1) * percent / 100)."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    spot = F.floor((total - 1) * percent / 100)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(buckets, start, lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["at"].isNull() & (a["upto"] + x["n"] > spot), x["number"]).otherwise(a["at"]).alias("at")))
    return middle(found["at"])


def summaries(log: DataFrame, ts: str, keys: list[str], value: str, success: str, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Per window and keys (none: over all): requests, errors, mean, least, most, p50 and p95 of `value`; a window is given out when the watermark has passed it.

    The state is a histogram: a row per window, keys and bucket with counts and
    sums, which rows that come late (within the watermark) are merged into; how
    many buckets there are follows from the range of the values, not from their
    number. A second aggregate folds a closed window's buckets. Null values
    count as requests and errors only.
    """
    v = F.col(value).cast("double")
    marked = log.withWatermark(ts, late).withColumn("number", bucket(v))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(success), 0).otherwise(1)).alias("errors"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most")]
    per = marked.groupBy(F.window(ts, width), *keys, "number").agg(*sums)
    parts = F.array_sort(F.filter(F.collect_list(F.struct("number", "n")), lambda x: x["number"].isNotNull()))
    folded = per.groupBy(F.window(F.col("window"), width), *keys).agg(F.sum("n").alias("requests"), F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), parts.alias("_b"))
    n = F.aggregate("_b", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return folded.select(F.col("window.start").alias("period"), *keys, "requests", "errors", F.when(n > 0, F.col("total") / n).alias("mean"), "least", "most", *(histogram_percentile(F.col("_b"), p).alias(f"p{p}") for p in (50, 95)))


def windowed(log: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and means per window and key; rows later than the watermark are dropped."""
    by = log.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("period"), key, "n", "total", "most")


def sessions(log: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: rows no further apart than `gap`."""
    by = log.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user)
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), user, "n")


def once(log: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Rows with repeated keys dropped, within the watermark."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now to Parquet and stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return query
