"""Folders that the driver and all executors share, for intermediate and exported files."""

from __future__ import annotations

import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it was counted and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Rows that a task is dealt.
ROWS_PER_TASK = 250_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below the warehouse on a cluster and the temporary folder in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = f"{tempfile.gettempdir()}/skemara-{spark.sparkContext.applicationId}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob in any file system that Spark reads, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(f.getPath().toString() for f in found or [])


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to a scratch table and read back."""
    path = scratch(df.sparkSession, label) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as its rows need, about `rows` each; the number is explicit, so tasks of little data but much work are not merged."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(parts, *keys)


def apart(spark: SparkSession, count: int) -> list[int]:
    """`count` different numbers which, as keys of as many partitions, each come to one of their own.

    A hash of 0, 1, 2, ... would put several into one task, which then takes a
    multiple of the time of the others. Whatever hash deals them, they differ.
    """
    task = F.pmod(F.hash("id"), F.lit(count)).alias("task")
    found = spark.range(64 * count).select(F.col("id").cast("int").alias("id")).groupBy(task).agg(F.min("id").alias("id"))
    numbers = {r.task: r.id for r in found.collect()}
    return [numbers.get(i, 64 * count + i) for i in range(count)]


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda n, x: n + _width(x, kind.elementType)), F.lit(0)) + 16
        return F.coalesce(F.array_size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a count of rows and bytes shows that `df` can be broadcast."""
    width = reduce(lambda a, b: a + b, (_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= rows and (total or 0) <= size


def small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if is_small says so, else left to a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def meet_blocks(rows: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """`rows` joined with each of `count` blocks of queries (column `block`, 0..count-1).

    Blocks that are small together are broadcast, so the rows stay where they
    are; else each block is copied to as many parts as there are shuffle
    partitions, and rows are dealt by (block, part), so that no block is one
    task's.
    """
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1)))) if count > 1 else rows.withColumn("block", F.lit(0))
    if is_small(blocks):
        return spread.join(F.broadcast(blocks), "block")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.pmod(F.xxhash64(*(f"`{c}`" for c, t in rows.dtypes if not t.startswith("map"))), F.lit(parts)).cast("int")
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.withColumn("part", key).join(copies, ["block", "part"]).drop("part")
