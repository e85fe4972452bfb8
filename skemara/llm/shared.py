"""Helpers shared by the operators: scratch tables, bounded Arrow batches, running sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skemara.sources.scratch import is_small, scratch, small, stored

#: Bytes of an Arrow batch, but for a single row that is longer.
BATCH_BYTES = 16 << 20
#: Words that a worker keeps encoded, and the longest of them.
CACHE, CACHED_CHARS = 1_500_000, 64


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share (see skemara.sources.scratch)."""
    return scratch(spark, label)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to a scratch Parquet table and read it back: cuts the lineage,
    so that a lost executor costs a reread and nothing is computed twice."""
    return stored(df, label)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hold Arrow batches to `rows` rows and BATCH_BYTES bytes, so that very long texts stay within a worker's memory.
    What runs inside must be executed inside (see stage_table)."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """`body(v)` with `v` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shield(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns named like one of `made` (in any case) renamed, and how to rename them back."""
    clash = {c: f"_own_{c}" for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def checked_broadcast(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if a count of its rows and bytes shows that it is small; else left to a shuffle join."""
    return small(df)


#: A key is hot if it has at least this many rows and this share of all rows; so at most 1/HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 1000, 1 / 1024


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str = "_n") -> DataFrame:
    """`left` joined with `right`, which has a row per key and in `count` how many rows `left` has of it, about.

    The rows of hot keys (at most 1/HOT_SHARE keys) meet a broadcast, if its
    bytes are few, so that none of them is one task's; the others are shuffled.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(HOT_ROWS, total * HOT_SHARE)
    few = stage_table(right.filter(hot), "hot-keys")
    rest = right.filter(~hot).drop(count)
    if not few.limit(1).count():
        return left.join(rest, key)
    if not is_small(few):
        return left.join(right.drop(count), key)
    cold = left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return cold.unionByName(left.join(F.broadcast(few.drop(count)), key))


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str], label: str) -> DataFrame:
    """Add, for each name and long column in `values`, the sum over the rows before this one.

    Rows are ordered by `group` then `order` in one range partitioning, so that
    no group has to fit in a task: each partition keeps local sums (numpy
    cumulative sums, restarted where the group changes), and the groups that
    cross a partition's edge (two per partition at most) get what the
    partitions before hold of them. Ties in `order` are told apart by arrival,
    so `order` should identify a row; null amounts count as 0. The result is a
    scratch table.
    """
    spark = df.sparkSession
    flat = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    part, edge, gkey = "_part", "_edge", "_group"
    keyed = df.withColumn(gkey, F.to_json(F.struct(*group)) if group else F.lit(""))
    ranged = keyed.repartitionByRange(*flat).sortWithinPartitions(*flat)
    shape = T.StructType([*keyed.schema.fields, *(T.StructField(v, T.LongType()) for v in values), T.StructField(part, T.IntegerType()), T.StructField(edge, T.BooleanType())])
    names, sources = list(values), list(values.values())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        first, current, carried = None, None, [0] * len(sources)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(gkey)
            head = keys[0].as_py()
            first = head if first is None else first
            fresh = np.zeros(n, bool)
            fresh[0] = head != current
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            # The row at which each row's group begins in this batch; -1 where it goes on from the batch before.
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            before = []
            for k, source in enumerate(sources):
                amount = pc.fill_null(batch.column(source), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(amount)])
                sums = upto[:-1] - np.where(start < 0, -carried[k], upto[np.maximum(start, 0)])
                before.append(pa.array(sums, pa.int64()))
                carried[k] = int(sums[-1] + amount[-1])
            current = keys[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(n, number, np.int32)), pc.equal(keys, first)], [*batch.schema.names, *names, part, edge])

    held = stage_table(ranged.mapInArrow(local, shape), label)
    # A group that came over an edge is the first of its partition: as many at most as there are partitions.
    crossing = held.filter(edge).select(gkey).distinct()
    totals = held.join(checked_broadcast(crossing), gkey, "left_semi").groupBy(gkey, part).agg(*(F.sum(F.col(s).cast("long")).alias(f"_{n}") for n, s in values.items()))
    bases, seen, last = {}, [0] * len(names), None
    for row in sorted(totals.collect(), key=lambda r: (r[gkey], r[part])):
        seen = seen if row[gkey] == last else [0] * len(names)
        bases[row[part], row[gkey]] = tuple(seen)
        seen, last = [s + (row[f"_{n}"] or 0) for s, n in zip(seen, names, strict=True)], row[gkey]
    bases = {k: v for k, v in bases.items() if any(v)}
    if bases:
        rows = [(p, g, *s) for (p, g), s in bases.items()]
        side = spark.createDataFrame(rows, T.StructType([T.StructField(part, T.IntegerType()), T.StructField(gkey, T.StringType()), *(T.StructField(f"_{n}", T.LongType()) for n in names)]))
        held = held.join(checked_broadcast(side), [part, gkey], "left")
        for n in names:
            held = held.withColumn(n, F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)))
    return held.select(*df.columns, *names)


def look_up(known: dict[str, bytes], split: list[list[str]], learn) -> list[bytes]:
    """The ids of each list of words, one word's after the other's; `learn` makes what `known` lacks.

    Words are counted out first, so the large table is asked once for each
    distinct one and the rest meets a small table. `known` is emptied when it is full.
    """
    words = set().union(*split)
    here = dict(zip(words, map(known.get, words), strict=True))
    new = learn([w for w, ids in here.items() if ids is None])
    here.update(new)
    if len(known) + len(new) > CACHE:
        known.clear()
    if new:
        known.update(new if max(map(len, new)) <= CACHED_CHARS else {w: ids for w, ids in new.items() if len(w) <= CACHED_CHARS})
    return [b"".join(map(here.__getitem__, row)) for row in split]
