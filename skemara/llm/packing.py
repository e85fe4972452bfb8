"""Length buckets by dynamic programming over the corpus's histogram, and token-budget batches within each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import running_sums, stage_table

BUCKETS, BUDGET = 12, 1 << 16


def word_length(text: Column) -> Column:
    """Words of a text and an end mark."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1).cast("long")


def _cut_all(cost: np.ndarray, length: np.ndarray, many: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: for each j the least cost[i] + padding of i..j-1 in one bucket over i < j, and the first such i.

    The first best i never falls as j grows. So the middle j of each open
    stretch is looked at between the cuts around it, all stretches of a level
    at once: n log n steps in all.
    """
    n = len(length)
    new, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    low, high, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(low):
        j = (low + high) // 2
        width = np.minimum(most, j - 1) - least + 1
        start = np.concatenate([[0], np.cumsum(width)])
        i = np.arange(start[-1]) - np.repeat(start[:-1] - least, width)
        at = np.repeat(j, width)
        plans = cost[i] + length[at - 1] * (many[at] - many[i]) - (sums[at] - sums[i])
        new[j] = np.minimum.reduceat(plans, start[:-1])
        hit = np.flatnonzero(plans == np.repeat(new[j], width))
        cut[j] = i[hit[np.searchsorted(hit, start[:-1])]]
        low, high, least, most = (np.concatenate(x) for x in ((low, j + 1), (j - 1, high), (least, cut[j]), (cut[j], most)))
        going = low <= high
        low, high, least, most = low[going], high[going], least[going], most[going]
    return new, cut


def best_bounds(lengths: list[int], counts: list[int], totals: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of up to `buckets` buckets with the least padding; `lengths` ascend. Of equal plans that with the fewest buckets."""
    n = len(lengths)
    if not n:
        return []
    length = np.array(lengths, np.int64)
    many, sums = (np.concatenate([[0], np.cumsum(np.array(x, np.int64))]) for x in (counts, totals))
    # cost[j]: least padding of the first j lengths in k buckets; a bucket of lengths i..j-1 pads to length[j-1].
    cost = np.concatenate([[0], length * many[1:] - sums[1:]])
    cuts, best = [], [cost[n]]
    for _ in range(1, min(buckets, n)):
        cost, cut = _cut_all(cost, length, many, sums)
        cuts.append(cut)
        best.append(cost[n])
    bounds, j = [], n
    for cut in reversed(cuts[: int(np.argmin(best))]):
        bounds.append(lengths[j - 1])
        j = cut[j]
        if j == 0:
            break
    if j:
        bounds.append(lengths[j - 1])
    return sorted(set(bounds))


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id, n_tokens, bucket (from 0), bucket_len, batch and slot of each row.

    A batch of a bucket holds as many rows as `budget` has room for at the
    bucket's length, one at least, so a text longer than the budget is a batch
    of its own. Rows fill batches in order of id and length within their
    bucket, null ids first; rows equal in both are alike in all that is
    returned. Null and empty texts have the length 1 (the end mark); repeated
    rows stay repeated; other columns are ignored; an empty table gives an
    empty result. Lengths are taken once and stored. The histogram, one row per
    length, is the only thing that the driver sees.
    """
    length = word_length(F.col("text")) if length is None else length
    rows = stage_table(docs.select(id_col, length.cast("long").alias("n_tokens")), "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (histogram.column(c).to_numpy() for c in ("n_tokens", "n"))
    if not len(lengths):
        return rows.select(id_col, "n_tokens", *(F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_len", "batch", "slot"))).limit(0)
    bounds = best_bounds(lengths, counts, lengths * counts, buckets)
    ends = F.array(*(F.lit(int(b)).cast("long") for b in bounds))
    placed = rows.withColumn("bucket", F.size(F.filter(ends, lambda b: b < F.col("n_tokens"))).cast("long"))
    placed = placed.withColumns({"bucket_len": F.element_at(ends, (F.col("bucket") + 1).cast("int")), "one": F.lit(1).cast("long")})
    placed = running_sums(placed, ["bucket"], [id_col, "n_tokens"], {"before": "one"}, "packed")
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)} div bucket_len"))
    return placed.select(id_col, "n_tokens", "bucket", "bucket_len", F.expr(f"before div greatest(1L, {int(budget)} div bucket_len)").alias("batch"), F.pmod("before", room).alias("slot"))
