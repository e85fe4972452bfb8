"""Length buckets against plain dynamic programming over each length."""

import collections

import numpy as np
from pyspark.sql import functions as F

from skemara.llm import packing


def least_padding(lengths, buckets):
    hist = sorted(collections.Counter(lengths).items())
    cost = [0] + [sum((hist[j - 1][0] - x) * n for x, n in hist[:j]) for j in range(1, len(hist) + 1)]
    for _ in range(1, buckets):
        cost = [0] + [min(cost[i] + sum((hist[j - 1][0] - x) * n for x, n in hist[i:j]) for i in range(j)) for j in range(1, len(hist) + 1)]
    return cost[-1]


def test_one_long_text_leaves_the_buckets_optimal(spark):
    rng = np.random.default_rng(7)
    lengths = [*(int(x) for x in rng.integers(2, 60, 150)), 1_000_000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    for buckets in (1, 3, 5):
        got = packing.pack(rows, rows["n"], buckets=buckets).collect()
        assert len({r.bucket for r in got}) <= buckets
        assert sum(r.bucket_len - r.n_tokens for r in got) == least_padding(lengths, buckets)


def test_bounds_of_many_lengths():
    rng = np.random.default_rng(8)
    for n, k in ((1, 3), (2, 2), (90, 4), (90, 12)):
        lengths = np.unique(rng.integers(1, 10**6, n))
        counts = rng.integers(1, 50, len(lengths))
        bounds = packing.best_bounds(lengths.tolist(), counts.tolist(), (lengths * counts).tolist(), k)
        flat = np.repeat(lengths, counts).tolist()
        assert len(bounds) <= k and sum(min(b for b in bounds if b >= x) - x for x in flat) == least_padding(flat, k)


def test_rows_alike_fill_slots_alike(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (1, 4), (2, 4)], "doc_id long, n long")
    got = packing.pack(rows.repartition(3), rows["n"], buckets=1, budget=10).collect()
    assert sorted((r.batch, r.slot, r.doc_id, r.n_tokens) for r in got) == [(0, 0, None, 5), (0, 1, 1, 4), (1, 0, 1, 5), (1, 1, 1, 5), (2, 0, 2, 4)]


def test_running_sums_cross_partitions(spark):
    from skemara.llm.shared import running_sums

    rng = np.random.default_rng(1)
    data = [(None if g == 0 else int(g), i, None if i % 7 == 0 else int(rng.integers(0, 9))) for i, g in enumerate(rng.integers(0, 4, 3000))]
    df = spark.createDataFrame(data, "g long, i long, n long").withColumn("one", F.lit(1).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = running_sums(df.repartition(8), ["g"], ["i"], {"before": "n", "place": "one"}, "sums").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = collections.defaultdict(lambda: [0, 0])
    want = set()
    for g, i, n in sorted(data, key=lambda r: r[1]):
        want.add((g, i, *sums[g]))
        sums[g] = [sums[g][0] + (n or 0), sums[g][1] + 1]
    assert {(r.g, r.i, r.before, r.place) for r in got} == want and len(got) == len(data)
