"""Nearest vectors by matrix products give the same rows as every pair's own score."""

import functools
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skemara import registry
from skemara.functions.scalar import cosine
from skemara.operators import metrics, retrieval
from skemara.sources import scratch


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, measure):
    rng = random.Random(7)
    rows = [[rng.choice((-1.0, 0.0, 0.5, rng.random())) for _ in range(4)] for _ in range(300)]
    rows += [[1.0, 0.0, 0.0, 0.0]] * 60 + [[0.0] * 4] * 5 + [None, [1.0, 2.0], [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 1.0], [math.inf, 0.0, 0.0, 1.0], [1e-200, 0.0, 0.0, 0.0], [1e200] * 4]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    vectors = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 7 = 0 OR embedding IS NULL OR size(embedding) < 4").selectExpr("vec_id AS query_id", "embedding AS vector")
    want = retrieval.top(retrieval._scored(vectors, queries, queries.count(), measure, "vec_id"), 6, "vec_id")
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 512)
    monkeypatch.setattr(retrieval, "PART_BYTES", 1024)
    got = retrieval.nearest(vectors, queries, 6, measure)
    assert sorted(map(str, got.select("query_id", "vec_id", "score", "rank").collect())) == sorted(map(str, want.select("query_id", "vec_id", "score", "rank").collect()))


def test_a_part_sends_on_few_rows():
    """Of copies and of ties the first k only, whatever there are of them."""
    a = np.eye(8)
    b = np.repeat(np.eye(8), 1000, axis=0)
    i, j, score = retrieval.nearest_rows(a, b, 3, "l2")
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, 1000 * x + y) for x in range(8) for y in range(3)] and not score.any()
    i, j, score = retrieval.nearest_rows(np.zeros((1, 5000)), np.eye(5000), 3, "l2")
    assert j.tolist() == [0, 1, 2]


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_products_lose_no_row_of_any_size(measure):
    """Rows far from the origin, close to each other, copied, or of sizes that single precision does not hold."""
    rng = np.random.default_rng(3)
    near = np.repeat(rng.normal(size=(40, 6)), 20, axis=0) + rng.normal(size=(800, 6)) * 1e-6
    sets = [rng.normal(size=(700, 6)), near, near * 1e-3 + 1e4, rng.normal(size=(700, 6)) * 10.0 ** rng.integers(-30, 30, (700, 1)), np.vstack([near, near[:50], np.zeros((30, 6)), [[1e34] * 6]])]
    for b in sets:
        a = b[:: max(1, len(b) // 90)]
        i, j, score = retrieval.nearest_rows(a, b, 7, measure)
        best = {}
        for x, y, z in zip(i.tolist(), j.tolist(), score.tolist(), strict=True):
            best.setdefault(x, []).append((-round(z, 9), y))
        for x, row in enumerate(a.tolist()):
            dot = lambda u, v: functools.reduce(lambda s, p: s + p[0] * p[1], zip(u, v, strict=True), 0.0)
            if measure == "l2":
                each = [-functools.reduce(lambda s, p: s + (p[0] - p[1]) * (p[0] - p[1]), zip(row, other, strict=True), 0.0) for other in b.tolist()]
            else:
                each = [dot(row, other) / size if (size := math.sqrt(dot(row, row) * dot(other, other))) > 0 else 0.0 for other in b.tolist()]
            assert sorted(best[x])[:7] == sorted((-round(z, 9), y) for y, z in enumerate(each))[:7]


def test_one_far_row_costs_no_memory():
    """A vector of another size widens no other pair's bounds, so few pairs are scored one by one."""
    rng = np.random.default_rng(4)
    b = rng.normal(size=(6000, 16))
    b[5] *= 1e7
    tracemalloc.start()
    i, j, _ = retrieval.nearest_rows(b[::4], b, 3, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) < 4 * len(b[::4]) and peak < 40 << 20


def test_parts_and_blocks_are_balanced():
    """A twentieth asks for 20: no query sends on its best from every task's own part; sizes stay bounded."""
    assert retrieval._tiling(205_128, 10_257, 64, 20, 24) == (3, 8)
    for n, m, d, k, tasks in ((0, 0, 1, 5, 12), (10, 1, 64, 5, 12), (7, 9000, 3, 50, 36), (10**7, 5 * 10**5, 64, 20, 36), (10**6, 1, 1536, 10, 8)):
        blocks, parts = retrieval._tiling(n, m, d, k, tasks)
        assert blocks * parts >= tasks and m * d * 8 <= blocks * retrieval.QUERY_BYTES and n * d * 8 <= parts * retrieval.PART_BYTES


def test_best_cosines_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i if i < 190 else 7, rng.choice("abc"), [rng.choice((0.0, 1.0, rng.random())) for _ in range(3)]) for i in range(200)]
    rows += [(300, "alone", [1.0, 0.0, 0.0]), (301, None, [1.0, 0.0, 0.0]), (302, "a", None), (303, "b", [1.0, 2.0]), (304, "c", [math.nan, 1.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    asked = e.filter("id % 3 = 0 OR id > 299 OR id = 7")
    score = F.when(F.col("a.id") != F.col("b.id"), cosine(F.col("a.embedding"), F.col("b.embedding")))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 512)
    got = metrics.best_cosines(asked, e, "label")
    # A row that asks for several vectors (id 7 with repeats) has one best in both.
    assert sorted(map(str, got.collect())) == sorted(map(str, metrics.best_matches(asked, e, "label", score).collect()))


def test_containment_is_that_of_each_pair(spark, monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "Alphabet", "beta_1", "tab", "12", "123", "bet", "ph"]
    docs = [(rng.randrange(150), " ".join(rng.choices(words, k=rng.randrange(5)))) for _ in range(200)] + [(500, None), (None, "alphabet 123"), (501, "alpha-12\u0130x")]
    asked = [(i, "the " + " ".join(rng.choices([*words[:4], "a", "1", "et", "pha", "i"], k=3))) for i in range(40)]
    want = {}
    for q, text in asked:
        terms = {t for t in text.lower().split()} - set(retrieval.STOP)
        scores = {}
        for d, x in docs:
            n = sum(t in (x or "").lower() for t in terms)
            if n:
                scores[d] = scores.get(d, 0) + n
        for place, (d, n) in enumerate(sorted(scores.items(), key=lambda r: (-r[1], -1 if r[0] is None else r[0]))[:4]):
            want[q, place + 1] = d, float(n)
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, text string")
    for frequent in (1_000_000, 100, 0):
        monkeypatch.setattr(retrieval, "FREQUENT", frequent)
        assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.containment(*frames, 4).collect()} == want


def test_dates_of_repeated_keys_and_queries(spark):
    docs = spark.createDataFrame([(1, "1994-03-05"), (1, "1994-03-06"), (2, "1994-03-05"), (2, "1994-03-05"), (3, "1995-03-01"), (4, None), (None, "1995-03-01")], "k int, day string").selectExpr("k", "CAST(day AS date) AS day")
    dates = spark.createDataFrame([(1, 1994, 3, 5), (2, 1994, 3, None), (3, None, 3, None), (3, 1994, 3, 6), (4, None, 3, 5), (5, 1994, None, None), (2, 1994, 3, None)], "query_id int, year int, month int, day int")
    got = sorted(((r.query_id, r.k, r.score) for r in retrieval.by_date(docs, dates, "k", "day").collect()), key=str)
    assert got == sorted([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 2.0), (2, 2, 2.0), (3, 1, 3.0), (3, 2, 1.0), (3, 3, 1.0), (3, None, 1.0)], key=str)


def test_dates_are_met_without_a_shuffle_of_pairs(spark, capsys):
    docs = spark.range(100).selectExpr("id AS k", "DATE'1994-01-01' AS day")
    dates = spark.createDataFrame([(i, None, 1, None) for i in range(9)], "query_id int, year int, month int, day int")
    retrieval.by_date(docs, dates, "k", "day").explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate explode(_l") < plan.index("Exchange")


def test_dates_of_many_parts_and_lists(spark, monkeypatch):
    """Each part of a date's keys meets each list of its queries, those without an id too; a task writes a bounded number of pairs."""
    rng = random.Random(7)
    docs = [(None if i == 9 else i, f"199{rng.randrange(2)}-0{rng.randrange(1, 4)}-0{rng.randrange(1, 3)}") for i in range(150)] + [(3, "1990-01-01"), (3, "1991-02-02"), (200, None)]
    dates = [(None if i == 5 else i, rng.choice((None, 1990, 1991)), rng.randrange(1, 5), rng.choice((None, None, 1))) for i in range(60)] + [(7, 1990, 1, None), (7, None, 1, None)]
    want = {}
    for k, day in docs:
        for q, y, m, d in dates:
            score = 3.0 if y and d else 2.0 if y else None if d else 1.0
            if day and score and int(day[5:7]) == m and y in (None, int(day[:4])) and d in (None, int(day[8:])):
                want[q, k] = max(score, want.get((q, k), 0))
    frames = spark.createDataFrame(docs, "k int, day string").selectExpr("k", "CAST(day AS date) AS day"), spark.createDataFrame(dates, "query_id int, year int, month int, day int")
    for keys, queries, block, pairs in ((2048, 512, 65_536, 10**9), (8, 3, 5, 50)):
        for name, n in (("DATE_KEYS", keys), ("DATE_QUERIES", queries), ("DATE_BLOCK", block), ("PAIRS_PER_TASK", pairs)):
            monkeypatch.setattr(retrieval, name, n)
        got = retrieval.by_date(*frames, "k", "day")
        assert sorted(((r.query_id, r.k, r.score) for r in got.collect()), key=str) == sorted(((q, k, s) for (q, k), s in want.items()), key=str)
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < len(want) / 4


def test_dated_keys_repeat_the_same_list(spark):
    """Keys of one month that follow each other in a task have the same queries in the same order, so files hold the pairs in little."""
    docs = spark.range(3000).selectExpr("id AS k", "make_date(1994, 1 + CAST(id % 12 AS int), 1) AS day")
    dates = spark.range(7200).selectExpr("id AS query_id", "CAST(NULL AS int) AS year", "1 + CAST(id % 12 AS int) AS month", "CAST(NULL AS int) AS day")
    tasks = {}
    for r in retrieval.by_date(docs, dates, "k", "day").withColumn("task", F.spark_partition_id()).select("task", "k", "query_id").collect():
        tasks.setdefault(r.task, []).append((r.k, r.query_id))
    lists = [[tuple(q for _, q in pairs) for _, pairs in itertools.groupby(rows, lambda r: r[0])] for rows in tasks.values()]
    assert sum(len(x) for keys in lists for x in keys) == 3000 * 600
    assert sum(a != b for keys in lists for a, b in itertools.pairwise(keys)) < 24
    assert {len(x) for keys in lists for x in keys} == {512, 88}


def test_bm25_deals_documents_by_their_postings(spark, monkeypatch):
    """Rows of one key and length count as one document; many postings are many tasks'."""
    docs = spark.createDataFrame([(1, "red red blue"), (1, "red blue blue"), (2, "red"), (3, ""), (4, None), (5, "green blue sky")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "the red sky"), (2, "blue")], "query_id int, text string")
    monkeypatch.setattr(retrieval, "POSTINGS_PER_TASK", 1)
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, asked).collect()}
    weight = lambda n, tf, dl: math.log((6 - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (10 / 6)))
    assert got == pytest.approx({(1, 1): weight(2, 3, 3), (1, 2): weight(2, 1, 1), (1, 5): weight(1, 1, 3), (2, 1): weight(2, 3, 3), (2, 5): weight(2, 1, 3)})


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_nearest_of_single_precision(spark, measure, capsys):
    """Numbers of any size that single precision holds, and what is none, rank as each pair's own score; no function is called for each number of a usual vector."""
    rng = random.Random(5)
    rows = [[rng.choice((-1.0, 0.0, rng.random())) * 10.0 ** rng.choice((0, 0, 0, -44, 30)) for _ in range(4)] for _ in range(150)]
    rows += [None, [], [1.0, 2.0], [1.0, None, 0.0, 0.0], [None] * 4, [math.nan, 0.0, 0.0, 1.0], [-math.inf, 0.0, 0.0, 1.0], [3e38, 1.0, 1.0, 1.0], [-3e38, 0.0, 0.0, 0.0], [1e-45] * 4]
    vectors = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 5 = 0 OR vec_id >= 150").selectExpr("vec_id AS query_id", "embedding AS vector")
    want = retrieval.top(retrieval._scored(vectors, queries, queries.count(), measure, "vec_id"), 6, "vec_id").select("query_id", "vec_id", "score", "rank")
    got = retrieval.nearest(vectors, queries, 6, measure)
    assert sorted(map(str, got.select("query_id", "vec_id", "score", "rank").collect())) == sorted(map(str, want.collect()))
    retrieval.pairs(vectors.filter("vec_id < 150"), queries.filter("query_id < 150"), 6, measure, "vec_id").explain()
    assert "forall" not in capsys.readouterr().out


def test_each_pair_of_block_and_part_has_its_task(spark, monkeypatch):
    """Two in one task, as hashes of their numbers would deal some, take twice the time of the others."""
    rng = random.Random(6)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(800)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 2048)
    monkeypatch.setattr(retrieval, "PART_BYTES", 4096)
    blocks, parts = retrieval._tiling(800, 200, 4, 3, 1)
    queries = vectors.filter("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    sizes = [r["count"] for r in retrieval.pairs(vectors, queries, 3, "l2", "vec_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == blocks * parts > 20 and sum(sizes) == 200 * parts * 3
    assert len(set(scratch.apart(spark, 500))) == 500


def test_rerank_by_a_score_of_rows(spark):
    """One score per row for all queries is joined by the row's key alone; rows without a score go."""
    found = spark.createDataFrame([(q, v, 0.0, v + 1) for q in (1, 2) for v in range(12)], "query_id int, vec_id int, score double, rank int")
    scores = spark.createDataFrame([(v, float(v * 7 % 5)) for v in range(12) if v != 4], "vec_id int, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in retrieval.rerank(found, scores, 2, "vec_id").collect())
    assert got == [(q, place, v, s) for q in (1, 2) for place, v, s in ((1, 2, 4.0), (2, 7, 4.0))]
    each = spark.createDataFrame([(q, v, float(q * v * 7 % 5)) for q in (1, 2) for v in range(12)], "query_id int, vec_id int, score double")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.rerank(found, each, 2, "vec_id").collect()) == [(1, 1, 2), (1, 2, 7), (2, 1, 1), (2, 2, 6)]


def test_reranked_search_writes_nothing(spark, sf_dir, monkeypatch):
    """Nearest rows meet their scores in one job, without a table written and read twice between."""
    def write(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(scratch, "scratch", write)
    assert registry.queries()["r24_reranked"](spark, sf_dir).count() == 125
