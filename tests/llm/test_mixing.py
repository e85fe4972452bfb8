"""The mix against plain Python with fractions."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from skemara.llm import mixing

DOCS = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), percent=100, most=3):
    """Target of each source, taking the excess back in turns."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held = sum(sizes.values()) * percent // 100, set()
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(most * sizes[s] for s in held)
        share = {s: Fraction(weight[s] * rest, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(most * sizes[s])) for s in order}
        held |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def copies(doc_id, text, rate):
    key = f"13:{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
    return int(rate) + (draw < float(rate) - int(rate))


def check(spark, rows, **more):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    goal = targets(sizes, **more)
    want = sorted(((d, words(t), sizes[s], float(goal[s]), copies(d, t, goal[s] / sizes[s] if sizes[s] else 0)) for d, t, s in rows), key=repr)
    got = mixing.mix_counts(spark.createDataFrame(rows, DOCS), **more)
    found = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in got.collect()), key=repr)
    assert [x[:3] + x[4:] for x in found] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in want], rel=1e-12)


def corpus(seed, sources):
    r = random.Random(seed)
    return [(r.choice([i, i, i, None]), r.choice([None, "", " \n", "a b", "w " * r.randrange(200), "Ü\x0bx y z"]), r.choice(sources)) for i in range(400)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["", "é", "e", "Z", "\U0001f600", "￮", None], [f"s{i}" for i in range(60)]])
def test_counts_equal_fractions(spark, sources):
    check(spark, corpus(len(sources), sources))


def test_excess_is_shared_in_turns(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 40), ("c", 3), ("d", 2), ("e", 500), ("f", 0), ("g", 9)])]
    check(spark, rows)
    check(spark, rows, percent=300)
    check(spark, rows, weights=(1, 7), percent=40, most=2)


def test_taken_words_come_near_the_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 60), "big" if i % 3 else f"s{i % 4}") for i in range(6000)]
    got = mixing.mix_digest(spark.createDataFrame(rows, DOCS)).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert got and all(abs(x["sum(taken)"] - x["target"]) < 0.05 * x["target"] for x in got)


def test_mix_emits_every_copy_and_agrees_with_itself(spark):
    rows = corpus(5, ["a", "b", "c", None])
    df = spark.createDataFrame(rows, DOCS)
    counts = {(r["doc_id"], r["text"], r["source"]): r["copies"] for r in mixing.mix_counts(df).collect()}
    again = {(r["doc_id"], r["text"], r["source"]): r["copies"] for r in mixing.mix_counts(df.repartition(9)).collect()}
    assert counts == again
    many = mixing.mix_sources(df).groupBy("doc_id", "text", "source").agg({"copy": "max", "*": "count"}).collect()
    repeats = {}
    for row in rows:
        repeats[row] = repeats.get(row, 0) + 1
    assert {(r["doc_id"], r["text"], r["source"]): (r["max(copy)"], r["count(1)"]) for r in many} == {k: (c, c * repeats[k]) for k, c in counts.items() if c}


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], DOCS)
    for name in ("size", "Target", "_n", "_rate", "_source", "copies", "_draw"):
        df = df.withColumn(name, df["doc_id"])
    got = mixing.mix_counts(df)
    assert {r["size"] for r in got.collect()} == {1, 2} and {"_n", "_rate", "_source", "_draw"} < set(got.columns)
    assert mixing.mix_sources(df).count() > 0
    assert mixing.mix_counts(df.limit(0)).count() == 0 and mixing.mix_digest(df.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mix_counts(spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCS)).collect()} == {0.0}
