"""Cells of the ranking bootstrap, and samples over identifiers that are texts, against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from skemara.functions.scalar import PRIME
from skemara.operators import quota, stats


def mixed(key, seed=0, rep=0):
    h1 = (key * 48271 + seed * 16807 + 1) % PRIME
    h2 = (h1 * h1 + rep * 69621) % PRIME
    return (h2 * h2 + h1) % PRIME


def number(key):
    return key if isinstance(key, int) else int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % PRIME


def test_poisson_steps_match_the_distribution():
    for mean in (1, 3, 50, 4000):
        steps = stats.poisson_steps(mean)
        assert steps[-1] == pytest.approx(1) and np.all(np.diff(steps) >= 0)
        k = mean + 1
        assert steps[k] - steps[k - 1] == pytest.approx(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)), abs=1e-12)
    times = stats.cell_times(np.array([5]), np.array([400]), 0, np.arange(4000))[0]
    assert abs(times.mean() - 400) < 2 and abs(times.var() - 400) < 40


@pytest.mark.parametrize("text", [False, True])
def test_rank_replicates_equal_plain_python(spark, text):
    r = random.Random(2)
    uids = [hashlib.md5(str(i).encode()).hexdigest() if text else i for i in range(90)]
    values = {(u, m): (r.random() < p, round(r.random(), 1)) for u in uids for m, p in (("a", 0.6), ("b", 0.5), ("c", 0.55))}
    df = spark.createDataFrame([(u, m, *v) for (u, m), v in values.items()], ["uid", "model", "correct", "score"])
    got = {(x["regime"], x["rep"], x["model"]): (x["mean"], x["rank"]) for x in stats.rank_replicates(df, ("correct",), 50, 4).collect()}
    cells = {}
    for u in uids:
        cells.setdefault(tuple(values[u, m][0] for m in "abc"), []).append(number(u))
    for rep in range(50):
        total, sums = 0, [0.0] * 3
        for cell, keys in cells.items():
            u, t, upto = mixed(min(keys), 4, rep) / 2147483647.0, 0, 0.0
            while (upto := upto + math.exp(t * math.log(len(keys)) - len(keys) - math.lgamma(t + 1))) <= u:
                t += 1
            total += t
            sums = [s + t * c for s, c in zip(sums, cell, strict=True)]
        means = {m: round(s / total, 9) for m, s in zip("abc", sums, strict=True)}
        order = sorted("abc", key=lambda m: (-means[m], m))
        for m in "abc":
            mean, rank = got["correct", rep, m]
            assert mean == pytest.approx(means[m], abs=2e-9) and rank == order.index(m) + 1


def test_all_regimes_share_draws(spark):
    df = spark.createDataFrame([(f"u{i}", m, float(i % 5 == k), float(i % 5 == k)) for i in range(60) for k, m in enumerate("xyz")], ["uid", "model", "p", "q"])
    rows = {(r["regime"], r["rep"], r["model"]): r["mean"] for r in stats.rank_replicates(df, ("p", "q"), 40).collect()}
    assert all(v == rows["q", rep, m] for (g, rep, m), v in rows.items() if g == "p") and len(set(rows.values())) > 20


def test_samples_over_text_keys(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)]
    kind = {u: "pqr"[int(u, 16) % 3] if int(u, 16) % 50 else "s" for u in keys}
    df = spark.createDataFrame(list(kind.items()), ["uid", "cls"])
    by = {c: sorted((u for u in keys if kind[u] == c), key=lambda u: (mixed(number(u), 7), u)) for c in set(kind.values())}
    split = {r["uid"]: r["split"] for r in quota.stratified_split(df, "cls", "uid", 0.2, 0.1, 7).collect()}
    for us in by.values():
        t, v = int(len(us) * 0.1), int(len(us) * 0.2)
        assert [split[u] for u in us] == ["test"] * t + ["val"] * v + ["train"] * (len(us) - t - v)
    turns = [(k, c, u) for c, us in by.items() for k, u in enumerate(us)]
    want = {u: n for n, (_, _, u) in enumerate(sorted(turns)[:120], 1)}
    assert {r["uid"]: r["place"] for r in quota.round_robin(df, "cls", "uid", 120, 7).collect()} == want
    assert {r["uid"] for r in quota.even_cap(df, "cls", "uid", 41, 4, 7).collect()} == {u for us in by.values() for u in us[:10]}
    assert quota.matched_control(df.filter("cls = 's'"), df, "cls", "uid").count() == len(by.get("s", []))
    draws = stats.power_draws(df, 25, 3, 9)
    got = {}
    for r in draws.collect():
        got.setdefault(r["rep"], set()).add(r["uid"])
    assert got == {rep: set(sorted(keys, key=lambda u: (mixed(number(u), 9, rep), u))[:25]) for rep in range(3)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "uid string, cls string, model string, correct boolean")
    assert quota.round_robin(df, "cls", "uid", 5).count() == quota.even_cap(df, "cls", "uid", 5, 1).count() == 0
    assert stats.rank_replicates(df, ("correct",), 5, models=["a"]).count() == 0


def test_every_question_is_drawn(spark):
    """Not pooled: equal questions are drawn one by one, each at its own hash."""
    records = spark.range(40).selectExpr("id AS uid", "id % 4 = 0 AS correct").crossJoin(spark.createDataFrame([("a",), ("b",)], "model string"))
    got = {(r.rep, r.model): r["mean"] for r in stats.rank_replicates(records, ("correct",), 30, 3, pooled=False).collect()}
    draws = stats.cell_times(np.arange(40), np.ones(40, np.int64), 3, np.arange(30))
    want = (draws * (np.arange(40) % 4 == 0)[:, None]).sum(0) / draws.sum(0)
    assert got == {(k, m): pytest.approx(want[k], abs=1e-9) for k in range(30) for m in "ab"}
