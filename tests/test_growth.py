"""Work and memory of a query grow no faster than its input."""

import re
from collections import Counter

from pyspark.sql import functions as F

from skemara import registry
from skemara.operators import catalog, classify, metrics, retrieval, stats
from skemara.plans import derived
from skemara.sources.scratch import dealt


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_star_join_is_counted_without_its_rows(spark, tmp_path):
    """Two arms of 400,000 rows at one key: a join of 1.6e11 rows; null keys and keys of one arm join nothing."""
    write(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0), (None, "d", 0)], "n_nationkey int, n_name string, n_regionkey int"), tmp_path, "nation")
    arm = lambda p, more: spark.range(400_000).selectExpr(f"id AS {p}_key", f"1 AS {p}_nationkey").unionByName(spark.createDataFrame(more, f"{p}_key long, {p}_nationkey int"))
    write(arm("c", [(-1, 2), (-2, 2), (-3, None), (-4, 3)]), tmp_path, "customer")
    write(arm("s", [(-1, 2), (-2, None)]), tmp_path, "supplier")
    for t in ("region", "part", "orders", "lineitem"):
        write(spark.range(1), tmp_path, t)
    got = {r.n_nationkey: r.n for r in registry.queries()["j2_star_join"](spark, str(tmp_path)).collect()}
    assert got == {1: 400_000**2, 2: 2}


def test_aligned_records_are_made_once_and_dealt_by_their_number(spark):
    """A question with a failed model, one that a model lacks, a null one and a repeated record; what is read again is a stored table."""
    rows = [(1, "a", "x", "ok", True), (1, "b", "x", "ok", False), (2, "a", "x", "ok", True), (2, "b", "x", "api_error", True), (3, "a", "y", "ok", True), (None, "a", "y", "ok", True), (None, "b", "y", "ok", True), (4, "a", "y", "ok", False), (4, "b", "y", "ok", True), (4, "b", "y", "ok", True)]
    records = spark.createDataFrame(rows, "uid long, model string, db_id string, status string, correct boolean")
    found = stats.aligned(records)
    assert sorted((r.uid, r.model) for r in found.collect()) == [(1, "a"), (1, "b"), (4, "a"), (4, "b"), (4, "b")]
    pairs = stats.paired(found)
    assert sorted((r.uid, r.d) for r in pairs.collect()) == [(1, 1.0), (4, -1.0), (4, -1.0)]
    assert all("/aligned-" in f for f in found.inputFiles()) and all("/differences-" in f for f in pairs.inputFiles()) and found.inputFiles() and pairs.inputFiles()
    assert dealt(spark.range(100), "id", rows=10).rdd.getNumPartitions() == 10


STATEMENTS = [
    "SELECT o.a FROM orders AS o WHERE o.b > 5 AND o.c = 'x y'", "select a from orders where b >= 5;", "SELECT a, b FROM orders WHERE b >= 6 GROUP BY a ORDER BY b", "SELECT a FROM customer", "",
    "UPDATE orders SET a = 5 WHERE k = 2", "SELECT n.a FROM nation AS n JOIN orders AS o ON o.k = n.k WHERE o.b < 5 and n.c LIKE 'a%' and n.c LIKE 'a%'", "SELECT a FROM orders WHERE c <> 5",
]


def statement_table(spark):
    return spark.createDataFrame([(i * 100 + j, x, y) for i, x in enumerate([*STATEMENTS, None]) for j, y in enumerate([*STATEMENTS, None])], "k int, gold string, pred string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_failures_take_each_statement_apart_once(spark):
    df = statement_table(spark)
    found = classify.failures(df, "gold", "pred")
    want = df.select("k", classify.failure_category(F.col("gold"), F.col("pred")).alias("category"))
    assert sorted(found.select("k", "category").collect()) == sorted(want.collect()) and len({r.category for r in want.collect()}) > 4
    assert plan(found).count("group by|order by|having") == 2 and plan(want).count("group by|order by|having") > 2


def test_text_metrics_take_each_statement_apart_once(spark):
    df = statement_table(spark)
    found = metrics.text_metrics(df, "gold", "pred")
    parts = {side: metrics.components(F.col(side)) for side in ("gold", "pred")}
    text = plan(found)
    assert all(text.count(rf"\b{c}\b (.*?)") == 2 for c in metrics.CLAUSES)
    sets = {r.k: r for r in df.select("k", *(v.alias(f"{s}_{c}") for s, d in parts.items() for c, v in d.items())).collect()}
    for r in found.filter("gold IS NOT NULL AND pred IS NOT NULL").collect():
        each = [(set(sets[r.k][f"gold_{c}"]), set(sets[r.k][f"pred_{c}"])) for c in metrics.CLAUSES]
        assert abs(r.clause_jaccard - sum(len(x & y) / len(x | y) if x | y else 1.0 for x, y in each) / 5) < 1e-12
        assert abs(r.component_f1 - sum(2 * len(x & y) / (len(x) + len(y)) if x | y else 1.0 for x, y in each) / 5) < 1e-12


def test_tokens_are_counted_without_a_shuffle(spark):
    df = statement_table(spark).unionByName(spark.createDataFrame([(9001, "a a b", "a b b"), (9002, "a a a", "a a"), (9003, "?", ""), (9004, "b", None)], "k int, gold string, pred string"))
    found = metrics.token_f1(df, ["k"], "gold", "pred")
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
    got = {r.k: r.f1 for r in found.collect()}
    for r in df.collect():
        g, p = (Counter(re.findall("[a-z0-9_]+", (x or "").lower())) for x in (r.gold, r.pred))
        h = (g & p).total()
        assert abs(got[r.k] - (2 * h / (g.total() + p.total()) if h else 0.0)) < 1e-12
    assert metrics.token_f1(df.limit(0), ["k"], "gold", "pred").count() == 0


def test_statement_pairs_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "STATEMENTS", 10)
    write(spark.range(200).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "1D AS o_totalprice"), tmp_path, "orders")
    found = derived.statement_pairs(spark, str(tmp_path), F.lit(1))
    assert sorted(r.sql_id for r in found.collect()) == list(range(199)) and plan(found).count("RepartitionByExpression") == 2 and ", 20" in plan(found)


def test_capabilities_profile_once(spark, sf_dir, monkeypatch):
    calls = []
    profile = catalog.profile
    monkeypatch.setattr(catalog, "profile", lambda *a, **b: calls.append(1) or profile(*a, **b))
    assert registry.queries()["c5_c6_capabilities"](spark, sf_dir).count() == 4 and len(calls) == 1


def test_values_of_columns_meet_in_one_aggregate(spark, monkeypatch):
    """No join by value and no row per column of a row; the same in lots of few columns."""
    tables = {"p": spark.range(100).selectExpr("id AS k", "CAST(id AS string) AS s"), "c": spark.range(400).selectExpr("CASE WHEN id % 9 > 0 THEN id DIV 3 END AS k", "CAST(id % 50 AS int) AS few", "CAST(id + 90 AS string) AS s")}
    pairs = [("c", "k", "p", "k"), ("c", "few", "p", "k"), ("c", "k", "c", "few"), ("c", "few", "p", "s"), ("c", "s", "p", "s"), ("c", "s", "p", "k")]
    found = catalog.overlap_pairs(tables, pairs)
    assert "Generate" not in plan(found) and plan(found).count("Join") == plan(found).count("Join Cross")
    sets = {(t, c): {str(r[0]) for r in tables[t].select(c).collect() if r[0] is not None} for t in tables for c in tables[t].columns}
    want = {p: (len(sets[p[:2]] & sets[p[2:]]) / len(sets[p[:2]]), len(sets[p[:2]]), len(sets[p[2:]])) for p in pairs}
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()} == want
    monkeypatch.setattr(catalog, "BITS", 2)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in catalog.overlap_pairs(tables, pairs).collect()} == want


def test_words_are_counted_in_their_row(spark):
    words = spark.createDataFrame([(1, 4, ["b", "a", "b", "b"]), (2, 0, []), (3, 1, ["c"])], "key int, dl long, _w array<string>")
    found = retrieval.row_counts(words, "key")
    assert sorted(map(tuple, found.collect())) == [(1, 4, "a", 1), (1, 4, "b", 3), (3, 1, "c", 1)] and "Aggregate" not in plan(found)
