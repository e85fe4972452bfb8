"""Supplied statements in passes by what they read, against running each by itself."""

import random

import pytest

from skemara.operators import cejsq, statements


@pytest.mark.parametrize("sql", [
    None, "", "UPDATE t SET a = 1", "SELECT a FROM t GROUP BY a", "SELECT count(*) FROM t", "SELECT a FROM t WHERE a IN (SELECT b FROM u)", "SELECT a FROM t WHERE a = 1 ORDER BY a",
    "SELECT a FROM t WHERE a = 1) OR (a = 2", "SELECT a FROM t WHERE (a = 1", "SELECT a FROM t -- WHERE", "SELECT a FROM t WHERE a = 'x\\'' OR b = 'y'", "SELECT a FROM t WHERE a = 1; SELECT 2", "SELECT 'x' FROM t",
])
def test_not_plain(sql):
    assert statements.selection(sql) is None


def test_parts_and_words_in_texts():
    got = statements.selection("select DISTINCT a.x,\n a.y\nFROM t AS a  JOIN u ON a.x = u.x WHERE a.y = 'it''s  GROUP BY (' AND (a.x > 1 OR a.x < 0) ;")
    assert got == statements.Selection("a.x, a.y", "t AS a JOIN u ON a.x = u.x", "a.y = 'it''s  GROUP BY (' AND (a.x > 1 OR a.x < 0)")
    assert statements.selection("SELECT x FROM t").condition == "true"


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(k % 40 if k % 11 else None, f"n{k % 7}", k % 5) for k in range(300)], "x long, y string, z long").createOrReplaceTempView("st_t")
    spark.createDataFrame([(k, f"m {k}") for k in range(30)], "x long, w string").createOrReplaceTempView("st_u")
    spark.createDataFrame([], "x long").createOrReplaceTempView("st_none")


def single(spark, pairs, most):
    out = []
    for uid, sql in pairs:
        try:
            n = spark.sql(sql).distinct().limit(most + 1).count()
            out.append((uid, "ok" if 1 <= n <= most else "empty" if n == 0 else "too_many", n))
        except Exception:
            out.append((uid, "error", 0))
    return sorted(out)


def test_same_as_one_by_one(spark, views):
    """Joins, outer joins, nulls, repeats, names that clash, aggregates and bad values in conditions, unknown columns, an empty table."""
    draw = random.Random(5)
    heads = ["SELECT a.x FROM st_t AS a JOIN st_u AS b ON a.x = b.x", "SELECT DISTINCT a.x, b.x FROM st_t AS a LEFT JOIN st_u AS b ON a.x = b.x", "SELECT * FROM st_t AS a CROSS JOIN st_none AS b", "SELECT 1 FROM st_t AS a, st_u AS b"]
    conditions = ["a.x < {k}", "a.x IS NULL OR a.x > {k}", "a.x = {k} AND b.x = 3", "b.x IS NULL", "max(a.x) > {k}", "a.lost = {k}", "a.x = CAST('bad' AS INT)", "{k}", "lower(concat(a.x, '(', b.x)) LIKE '%{k}%'", "NOT (a.x > {k} AND a.x < 20)"]
    pairs = [(f"q{i}", f"{draw.choice(heads)} WHERE {draw.choice(conditions).format(k=draw.randrange(40))}") for i in range(40)] + [(f"h{i}", h) for i, h in enumerate(heads)] + [("null", None)]
    # A bad value that meets no joined row has a result of its own, below.
    pairs = [(uid, sql) for uid, sql in pairs if sql is None or not ("st_none" in sql and "bad" in sql)]
    got = sorted(tuple(r) for r in cejsq.execute_pairs(spark, pairs, 15).collect())
    assert got == single(spark, pairs, 15)


def test_bad_value_that_no_joined_row_meets(spark, views):
    """Together with others, no row is tested and the statement is empty; alone, Spark may meet the value before the join."""
    head = "SELECT a.x FROM st_t AS a CROSS JOIN st_none AS b WHERE"
    pairs = [("bad", f"{head} a.y = CAST('bad' AS INT)"), ("good", f"{head} a.x = 1")]
    assert sorted(tuple(r) for r in cejsq.execute_pairs(spark, pairs, 15).collect()) == [("bad", "empty", 0), ("good", "empty", 0)]


def test_passes_are_by_structure(spark, views, monkeypatch):
    """Two hundred statements of two structures: as many passes as the passes' size asks for, and none alone."""
    asked = []
    real = statements.hits
    monkeypatch.setattr(statements, "hits", lambda s, shared, conditions: asked.append(len(conditions)) or real(s, shared, conditions))
    monkeypatch.setattr(cejsq, "resolves", lambda *a: pytest.fail("looked at alone"))
    pairs = [(f"a{k}", f"SELECT x FROM st_t WHERE z = {k % 6} AND x >= {k}") for k in range(100)] + [(f"b{k}", f"SELECT y FROM st_t WHERE x = {k}") for k in range(100)]
    got = {r.uid: (r.status, r.n) for r in cejsq.execute_pairs(spark, pairs, 15).collect()}
    assert asked == [100, 100] and len(got) == 200
    assert got["b3"] == ("ok", spark.sql("SELECT DISTINCT y FROM st_t WHERE x = 3").count()) and got["a99"] == ("empty", 0)


def test_bad_statements_leave_the_others_together(spark, views, monkeypatch):
    """Every third condition does not resolve: one pass for all others."""
    ran = []
    monkeypatch.setattr(cejsq, "counts", lambda s, shared, conditions, alone: statements.counts(s, shared, conditions, lambda k: ran.append(k) or alone(k)))
    pairs = [(str(k), f"SELECT x FROM st_t WHERE {'lost' if k % 3 == 0 else 'z'} = {k % 5}") for k in range(30)]
    got = {r.uid: r.status for r in cejsq.execute_pairs(spark, pairs, 50).collect()}
    assert ran == list(range(0, 30, 3))
    assert {got[str(k)] for k in ran} == {"error"} and sum(s == "ok" for s in got.values()) == 20


def test_plan_reads_what_is_asked(spark, sf_dir):
    """The columns named beside the conditions do not reach the scan."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("st_orders")
    groups, alone = statements.by_source([f"SELECT o_orderkey FROM st_orders WHERE o_totalprice > {k}" for k in range(3)])
    plan = statements.hits(spark, *groups[0])._jdf.queryExecution().executedPlan().toString()
    assert not alone and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
