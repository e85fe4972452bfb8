"""Small hand-made tables for semantics that the shared test tables do not show."""

import pytest
from pyspark.sql import functions as F

from skemara.functions import scalar
from skemara.operators import catalog, cejsq, classify, metrics, quota, retrieval, stats, structures
from skemara.sources import readers, writers
from skemara.sources.scratch import scratch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [("1.0", "1"), (" 7 ", "7"), ("0.0000005", "0.0"), ("2.5", "2.5"), ("-0.0", "0"), ("true", "true"), ("x1", "x1"), ("1e3", "1000")])
def test_normal_id(spark, value, want):
    got = one(spark, scalar.normal_id(F.lit(value)))
    assert got == want or float(got) == float(want)


@pytest.mark.parametrize("n, p, want", [(5, 95, 5.0), (20, 95, 19.95), (40, 50, 20.5)])
def test_exclusive_quantile(spark, n, p, want):
    values = F.array(*(F.lit(float(i + 1)) for i in range(n)))
    assert one(spark, scalar.exclusive_quantile(values, p, 20)) == pytest.approx(want)


def test_floor_quantile(spark):
    values = F.array(*(F.lit(float(i)) for i in range(10)))
    assert [one(spark, scalar.floor_quantile(values, p)) for p in (0, 50, 95, 100)] == [0.0, 5.0, 9.0, 9.0]


def test_dates_and_names(spark):
    assert one(spark, scalar.epoch_date(F.lit("/Date(86400000)/"))) == "1970-01-02"
    assert one(spark, scalar.epoch_date(F.lit("/Date(-1)/"))) == "1969-12-31"
    assert one(spark, scalar.epoch_date(F.lit("soon"))) == "soon"
    assert one(spark, scalar.stem_aliases(F.lit("cities"))) == ["cities", "city"]
    assert one(spark, scalar.camel_words(F.lit("OrderKey_id"))) == ["order", "key", "id"]


def test_entropy(spark):
    assert one(spark, scalar.entropy(F.array(F.lit(5.0), F.lit(5.0)), F.lit(2))) == pytest.approx(1.0)
    assert one(spark, scalar.entropy(F.array(F.lit(5.0)), F.lit(1))) == 1.0
    assert one(spark, scalar.entropy(F.array(F.lit(0.0)), F.lit(3))) is None


def results(spark, gold, pred):
    return spark.createDataFrame([("q", "gold", g) for g in gold] + [("q", "pred", p) for p in pred], "uid string, side string, row string")


@pytest.mark.parametrize("gold, pred, same_set, same_bag, f1", [(["a", "a"], ["a"], True, False, 2 / 3), (["a"], ["b"], False, False, 0.0), (["a", "b"], ["b", "a"], True, True, 1.0), (["a"], [], False, False, 0.0)])
def test_set_and_multiset(spark, gold, pred, same_set, same_bag, f1):
    rows = results(spark, gold, pred)
    assert metrics.set_match(rows).first()["correct"] is same_set
    assert metrics.multiset_match(rows).first()["correct"] is same_bag
    assert metrics.row_f1(rows).first()["f1"] == pytest.approx(f1)


def test_empty_results_score_by_parameter(spark):
    keys = spark.createDataFrame([("q",)], "uid string")
    for value in (0.0, 1.0):
        assert metrics.row_f1(results(spark, [], []), both_empty=value, keys=keys).first()["f1"] == value


def test_merge_runs_takes_the_later_file_on_ties(spark):
    runs = spark.createDataFrame([("m", "u", 5, 1, 0.1), ("m", "u", 5, 2, 0.2), ("n", "u", 1, 1, 0.3), ("n", "v", 1, 1, 0.4)], "mode string, uid string, evaluated_at int, file int, row_f1 double")
    assert {(r.mode, r.uid, r.row_f1) for r in metrics.merge_runs(runs).collect()} == {("m", "u", 0.2), ("n", "u", 0.3)}


def test_largest_remainder_sums_and_breaks_ties_early(spark):
    w = spark.createDataFrame([(s, i, 1 / 3) for i, s in enumerate("abc")], "strategy string, ordinal int, weight double")
    got = {r.strategy: r.quota for r in quota.largest_remainder(w, 10).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}


def test_benjamini_hochberg_is_a_step_up(spark):
    tests = spark.createDataFrame([("a", "b", 0.04), ("a", "c", 0.01), ("b", "c", 0.03), ("b", "d", 0.9)], "a string, b string, p double")
    got = {(r.a, r.b): r.rejected for r in stats.benjamini_hochberg(tests).collect()}
    assert got == {("a", "c"): True, ("b", "c"): False, ("a", "b"): False, ("b", "d"): False}
    assert stats.benjamini_hochberg(tests.filter("p < 0.05")).filter("rejected").count() == 3


def test_kendall(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "model string, rank int")
    b = spark.createDataFrame([("x", 3), ("y", 2), ("z", 1)], "model string, rank int")
    assert stats.kendall(a, a).first()["tau"] == 1.0 and stats.kendall(a, b).first()["tau"] == -1.0
    assert {(r.a, r.b) for r in stats.inversions(a, b).collect()} == {("x", "y"), ("x", "z"), ("y", "z")}


def test_one_cluster_falls_back_to_questions(spark):
    diffs = spark.createDataFrame([("m", "n", i, "db", float(i % 2)) for i in range(20)], "a string, b string, uid long, cluster string, d double")
    means = {round(r["mean"], 6) for r in stats.bootstrap(diffs, 30).collect()}
    assert len(means) > 3 and all(0 <= m <= 1 for m in means)


@pytest.mark.parametrize("sql, reason, conditions", [
    ("SELECT a FROM t WHERE x = 'a or b' AND y > 2", None, 2), ("SELECT a FROM t WHERE x BETWEEN 1 AND 2", None, 1), ("SELECT count(*) FROM t", "aggregate", 0), ("SELECT a FROM t WHERE x = 1 OR y = 2", "or_condition", 1),
    ("SELECT a FROM t GROUP BY a HAVING a > 1", "having", 0), ("DELETE FROM t", "not_select", 0), ("SELECT a FROM t WHERE b IN (SELECT c FROM u)", "subquery", 1),
])
def test_fragment(spark, sql, reason, conditions):
    assert one(spark, classify.exclusion(F.lit(sql))) == reason
    if reason in (None, "or_condition"):
        assert one(spark, classify.condition_count(F.lit(sql))) == conditions


@pytest.mark.parametrize("gold, pred, want", [
    ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t JOIN u ON t.i = u.i WHERE x = 1", "join_path"), ("SELECT a FROM t WHERE x = 1 AND y = 2", "SELECT a FROM t WHERE x = 1", "missing_predicate"),
    ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 1 AND y = 2", "extra_predicate"), ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x > 1", "operator"), ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 2", "value"),
])
def test_failures(spark, gold, pred, want):
    assert one(spark, classify.failure_category(F.lit(gold), F.lit(pred))) == want


def test_plan_codes(spark):
    paths = lambda *p: F.array(*(F.array(*(F.lit(t) for t in x)) for x in p))
    assert one(spark, classify.plan_code(paths(["t"]), F.lit(False), F.lit(2))) == "0E"
    assert one(spark, classify.plan_code(paths(["t", "a", "b"]), F.lit(False), F.lit(3))) == "2pM"
    assert one(spark, classify.plan_code(paths(["t", "a"], ["t", "b"]), F.lit(True), F.lit(6))) == "2iH"


@pytest.fixture(scope="module")
def star(spark):
    fk = catalog.ForeignKey
    tables = {
        "hub": spark.createDataFrame([(1, 1, 10, "50%"), (2, 2, 20, "A_b"), (3, None, 10, "ab"), (4, 2, None, None)], "id int, a int, b int, note string"),
        "dim": spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (None, 10, "z")], "a int, b int, name string"),
    }
    return tables, catalog.Schema("hub", {"hub": "id", "dim": None}, [fk("hub", ("a", "b"), "dim", ("a", "b"))])


def test_composite_keys_and_null_keys(star):
    tables, schema = star
    frame = cejsq.joined(tables, schema, ("hub", "dim"), False)
    assert sorted(r.id for r in frame.collect()) == [1, 2]
    assert cejsq.join_size(tables, schema, ("hub", "dim"), False).first()["rows"] == 2


@pytest.mark.parametrize("value, ids", [("0%", [1]), ("a_B", [2]), ("AB", [3]), ("'", [])])
def test_like_is_literal(spark, star, value, ids):
    tables, schema = star
    spec = cejsq.Spec(0, "0E", ("hub",), False, (cejsq.Predicate("hub", "note", "LIKE", value, "COMMA_SEPARATED"),))
    stored = cejsq.answers(cejsq.joined(tables, schema, ("hub",), False), [spec], "id")
    assert sorted(r.answer for r in stored.collect()) == ids
    assert cejsq.gold_gate(spark, tables, [spec], schema, stored).count() == 0


def test_self_reference_to_depth_three(spark):
    fks = spark.createDataFrame([("theme", "parent_id", "theme", "id", 1.0)], "child_table string, child_column string, parent_table string, parent_column string, coverage double")
    got = {(r.pattern, len(r.tables)) for r in structures.chains(fks, "theme").collect()}
    assert got == {("1p", 2), ("2p", 3)}
    assert cejsq.aliases(("theme", "theme", "theme")) == ["theme", "theme__1", "theme__2"]


def test_four_arms(spark):
    fks = spark.createDataFrame([("hub", f"d{i}_id", f"d{i}", "id", 1.0) for i in range(4)], "child_table string, child_column string, parent_table string, parent_column string, coverage double")
    counts = {r["pattern"]: r["count"] for r in structures.stars(fks, "hub").groupBy("pattern").count().collect()}
    assert counts == {"2i": 6, "3i": 4, "4i": 1}


def test_anchored_queries_have_their_anchor(spark, star):
    tables, schema = star
    frame = cejsq.joined(tables, schema, ("hub", "dim"), False)
    specs = cejsq.anchored_specs(frame, schema, "1pE", ("hub", "dim"), False, {"hub": [("b", "NUMERIC")], "dim": [("name", "ENUM")]}, 2)
    assert len(specs) == 2 and all(cejsq.code_of(s) == "1pE" for s in specs)
    assert {r.spec for r in cejsq.answers(frame, specs, "id").collect()} == {0, 1}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    assert all(cejsq.resolves(spark, cejsq.render(s, schema)) is None for s in specs)
    assert "x" in cejsq.resolves(spark, "SELECT x FROM hub")


def test_semantic_types(spark):
    rows = [(True, "t", "2024-01-05", 1990, "a,b,c", f"v{i % 20}", f"w{i}", "x" * 60 + str(i), "a\nb" + str(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "flag boolean, tf string, day string, year_built int, list string, enum string, label string, long string, lines string")
    got = {r.column: r.semantic for r in catalog.typed(catalog.profile(spark, {"t": df})).collect()}
    assert got == {"flag": "BOOLEAN", "tf": "BOOLEAN", "day": "DATE", "year_built": "YEAR", "list": "COMMA_SEPARATED", "enum": "ENUM", "label": "LABEL", "long": "TEXT", "lines": "TEXT"}


def test_walk_takes_the_best_path_and_counts_arrivals(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "t\t1"), ("b", "t\t1"), ("t\t1", "s")], "a string, b string")
    start = spark.createDataFrame([(0, "s", 1.0)], "query_id int, node string, score double")
    row = retrieval.walk(start, edges, "t", 2).first()
    assert (row.node, row.paths) == ("t\t1", 2) and row.score == pytest.approx(0.74**2 + 0.1)


def test_guard(spark):
    for sql in ("DROP TABLE x", "SELECT 1; DROP TABLE x", ""):
        with pytest.raises(ValueError):
            retrieval.guarded(spark, sql)
    assert retrieval.guarded(spark, "SELECT double('nan') AS x").first()["x"] is None


def test_pairs_files_of_both_forms(spark):
    path = scratch(spark, "forms")
    spark.createDataFrame([('[{"question": "q", "sql": "SELECT 1"}]',)], "value string").coalesce(1).write.text(f"{path}/a")
    spark.createDataFrame([('{"qa_pairs": [{"uid": "u", "question": "q", "sql": "SELECT 2"}]}',)], "value string").coalesce(1).write.text(f"{path}/b")
    got = {(r.uid, r.sql) for r in readers.read_pairs(spark, path).collect()}
    assert ("u", "SELECT 2") in got and len(got) == 2


def test_missing_target_and_unknown_connector(spark):
    with pytest.raises(ValueError):
        readers.with_target({}, "orders")
    with pytest.raises(ValueError):
        readers.connect("nothing", spark)
    with pytest.raises(FileNotFoundError):
        readers.csv_tables(spark, scratch(spark, "none"))
    with pytest.raises(ValueError):
        writers.tuning_rows(spark.createDataFrame([("q", "s", True)], "question string, sql string, is_valid boolean"), "other")


def test_phrases_are_runs_of_words(spark):
    words = F.array(*(F.lit(w) for w in "abcd"))
    assert one(spark, scalar.phrases(words)) == ["a b c d", "a b c", "b c d", "a b", "b c", "c d"]
    assert one(spark, scalar.runs(words, 5)) == []


def test_all_questions_and_dates_are_answered(spark):
    docs = spark.createDataFrame([(i, f"text x{i}y") for i in range(3000)], "doc_id int, text string")
    questions = spark.createDataFrame([(i, f"the x{i}y") for i in range(1500)], "query_id int, text string")
    got = {(r.query_id, r.doc_id) for r in retrieval.containment(docs, questions).collect()}
    assert got == {(i, i) for i in range(1500)}
    days = spark.sql("SELECT CAST(id AS INT) AS k, DATE'1990-01-01' + CAST(id AS INT) AS day FROM range(1500)")
    dates = days.select(F.col("k").alias("query_id"), F.year("day").alias("year"), F.month("day").alias("month"), F.day("day").alias("day"))
    found = retrieval.by_date(days, dates, "k", "day").collect()
    assert {(r.query_id, r.k, r.score) for r in found} == {(i, i, 3.0) for i in range(1500)}


def test_blocks_that_are_not_small_are_dealt(spark, monkeypatch):
    from skemara.sources import scratch as shared

    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id int, embedding array<double>")
    questions = spark.createDataFrame([(i, [i + 0.1, 1.0]) for i in range(0, 40, 4)], "query_id int, vector array<double>")
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    want = retrieval.nearest(vectors, questions, 3).collect()
    monkeypatch.setattr(shared, "is_small", lambda *_: False)
    assert sorted(retrieval.nearest(vectors, questions, 3).collect()) == sorted(want)
    assert {(r.query_id, r.vec_id) for r in want if r["rank"] == 1} == {(i, i) for i in range(0, 40, 4)}


def test_small_is_told_by_rows_and_bytes(spark):
    from skemara.sources.scratch import is_small

    rows = spark.createDataFrame([("x" * 1000, [1.0] * 100, {"a": "b"})] * 20, "t string, v array<double>, m map<string, string>")
    assert is_small(rows) and not is_small(rows, rows=19) and not is_small(rows, size=20_000) and is_small(rows, size=60_000)


def test_one_cluster_weighs_every_question(spark):
    diffs = spark.range(400).select(F.lit("m").alias("a"), F.lit("n").alias("b"), F.col("id").alias("uid"), F.lit("db").alias("cluster"), (F.col("id") % 4).cast("double").alias("d"))
    means = [r["mean"] for r in stats.bootstrap(diffs, 500).collect()]
    assert len(means) == 500 and abs(sum(means) / 500 - 1.5) < 0.02
    sd = (sum((m - 1.5) ** 2 for m in means) / 500) ** 0.5
    assert 0.8 < sd / ((1.25 / 400) ** 0.5) < 1.2


def test_hash_ranks_cross_stretches(spark, monkeypatch):
    monkeypatch.setattr(quota, "STRETCHES", 7)
    rows = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(300)], "uid long, cls string")
    got = quota.hash_ranked(rows, ["cls"], "uid", 3).select("uid", "cls", scalar.mix(F.col("uid"), 3).alias("h"), "_r", "_n").collect()
    for cls in ("x", None):
        mine = sorted((r.h, r.uid) for r in got if r.cls == cls)
        assert [(r.uid, r._r, r._n) for r in sorted((r for r in got if r.cls == cls), key=lambda r: r._r)] == [(u, i + 1, len(mine)) for i, (_, u) in enumerate(mine)]


def test_large_shards_are_several_rows(spark):
    details = spark.createDataFrame([("m", "db" if i % 2 else None, i) for i in range(200)], "mode string, db_id string, uid int")
    parts = writers.evaluation_document(details, 10).collect()
    assert len(parts) > 10 and max(r.n for r in parts) < 40
    assert sorted(x.uid for r in parts for x in r.results) == list(range(200))


def test_profile(spark):
    rows = [(1, "a", 1.5, None, "2020-01-01", [1]), (2, "b", 2.5, None, "2021-05-01", None), (3, "a", None, None, "2020-01-02 10:00", [2])]
    df = spark.createDataFrame(rows, "id int, c string, x double, nothing string, day string, nested array<int>")
    got = {r.column: r for r in catalog.profile(spark, {"t": df, "empty": df.limit(0)}, samples=True).filter("table = 't'").collect()}
    assert [(got[c].n, got[c].n_set, got[c].n_distinct) for c in ("id", "c", "x", "nothing", "day", "nested")] == [(3, 3, 3), (3, 3, 2), (3, 2, 2), (3, 0, 0), (3, 3, 3), (3, 2, 0)]
    assert [got[c].samples for c in ("id", "c", "x", "nothing", "nested")] == [["1", "2", "3"], ["a", "b"], ["1.5", "2.5"], [], []]
    assert (got["id"].low, got["id"].high, got["day"].date_share, got["c"].boolean_like) == (1.0, 3.0, 1.0, False)
    assert catalog.profile(spark, {"empty": df.limit(0)}).filter("n <> 0").count() == 0 and catalog.profile(spark, {}).count() == 0


def test_chunks_spread_repeats_and_null_keys(spark):
    from skemara.sources import writers

    rows = [("db", "select 1", None)] * 5000 + [("other", "select 2", "u")]
    parts = writers.chunked(spark.createDataFrame(rows, "db_id string, sql string, uid string"), ["db_id"], 100).groupBy("db_id", "part").count().collect()
    sizes = [r["count"] for r in parts if r["db_id"] == "db"]
    assert sum(sizes) == 5000 and len(sizes) == 50 and max(sizes) < 160


def test_supplied_statements_run_together(spark, monkeypatch):
    monkeypatch.setattr(cejsq, "TOGETHER", 3)
    spark.createDataFrame([(i, str(i) if i != 5 else "five") for i in range(30)], "id int, t string").createOrReplaceTempView("supplied")
    pairs = [("a", "SELECT id FROM supplied"), ("b", "SELECT id FROM supplied WHERE id < 4"), ("c", "SELECT CAST(t AS INT) FROM supplied"), ("d", "SELECT nothing FROM supplied"), ("e", "SELECT id % 2 FROM supplied"), ("f", "SELECT id FROM supplied WHERE id > 99"), ("b", "SELECT 1")]
    got = sorted((r.uid, r.status, r.n) for r in cejsq.execute_pairs(spark, pairs, 15).collect())
    assert got == [("a", "too_many", 16), ("b", "ok", 1), ("b", "ok", 4), ("c", "error", 0), ("d", "error", 0), ("e", "ok", 2), ("f", "empty", 0)]
    assert cejsq.execute_pairs(spark, [], 15).count() == 0
