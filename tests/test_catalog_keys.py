"""Key discovery by sketches, short names, depth of any length, and profiles of odd tables, against plain Python."""

import random

import pytest

from skemara.operators import catalog as P


def frames(spark, **columns):
    """Tables from {table: {column: values}}; values of a table are of one length."""
    return {t: spark.createDataFrame(list(zip(*cols.values(), strict=True)), list(cols)) for t, cols in columns.items()}


def test_short_names_are_found(spark):
    tables = frames(spark, clicks={"click_id": list(range(40)), "ad_id": [i % 7 for i in range(40)], "tv_id": [i % 3 for i in range(40)], "c_fk": [i % 5 for i in range(40)]}, ads={"id": list(range(8))}, tv={"id": list(range(3))}, cities={"id": list(range(9))})
    types = P.pinned(P.typed(P.profile(spark, tables)))
    keys = P.pinned(P.primary_keys(types))
    found = {(r.child_column, r.parent_table) for r in P.discover(tables, types, keys, "cities").filter("child_table = 'clicks'").collect()}
    assert {("ad_id", "ads"), ("tv_id", "tv"), ("c_fk", "cities")} <= found


def test_sketches_rule_out_only_what_falls_short(spark):
    r = random.Random(1)
    big = list(range(20_000))
    some = [x if r.random() < 0.97 else x + 10**6 for x in big]
    half = [x if r.random() < 0.5 else x + 10**6 for x in big]
    tables = frames(spark, parent={"k": big, "s": [str(x) for x in big]}, child={"good": some, "bad": half, "few": [x % 5 for x in big], "odd": [str(x) for x in half]}, none={"k": [1]})
    pairs = [("child", c, "parent", p) for c in ("good", "bad", "few", "odd") for p in ("k", "s")] + [("child", "good", "none", "k")]
    kept = P.plausible(tables, pairs, size=500)
    values = {(t, c): {str(x[0]) for x in tables[t].select(c).collect()} for t, c in {x[:2] for x in pairs} | {x[2:] for x in pairs}}
    share = {p: len(values[p[:2]] & values[p[2:]]) / len(values[p[:2]]) for p in pairs}
    assert {p for p in pairs if share[p] >= P.COVERAGE} <= set(kept)
    assert not {p for p in kept if share[p] < 0.7}
    exact = {(x.child_table, x.child_column, x.parent_table, x.parent_column): (x.coverage, x.child_distinct, x.parent_distinct) for x in P.overlap_pairs(tables, pairs).collect()}
    assert exact == {p: (pytest.approx(share[p]), len(values[p[:2]]), len(values[p[2:]])) for p in pairs if share[p] > 0}
    sketch, bounds = P.sketches(tables, [("parent", "k"), ("child", "few")], 500)
    n = {(x["table"], x["column"]): x["count"] for x in sketch.groupBy("table", "column").count().collect()}
    assert n["child", "few"] == 5 and 300 < n["parent", "k"] < 800 and bounds["child", "few"] == 1.0


def walk(edges, start, seen):
    """Moves of the longest path from a table that does not enter a table twice, but for a last move back."""
    return max((1 + (0 if b in seen else walk(edges, b, seen | {b})) for a, b in edges if a == start), default=0)


def test_depth_of_any_length(spark):
    assert P.longest_path([(f"t{i}", f"t{i + 1}") for i in range(20)]) == 20
    assert P.longest_path([("a", "b"), ("b", "a")]) == 2
    assert P.longest_path([("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")]) == 4
    assert P.longest_path([]) == 0
    r = random.Random(5)
    for _ in range(60):
        edges = [e for e in {(r.randrange(7), r.randrange(7)) for _ in range(9)} if e[0] < e[1]]
        edges = [(str(a), str(b)) for a, b in edges]
        assert P.longest_path(edges) == max((walk(edges, a, {a}) for a, _ in edges), default=0)
    # A layered catalog has exponentially many paths.
    layers = [(f"{i}.{a}", f"{i + 1}.{b}") for i in range(30) for a in range(4) for b in range(4)]
    df = spark.createDataFrame([("deep", a, b) for a, b in layers] + [("flat", "p", "q")], "db_id string, child_table string, parent_table string")
    assert {(x.db_id, x.depth) for x in P.path_depth(df).collect()} == {("deep", 30), ("flat", 1)}


def test_profile_takes_the_three_least_and_odd_names(spark):
    rows = [(i % 7, f"it's \\{i % 4}", None if i % 2 else float("nan") if i % 5 == 0 else -i / 4, i > 20, b"x", f"{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "`a b` int, `quo``te` string, x double, flag boolean, raw binary, c20 string")
    for i in range(20):
        df = df.withColumn(f"more{i}", df["a b"] + i)
    got = {x.column: x for x in P.profile(spark, {"t": df}, samples=True).collect()}
    assert got["a b"].samples == ["0", "1", "2"] and got["quo`te"].samples == ["it's \\0", "it's \\1", "it's \\2"] and got["flag"].samples == ["false", "true"]
    assert got["more19"].samples == ["19", "20", "21"] and (got["more19"].low, got["more19"].high) == (19.0, 25.0) and got["raw"].samples == []
    assert got["c20"].n_distinct == 40 and got["c20"].samples == ["0", "1", "10"] and got["x"].samples[:2] == ["-9.5", "-9.0"] and len(got) == 26
