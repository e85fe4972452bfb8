"""Generation to quota against a loop that builds, runs and counts one query after the other in another engine; keys that play roles."""

import datetime

import duckdb
import pytest

from skemara.operators import cejsq as J
from skemara.operators import generate as G
from skemara.operators import structures as C
from skemara.operators.catalog import ForeignKey, Schema
from skemara.plans import generation as plans


def loop(con, schema, quotas, filters, structures, able, most, tries, seed):
    """(accepted texts by class, report rows) of one build after the other."""
    seen, out, report = set(), {}, {}
    for k, (strategy, quota) in enumerate(sorted(quotas.items())):
        state, texts, why = G.ClassState(strategy, k, quota), [], {}
        attempts = used = 0
        while strategy in able and len(texts) < quota and attempts < quota * (80 if texts else 12):
            bad, done = [], False
            for turn in range(tries):
                used += 1
                _, spec, failure = G.build(state, structures[strategy[:-1]], attempts, turn, filters, seed)
                if failure is None:
                    n = con.execute(f"SELECT count(*) FROM ({J.render(spec, schema)}) AS q(k) WHERE k IS NOT NULL").fetchone()[0]
                    failure = "no_results" if n == 0 else "too_many_results" if n > most else None
                if failure is None:
                    done, text = True, J.render(spec, schema)
                    if text in seen:
                        why["duplicate_pair"] = why.get("duplicate_pair", 0) + 1
                    else:
                        seen.add(text)
                        texts.append(text)
                    break
                bad.append(failure)
            if not done:
                order = ["no_results", "too_many_results", "validation_failed", "insufficient_filters"]
                worst = max(order, key=bad.count)
                reason = {"no_results": "sparse_combinations" if strategy[1] in "pi" else "no_valid_values", "too_many_results": "result_size_out_of_range", "validation_failed": "strategy_validation_failed", "insufficient_filters": "insufficient_filter_columns"}[worst]
                why[reason] = why.get(reason, 0) + 1
            attempts += 1
        out[strategy] = texts
        reason = None if len(texts) == quota else "pattern_infeasible" if strategy not in able else max(why, key=why.get) if why else "attempt_budget_exhausted"
        report[strategy] = (quota, len(texts), attempts, used, reason)
    return out, report


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize(("target", "most", "tries"), [("orders", 15, 2), ("nation", 3, 3)])
def test_generation_equals_a_loop(spark, sf_dir, con, monkeypatch, target, most, tries):
    tables, schema, filters = plans.inputs(spark, sf_dir, target)
    quotas = {p + t: 2 for p in ("0", "1p", "2p", "3p", "2i", "3i", "4i") for t in "EMH"}
    kept = {}
    real = G.enumerate_structures
    monkeypatch.setattr(G, "enumerate_structures", lambda *a: kept.setdefault("found", real(*a)))
    queries, report = G.generate(tables, schema, quotas, filters, most, tries, 5, sample=40)
    able = G.feasible_classes(kept["found"], filters)
    texts, rows = loop(con, schema, quotas, filters, kept["found"], able, most, tries, 5)
    got = {}
    for r in queries.orderBy("number").collect():
        got.setdefault(r["strategy"], []).append(r["sql"])
        assert sorted(str(x[0]) for x in con.execute(r["sql"]).fetchall() if x[0] is not None) == r["answers"] and 1 <= len(r["answers"]) <= most
    assert got == {k: v for k, v in texts.items() if v}
    assert {r["strategy"]: (r["quota"], r["accepted"], r["attempts"], r["tries"], r["reason"]) for r in report.collect()} == rows
    assert sum(r[1] for r in rows.values()) > 10 and any(r[4] for r in rows.values())


FLIGHT = Schema("flight", {"flight": "id", "airport": "code"}, [ForeignKey("flight", ("src",), "airport", ("code",)), ForeignKey("flight", ("dst",), "airport", ("code",))])
FLIGHT_KEYS = "child_table string, child_column string, parent_table string, name string"


def test_two_keys_to_one_table_are_two_structures(spark):
    fks = spark.createDataFrame([("flight", "src", "airport", None), ("flight", "dst", "airport", None)], FLIGHT_KEYS)
    rows = sorted((r["pattern"], tuple(r["tables"]), tuple(r["keys"])) for r in C.structures(fks, "flight").collect())
    assert rows == [("0", ("flight",), ()), ("1p", ("flight", "airport"), ("flight.dst",)), ("1p", ("flight", "airport"), ("flight.src",)), ("2i", ("flight", "airport", "airport"), ("flight.dst", "flight.src"))]
    named = spark.createDataFrame([("flight", "src", "airport", "both"), ("flight", "dst", "airport", "both")], FLIGHT_KEYS)
    assert [r["pattern"] for r in C.structures(named, "flight").collect()] == ["0", "1p"]


def test_joins_along_a_named_key(spark):
    tables = {"flight": spark.createDataFrame([(1, "A", "B"), (2, "B", "A"), (3, "A", None)], "id int, src string, dst string"), "airport": spark.createDataFrame([("A", 10), ("B", 20)], "code string, size int")}
    one = lambda key: sorted((r["id"], r["size_airport"]) for r in J.joined(tables, FLIGHT, ("flight", "airport"), False, keys=(key,)).collect())
    assert one("flight.src") == [(1, 10), (2, 20), (3, 10)] and one("flight.dst") == [(1, 20), (2, 10)]
    both = J.joined(tables, FLIGHT, ("flight", "airport", "airport"), True, keys=("flight.src", "flight.dst"))
    assert sorted((r["id"], r["size_airport"], r["size_airport__1"]) for r in both.collect()) == [(1, 10, 20), (2, 20, 10)]
    assert J.join_size(tables, FLIGHT, ("flight", "airport", "airport"), True, ("flight.src", "flight.dst")).first()["rows"] == 2
    with pytest.raises(ValueError, match="name one"):
        J.joined(tables, FLIGHT, ("flight", "airport"), False)
    spec = J.Spec(0, "2iE", ("flight", "airport", "airport"), True, (J.Predicate("airport", "size", "=", 10, "NUMERIC"), J.Predicate("airport__1", "size", "=", 20, "NUMERIC")), ("flight.src", "flight.dst"))
    c = duckdb.connect()
    for n, t in tables.items():
        c.register(n, t.toPandas())
    assert c.execute(J.render(spec, FLIGHT)).fetchall() == [(1,)] and [r["answer"] for r in J.answers(both, [spec], "id").collect()] == [1]


def test_generation_over_roles_and_odd_tables(spark):
    day = datetime.date(2020, 1, 1)
    flight = spark.createDataFrame([(i, "ABC"[i % 3], "ABCD"[i % 4], None if i % 7 == 0 else day, f"t{i % 5}") for i in range(40)], "id int, src string, dst string, day date, tag string")
    airport = spark.createDataFrame([(c, k, None) for k, c in enumerate("ABC")], "code string, size int, note string")
    filters = {"flight": [("day", "DATE"), ("tag", "ENUM")], "airport": [("size", "NUMERIC"), ("note", "LABEL")]}
    queries, report = G.generate({"flight": flight, "airport": airport}, FLIGHT, {"0E": 2, "0H": 1, "1pE": 3, "2iE": 2, "2iM": 1, "3pE": 1}, filters, 20, 3, 1)
    found = {r["strategy"]: (r["feasible"], r["accepted"], r["reason"]) for r in report.collect()}
    assert found["0H"] == (False, 0, "pattern_infeasible") and found["3pE"] == (False, 0, "pattern_infeasible")
    assert found["1pE"][1] == 3 and found["2iE"][1] == 2
    assert {len(r["sql"].split("JOIN")) for r in queries.filter("strategy = '2iE'").collect()} == {3}
    none, report = G.generate({"flight": flight.limit(0), "airport": airport}, FLIGHT, {"0E": 2, "1pE": 1}, filters)
    assert none.count() == 0 and {r["reason"] for r in report.collect()} == {"no_valid_values", "sparse_combinations"}
