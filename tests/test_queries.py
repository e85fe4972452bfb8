"""Every query that has SQL gives the same rows as DuckDB does; the synthesised queries are run one by one."""

import collections
import glob
import math
import os

import duckdb
import pytest

from skemara import registry
from skemara.operators import cejsq
from skemara.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return str(v) if isinstance(v, bool) else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()]) == ordered(want)


def run_alone(duck, specs, schema=catalog.SCHEMA):
    """{number: answers} of each query, run on its own by another engine from its text."""
    return {s.number: sorted(r[0] for r in duck.execute(cejsq.render(s, schema)).fetchall()) for s in specs}


def outcome(spec, n):
    return "validation" if cejsq.code_of(spec) != spec.strategy else "no_results" if not n else "too_many" if n > 15 else "ok"


def test_answers_are_those_of_each_query(spark, sf_dir, duck):
    _, specs = catalog.chain_specs(spark, sf_dir)
    want = run_alone(duck, specs)
    assert len(specs) == 60 and all(want.values())  # an anchor is an answer
    got = registry.queries()["f3_a1_answers"](spark, sf_dir).collect()
    assert sorted((r.spec, r.answer) for r in got) == sorted((k, a) for k, v in want.items() for a in v)


@pytest.mark.parametrize("name, count", [("flagship", 40), ("a2_v4_outcomes", 60)])
def test_outcomes(spark, sf_dir, duck, name, count):
    _, specs = catalog.chain_specs(spark, sf_dir, "2pE", count)
    want = run_alone(duck, specs)
    got = {r.spec: r for r in registry.queries()[name](spark, sf_dir).collect()}
    assert {k: (r.strategy, r.n, r.outcome) for k, r in got.items()} == {s.number: (s.strategy, len(want[s.number]), outcome(s, len(want[s.number]))) for s in specs}
    if name == "flagship":
        assert {k: r.sql for k, r in got.items()} == {s.number: cejsq.render(s, catalog.SCHEMA) for s in specs}


def test_reasons(spark, sf_dir, duck):
    frame, specs = catalog.chain_specs(spark, sf_dir, "2pE", 60)
    specs += cejsq.anchored_specs(frame, catalog.SCHEMA, "2pM", catalog.PATH, False, catalog.FILTERS, 60, first=60, seed=1)
    want, causes = run_alone(duck, specs), collections.defaultdict(collections.Counter)
    for s in specs:
        causes[s.strategy][outcome(s, len(want[s.number]))] += 1
    found = {k: (sum(v.values()), min((x for x in v if x != "ok"), key=lambda x: (-v[x], x), default=None)) for k, v in causes.items()}
    assert {r.strategy: (r.attempts, r.reason) for r in registry.queries()["v6_reasons"](spark, sf_dir).collect()} == found


def test_random_baseline(spark, sf_dir, duck):
    samples, specs = catalog.random_baseline(spark, sf_dir)
    assert {c: [r[0] for r in duck.execute(f"SELECT DISTINCT {c} FROM {t} ORDER BY 1 LIMIT 20").fetchall()] for t, cs in samples.items() for c, _, _ in cs} == {c: v for cs in samples.values() for c, _, v in cs}
    want = {k: len(v) for k, v in run_alone(duck, [s for s in specs if len(s.tables) < 3], catalog.RANDOM).items() if v}
    assert {r.spec: r.n for r in registry.queries()["b1_random_baseline"](spark, sf_dir).collect()} == want
    assert {"f3_a1_answers", "flagship", "a2_v4_outcomes", "v6_reasons", "b1_random_baseline"} == set(registry.queries()) - set(registry.oracle_sql())
