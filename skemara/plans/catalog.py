"""Profiling, structure and conjunctive-query jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import epoch_date
from skemara.operators import catalog as P
from skemara.operators import cejsq as J
from skemara.operators import structures as C
from skemara.plans.derived import STATEMENTS_SQL, statements
from skemara.registry import query, table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SCHEMA = P.Schema("orders", {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": None}, [
    P.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), P.ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)), P.ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    P.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)), P.ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    P.ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)), P.ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
])
NATION = P.Schema("nation", SCHEMA.primary, SCHEMA.foreign)


def tables(spark: SparkSession, sf: str, names=NAMES) -> P.Tables:
    return P.lower_names({n: table(spark, sf, n) for n in names})


def key_rows(spark: SparkSession, schema: P.Schema = SCHEMA) -> DataFrame:
    return spark.createDataFrame([(f.child, f.columns[0], f.parent, f.parent_columns[0], f.coverage) for f in schema.foreign], "child_table string, child_column string, parent_table string, parent_column string, coverage double")


def types(spark: SparkSession, sf: str) -> DataFrame:
    return P.pinned(P.typed(P.profile(spark, tables(spark, sf))))


def found_keys(spark: SparkSession, sf: str, target: str, t: DataFrame | None = None) -> DataFrame:
    """Foreign keys that the rules find, as a small catalog; `t` are the types if they are there already."""
    t = types(spark, sf) if t is None else t
    return P.pinned(P.discover(tables(spark, sf), t, P.pinned(P.primary_keys(t)), target))


_COLS = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
         "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
         "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"}


#: Columns with fractions, which are no keys, and dates.
_FRACTIONS = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_orderdate", "l_shipdate"}
#: Columns whose samples both engines write as the same text.
_AS_TEXT = "key name segment brand type size priority status flag linenumber".split()


def _profile_sql(t: str, c: str, i: int) -> str:
    shown = f"concat_ws('|', least, second, third)" if any(c.endswith(x) for x in _AS_TEXT) else "CAST((least IS NOT NULL)::INT + (second IS NOT NULL)::INT + (third IS NOT NULL)::INT AS VARCHAR)"
    whole = "false" if c in _FRACTIONS else "n_distinct = n AND n_set = n"
    few = "CASE WHEN n_distinct <= 20 THEN n_distinct END" if any(c.endswith(x) for x in _AS_TEXT[1:-1]) and not c.endswith("size") else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS ordinal, n, n_set, {whole} AS "unique", {few} AS few, {shown} AS samples
FROM (SELECT count(*) AS n, count({c}) AS n_set, count(DISTINCT {c}) AS n_distinct, {", ".join(f"(SELECT v FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3) ORDER BY 1 LIMIT 1 OFFSET {k}) AS {w}" for k, w in enumerate(("least", "second", "third")))} FROM {t})"""


@query(" UNION ALL ".join(_profile_sql(t, c, i) for t, cs in _COLS.items() for i, c in enumerate(cs.split())))
def p1_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, uniqueness, few distinct values, and three distinct samples of every column; of numbers with a fraction and of dates the number of samples only."""
    p = P.profile(spark, tables(spark, sf), samples=True)
    unique = (F.col("n_distinct") == F.col("n")) & (F.col("n_set") == F.col("n")) & ~F.col("dtype").rlike("^(double|float|decimal|date|timestamp)")
    text = F.lower("column").rlike(f"({'|'.join(_AS_TEXT)})$")
    return p.select("table", "column", "ordinal", "n", "n_set", unique.alias("unique"), F.when((F.col("n_distinct") <= 20) & (F.col("dtype") == "string"), F.col("n_distinct")).alias("few"), F.when(text, F.array_join("samples", "|")).otherwise(F.size("samples").cast("string")).alias("samples"))


#: Columns of some tables with Spark's type names, from the catalogue of the engine that runs the SQL.
_CATALOG = """(SELECT table_name AS tab, column_name AS col, ordinal_position AS place, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS kind FROM information_schema.columns WHERE table_name IN (%s))"""


def _catalog(*names: str) -> str:
    return _CATALOG % ", ".join(f"'{n}'" for n in names)


def _semantic_sql(t: str, c: str) -> str:
    """A column's semantic type by its values: texts of few values are ENUM, other short ones LABEL."""
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", CASE WHEN typeof(any_value({c})) IN ('DATE', 'TIMESTAMP') THEN 'DATE' WHEN typeof(any_value({c})) <> 'VARCHAR' THEN 'NUMERIC' WHEN count(DISTINCT {c}) <= 20 AND avg(length(CAST({c} AS VARCHAR))) <= 50 THEN 'ENUM' WHEN avg(length(CAST({c} AS VARCHAR))) <= 50 THEN 'LABEL' ELSE 'TEXT' END AS semantic FROM {t}"""


def _key_sql(t: str) -> str:
    """A table's primary key: of the columns that are unique without nulls the first in the rule's order."""
    cols = [c for c in _COLS[t].split() if c not in _FRACTIONS]
    cols.sort(key=lambda c: (0 if c == "id" else 1 if c.endswith("key") else 2, 0 if t[:3] in c else 1))
    whens = " ".join(f"WHEN count(*) > 0 AND count(DISTINCT {c}) = count(*) THEN '{c}'" for c in cols)
    return f"SELECT '{t}' AS \"table\", CASE {whens} END AS primary_key FROM {t}"


@query(" UNION ALL ".join(map(_key_sql, _COLS)))
def p3_primary_keys(spark: SparkSession, sf: str) -> DataFrame:
    return P.primary_keys(types(spark, sf))


def _loose_sql(t: str) -> str:
    cols = _COLS[t].split()
    whens = " ".join(f"WHEN count(DISTINCT {c}) = count(*) AND count({c}) = count(*) THEN '{c}'" for c in cols if c.endswith(("_id", "key")))
    return f"SELECT '{t}' AS \"table\", CASE {whens} ELSE '{cols[0]}' END AS primary_key FROM {t}"


@query(" UNION ALL ".join(map(_loose_sql, _COLS)))
def p2_loose_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The looser key rule of the enriched profile."""
    return P.loose_keys(types(spark, sf))


@query("SELECT avg(CASE WHEN c_custkey IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON o_custkey = c_custkey")
def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return P.coverage(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey")


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
_OVERLAP = " UNION ALL ".join(f"SELECT '{a}' AS child_table, '{b}' AS child_column, '{c}' AS parent_table, '{d}' AS parent_column, count(p.v) / count(*) AS coverage FROM (SELECT DISTINCT {b} AS v FROM {a}) c LEFT JOIN (SELECT DISTINCT {d} AS v FROM {c}) p ON c.v = p.v" for a, b, c, d in _FKS)


@query(_OVERLAP)
def p5_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return found_keys(spark, sf, "orders")


@query("SELECT * FROM (SELECT 'customer' AS parent_table, count(p.v) / count(*) AS coverage, count(*) AS child_distinct, (SELECT count(DISTINCT c_custkey) FROM customer) AS parent_distinct FROM (SELECT DISTINCT p_size AS v FROM part) c LEFT JOIN (SELECT DISTINCT c_custkey AS v FROM customer) p ON c.v = p.v)")
def p7_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A column that values alone would take for a key."""
    return P.overlap(tables(spark, sf), [("part", "p_size")], [("customer", "c_custkey")]).select("parent_table", "coverage", "child_distinct", "parent_distinct")


_RIVALS = [("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "region", "r_regionkey"), ("customer", "c_nationkey", "customer", "c_custkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_custkey", "part", "p_partkey"), ("orders", "o_custkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_suppkey", "part", "p_partkey")]
_RIVALS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS child_table, '{b}' AS child_column, '{c}' AS parent_table, (SELECT avg(CASE WHEN p.v IS NULL THEN 0.0 ELSE 1.0 END) FROM (SELECT DISTINCT {b} AS v FROM {a}) c LEFT JOIN (SELECT DISTINCT {d} AS v FROM {c}) p ON c.v = p.v) AS coverage" for a, b, c, d in _RIVALS)


@query(f"""WITH r AS ({_RIVALS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY child_table, child_column ORDER BY CASE WHEN parent_table = 'orders' THEN 0 ELSE 1 END, coverage DESC, parent_table) AS k FROM r WHERE coverage > 0)
SELECT child_table, child_column, parent_table, round(coverage, 9) AS coverage FROM k WHERE k = 1""")
def p8_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Rival parents of some columns, with the coverages that the tables show; one parent each."""
    found = P.overlap(tables(spark, sf), sorted({(a, b) for a, b, _, _ in _RIVALS}), sorted({(c, d) for _, _, c, d in _RIVALS}))
    rivals = spark.createDataFrame(_RIVALS, "child_table string, child_column string, parent_table string, parent_column string")
    met = found.join(rivals, ["child_table", "child_column", "parent_table", "parent_column"]).withColumn("priority", F.lit(0))
    return P.resolve(met, "orders").select("child_table", "child_column", "parent_table", F.round("coverage", 9).alias("coverage"))


@query("SELECT * FROM (VALUES ('error', 'missing column orders.o_lost'), ('error', 'low coverage of orders.o_lost'), ('warning', '3 isolated tables')) AS v(severity, message) WHERE (SELECT count(*) FROM orders) > 0")
def p10_issues(spark: SparkSession, sf: str) -> DataFrame:
    t = P.profile(spark, tables(spark, sf, ("region", "nation", "part", "orders", "customer")))
    fks = spark.createDataFrame([("orders", "o_custkey", "customer", "c_custkey", 1.0), ("orders", "o_lost", "customer", "c_custkey", 0.2)], "child_table string, child_column string, parent_table string, parent_column string, coverage double")
    return P.issues(t, fks)


_SEM = {"r_name": "ENUM", "n_name": "LABEL", "c_mktsegment": "ENUM", "c_acctbal": "NUMERIC", "p_size": "NUMERIC", "p_type": "ENUM", "p_brand": "LABEL", "p_name": "LABEL", "o_orderstatus": "ENUM", "o_totalprice": "NUMERIC", "o_orderdate": "DATE", "o_orderpriority": "ENUM", "l_shipdate": "DATE", "l_returnflag": "BOOLEAN_OR_ENUM"}


_HOME = {"r": "region", "n": "nation", "c": "customer", "p": "part", "o": "orders", "l": "lineitem"}


@query(f"SELECT \"column\", CASE \"column\" WHEN 'l_returnflag' THEN 'BOOLEAN_OR_ENUM' ELSE semantic END AS semantic FROM ({' UNION ALL '.join(_semantic_sql(_HOME[c[0]], c) for c in _SEM)})")
def p12_semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    t = types(spark, sf).filter(F.col("column").isin(*_SEM))
    return t.select("column", F.when(F.col("column") == "l_returnflag", "BOOLEAN_OR_ENUM").otherwise(F.col("semantic")).alias("semantic"))


@query(f"SELECT * REPLACE (CASE \"column\" WHEN 'o_totalprice' THEN 'LABEL' ELSE semantic END AS semantic) FROM ({' UNION ALL '.join(_semantic_sql('orders', c) for c in _COLS['orders'].split())}) WHERE \"column\" NOT IN (SELECT primary_key FROM ({_key_sql('orders')})) AND \"column\" NOT IN ({', '.join(repr(b) for a, b, _, _ in _FKS if a == 'orders')}) AND semantic <> 'TEXT'")
def p13_p14_filterable(spark: SparkSession, sf: str) -> DataFrame:
    over = spark.createDataFrame([("orders", "o_totalprice", "LABEL"), ("orders", "o_orderdate", "NONSENSE")], "table string, column string, semantic string")
    t = P.typed(P.profile(spark, tables(spark, sf, ("orders",))), over)
    return P.filterable(t, P.primary_keys(t), key_rows(spark)).select("table", "column", "semantic")


@query(f"SELECT col AS \"column\", CASE WHEN regexp_matches(col, '(^|_)id$|key$|number$') THEN 'id' WHEN regexp_matches(col, 'name|title') THEN 'name' WHEN kind IN ('date', 'timestamp') OR regexp_matches(col, 'date|time') THEN 'date' WHEN regexp_matches(col, 'status|state|flag') THEN 'status' ELSE 'other' END AS role FROM {_catalog('orders')}")
def p15_roles(spark: SparkSession, sf: str) -> DataFrame:
    return P.roles(P.typed(P.profile(spark, tables(spark, sf, ("orders",))))).select("column", "role")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE trim(c_mktsegment) <> '' ORDER BY 1 LIMIT 5")
def p16_enum_samples(spark: SparkSession, sf: str) -> DataFrame:
    return P.enum_samples(table(spark, sf, "customer"), "c_mktsegment")


_DBS = "(SELECT DISTINCT c_nationkey AS db_id, child_table, parent_table FROM customer, (VALUES ('lineitem', 'orders', 0), ('orders', 'customer', 1), ('customer', 'nation', 2), ('supplier', 'nation', 3), ('nation', 'region', 4)) AS e(child_table, parent_table, k) WHERE (c_nationkey + k) % 3 > 0)"


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A schema per nation: which of five keys it has follows from its number."""
    e = F.explode(F.array(*(F.struct(F.lit(a).alias("child_table"), F.lit(b).alias("parent_table"), F.lit(k).alias("k")) for k, (a, b) in enumerate((("lineitem", "orders"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"))))))
    dbs = table(spark, sf, "customer").select(F.col("c_nationkey").alias("db_id")).distinct()
    fks = dbs.withColumn("e", e).filter((F.col("db_id") + F.col("e.k")) % 3 > 0).select("db_id", "e.child_table", "e.parent_table")
    return fks, dbs.withColumn("table", F.explode(F.array(*(F.lit(t) for t in NAMES))))


@query(f"WITH d AS (SELECT db_id, parent_table AS t, count(DISTINCT child_table) AS d FROM {_DBS} GROUP BY ALL) SELECT db_id, arg_max(t, (d, t)) AS hub, max(d) AS hub_in FROM d GROUP BY db_id")
def p17_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return P.topology(*corpus(spark, sf)).select("db_id", "hub", "hub_in")


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_DBS}), p AS (SELECT db_id, [child_table, parent_table] AS p FROM e UNION ALL SELECT p.db_id, list_append(p, parent_table) FROM p JOIN e ON e.db_id = p.db_id AND child_table = p[-1] WHERE NOT list_contains(p, parent_table))
SELECT db_id, CAST(max(len(p) - 1) AS INT) AS depth FROM p GROUP BY db_id""")
def p18_depth(spark: SparkSession, sf: str) -> DataFrame:
    return P.topology(*corpus(spark, sf)).filter("depth > 0").select("db_id", "depth")


_TOPOLOGY = f"""e AS (SELECT * FROM {_DBS}), p AS (SELECT db_id, [child_table, parent_table] AS p FROM e UNION ALL SELECT p.db_id, list_append(p, parent_table) FROM p JOIN e ON e.db_id = p.db_id AND child_table = p[-1] WHERE NOT list_contains(p, parent_table)),
depth AS (SELECT db_id, CAST(max(len(p) - 1) AS INT) AS depth FROM p GROUP BY db_id), degree AS (SELECT db_id, parent_table AS t, count(DISTINCT child_table) AS d FROM e GROUP BY ALL),
hub AS (SELECT db_id, arg_max(t, (d, t)) AS hub, max(d) AS hub_in FROM degree GROUP BY db_id), arms AS (SELECT db_id, child_table AS hub, count(DISTINCT parent_table) AS hub_out FROM e GROUP BY ALL),
s AS (SELECT a.db_id, h.hub, coalesce(hub_in, 0) AS hub_in, coalesce(hub_out, 0) AS hub_out, coalesce(depth, 0) AS depth FROM (SELECT DISTINCT c_nationkey AS db_id FROM customer) a LEFT JOIN hub h USING (db_id) LEFT JOIN arms o ON o.db_id = a.db_id AND o.hub = h.hub LEFT JOIN depth d ON d.db_id = a.db_id),
t AS (SELECT *, CASE WHEN depth = 0 THEN 'no_fk' WHEN hub_in >= 2 THEN 'intersection' ELSE 'path_only' END AS schema_type, CASE WHEN depth = 0 THEN 'flat' WHEN hub_in >= 2 AND depth >= 2 THEN 'snowflake' WHEN hub_in >= 2 THEN 'star' ELSE 'chain' END AS archetype, hub_out = 0 AS pure_endpoint,
  list_concat(['0'], list_concat(list_transform(range(1, least(depth, 3) + 1), lambda i: i || 'p'), CASE WHEN hub_in >= 2 THEN list_transform(range(2, least(hub_in, 4) + 1), lambda i: i || 'i') ELSE [] END)) AS patterns FROM s)"""


@query(f"WITH RECURSIVE {_TOPOLOGY} SELECT * EXCLUDE (patterns), array_to_string(patterns, ',') AS patterns FROM t")
def p19_p22_topology(spark: SparkSession, sf: str) -> DataFrame:
    return P.topology(*corpus(spark, sf)).withColumn("patterns", F.array_join("patterns", ","))


@query(f"""WITH RECURSIVE {_TOPOLOGY} SELECT 'schema_type' AS measure, schema_type AS key, count(*) AS n FROM t GROUP BY schema_type UNION ALL SELECT 'archetype', archetype, count(*) FROM t GROUP BY archetype
UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), count(*) FROM t GROUP BY depth UNION ALL SELECT 'hub_in', CAST(hub_in AS VARCHAR), count(*) FROM t GROUP BY hub_in
UNION ALL SELECT 'pattern', x, count(*) FROM (SELECT unnest(patterns) AS x FROM t) GROUP BY x UNION ALL SELECT 'pure_endpoint', 'hub', count(*) FROM t WHERE pure_endpoint AND hub IS NOT NULL""")
def p21_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    return P.corpus_report(P.topology(*corpus(spark, sf)))


@query("SELECT arg_max(t, (s, t)) AS target FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) * (SELECT count(*) FROM {_catalog(t)}) AS s FROM {t}" for t in NAMES) + ")")
def p23_fallback_target(spark: SparkSession, sf: str) -> DataFrame:
    return P.fallback_target(P.profile(spark, tables(spark, sf)))


@query(f"WITH k AS (SELECT * FROM ({_OVERLAP}) WHERE coverage >= 0.9) SELECT parent_table AS \"table\", 'outgoing' AS direction FROM k WHERE child_table = 'orders' UNION SELECT child_table, 'incoming' FROM k WHERE parent_table = 'orders'")
def p11_p24_related(spark: SparkSession, sf: str) -> DataFrame:
    return P.related(found_keys(spark, sf, "orders"), "orders")


@query(f"SELECT tab AS \"table\", tab || '(' || string_agg(col || ' ' || kind, ', ' ORDER BY place) || ')' AS text FROM {_catalog('region', 'nation')} GROUP BY tab")
def p25_schema_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.schema_text(P.profile(spark, tables(spark, sf, ("region", "nation"))))


_KNOWN = (("sales", "orders"), ("sales", "customer"), ("geo", "nation"), ("geo", "region"), ("geo", "supplier"), ("goods", "part"))


@query(f"""WITH k AS (SELECT * FROM (VALUES {', '.join(map(str, _KNOWN))}) AS v(db_id, t)), w AS (SELECT DISTINCT sql_id, unnest(regexp_extract_all(lower(sql), '[a-z_][a-z0-9_]*')) AS t FROM {STATEMENTS_SQL}),
c AS (SELECT sql_id, k.db_id, count(*) AS c FROM w JOIN k USING (t) GROUP BY ALL) SELECT sql_id, arg_min(db_id, (-c, db_id)) AS db_id FROM c GROUP BY sql_id""")
def p27_infer_database(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame(list(_KNOWN), "db_id string, table string")
    return P.infer_database(statements(spark, sf).drop("db_id"), known, "sql_id", "sql")


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def p28_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", epoch_date(F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/"))).alias("day"))


def _structures_sql(target: str) -> str:
    """SQL of the structures from a target, over the keys whose coverage holds: relations chain, star and found (pattern, t)."""
    return f"""fk AS (SELECT child_table AS c, parent_table AS p FROM ({_OVERLAP}) WHERE coverage >= 0.9), move AS (SELECT DISTINCT c AS a, p AS b FROM fk UNION ALL SELECT DISTINCT p, c FROM fk WHERE p NOT IN (SELECT c FROM fk)),
chain AS (SELECT ['{target}'] AS t UNION ALL SELECT list_append(t, b) FROM chain JOIN move ON a = t[-1] WHERE len(t) <= 3 AND NOT list_contains(t, b)),
dim AS (SELECT DISTINCT CASE WHEN c = '{target}' THEN p ELSE c END AS d FROM fk WHERE '{target}' IN (c, p)), star AS (SELECT ['{target}'] AS t UNION ALL SELECT list_append(t, d) FROM star JOIN dim ON len(t) = 1 OR d > t[-1] WHERE len(t) <= 4),
found AS (SELECT '0' AS pattern, ['{target}'] AS t UNION ALL SELECT (len(t) - 1) || 'p', t FROM chain WHERE len(t) > 1 UNION ALL SELECT (len(t) - 1) || 'i', t FROM star WHERE len(t) > 2)"""


@query(f"WITH RECURSIVE {_structures_sql('orders')} SELECT (len(t) - 1) || 'p' AS pattern, array_to_string(t, '/') AS path FROM chain WHERE len(t) > 1")
def c1_chains(spark: SparkSession, sf: str) -> DataFrame:
    return C.chains(found_keys(spark, sf, "orders"), "orders").select("pattern", F.array_join("tables", "/").alias("path"))


@query(f"WITH RECURSIVE {_structures_sql('nation')} SELECT (len(t) - 1) || 'i' AS pattern, array_to_string(t, '/') AS path FROM star WHERE len(t) > 2")
def c2_stars(spark: SparkSession, sf: str) -> DataFrame:
    return C.stars(found_keys(spark, sf, "nation"), "nation").select("pattern", F.array_join("tables", "/").alias("path"))


def _filterable_sql(t: str) -> str:
    """How many columns of a table predicates may use: numbers, dates and short texts that are neither a foreign key nor the primary key."""
    foreign = {b for a, b, _, _ in _FKS if a == t}
    cols = [c for c in _COLS[t].split() if c not in foreign]
    number = lambda c: c in _FRACTIONS or c.endswith(("key", "size", "linenumber"))
    each = " + ".join("1" if number(c) else f"(avg(length({c})) <= 50)::INT" for c in cols)
    return f"SELECT '{t}' AS tab, {each} - (SELECT (coalesce(primary_key, '') IN ({', '.join(repr(c) for c in cols)}))::INT FROM ({_key_sql(t)})) AS n FROM {t}"


@query(f"""WITH RECURSIVE {_structures_sql('orders')}, f AS ({' UNION ALL '.join(map(_filterable_sql, _COLS))}), s AS (SELECT pattern, t, sum(n) AS n FROM (SELECT pattern, t, unnest(t) AS tab FROM found) LEFT JOIN f USING (tab) GROUP BY pattern, t),
b AS (SELECT pattern, CAST(max(n) AS BIGINT) AS columns FROM s GROUP BY pattern) SELECT pattern || tier AS strategy, pattern, tier, columns FROM b, (VALUES ('E', 1), ('M', 3), ('H', 6)) AS x(tier, least) WHERE columns >= least""")
def c3_feasible(spark: SparkSession, sf: str) -> DataFrame:
    t = types(spark, sf)
    keys = P.pinned(P.primary_keys(t))
    fks = P.pinned(P.discover(tables(spark, sf), t, keys, "orders"))
    return C.feasible(P.pinned(C.structures(fks, "orders")), P.filterable(t, keys, fks))


@query(f"""WITH RECURSIVE {_structures_sql('nation').replace("move AS (SELECT DISTINCT c AS a, p AS b FROM fk UNION ALL SELECT DISTINCT p, c FROM fk WHERE p NOT IN (SELECT c FROM fk))", "move AS (SELECT DISTINCT c AS a, p AS b FROM fk UNION SELECT p, c FROM fk)")},
n AS (SELECT {sum(len(c.split()) for c in _COLS.values()) - 1} * (count(*) > 0)::INT AS n FROM orders), w AS (SELECT * FROM (VALUES ('2iE', '2i', 1), ('4iE', '4i', 1), ('2pM', '2p', 3), ('9zE', NULL, 0)) AS v(strategy, pattern, least)),
r AS (SELECT strategy, CASE WHEN w.pattern IS NULL THEN 'unknown class' WHEN w.pattern NOT IN (SELECT pattern FROM found) THEN CASE WHEN w.pattern LIKE '%i' THEN 'too few related tables' ELSE 'no chain of this length' END WHEN n < least THEN 'too few columns' END AS reason FROM w, n) SELECT strategy, reason IS NULL AS supported, reason FROM r""")
def c5_c6_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    t = types(spark, sf)
    able = C.capabilities(found_keys(spark, sf, "nation", t), t.filter("column <> 'o_orderkey'"), "nation")
    return C.check_wanted(spark.createDataFrame([("2iE",), ("4iE",), ("2pM",), ("9zE",)], "strategy string"), able)


@query(f"""WITH RECURSIVE {_structures_sql('nation')}, k AS (SELECT pattern, array_to_string(t, '/') AS path, row_number() OVER (PARTITION BY pattern ORDER BY array_to_string(t, '/')) - 1 AS k, count(*) OVER (PARTITION BY pattern) AS n FROM found)
SELECT pattern, CAST(attempt AS INT) AS attempt, path FROM k JOIN range(6) AS a(attempt) ON attempt % n = k""")
def c4_c7_picks(spark: SparkSession, sf: str) -> DataFrame:
    found = P.pinned(C.structures(found_keys(spark, sf, "nation"), "nation"))
    return C.pick(found, 6, round_robin=True).select("pattern", "attempt", F.array_join("tables", "/").alias("path"))


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1_chain_join(spark: SparkSession, sf: str) -> DataFrame:
    frame = J.joined(tables(spark, sf), SCHEMA, ("orders", "customer", "nation", "region"), False)
    return frame.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey_customer").alias("s"))


@query("SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def j2_star_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.join_sizes(tables(spark, sf), NATION, ("nation", "customer", "supplier"), True, ["n_nationkey"])


@query("SELECT count(*) AS n FROM conversations a JOIN (SELECT conv_id, turn, count(*) AS c FROM conversations GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def j3_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    counts = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("c"))
    schema = P.Schema("turns", {"turns": "text"}, [P.ForeignKey("turns", ("conv_id", "turn"), "counts", ("conv_id", "turn"))])
    return J.joined({"turns": turns, "counts": counts}, schema, ("turns", "counts"), False).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_custkey // 2 = b.c_custkey")
def j4_self_join(spark: SparkSession, sf: str) -> DataFrame:
    tree = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 2").alias("boss"))
    schema = P.Schema("tree", {"tree": "id"}, [P.ForeignKey("tree", ("boss",), "tree", ("id",))])
    return J.joined({"tree": tree}, schema, ("tree", "tree"), False).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'chain' AS kind, count(*) AS rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'star', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey")
def j5_join_size(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    a = J.join_size(t, SCHEMA, ("orders", "lineitem"), False).withColumn("kind", F.lit("chain"))
    return a.unionByName(J.join_size(t, NATION, ("nation", "customer", "supplier"), True).withColumn("kind", F.lit("star")))


FILTERS = {"orders": [("o_orderstatus", "ENUM"), ("o_totalprice", "NUMERIC"), ("o_orderdate", "DATE"), ("o_orderpriority", "ENUM")], "customer": [("c_acctbal", "NUMERIC"), ("c_mktsegment", "ENUM"), ("c_name", "LABEL")], "nation": [("n_name", "LABEL")]}
PATH = ("orders", "customer", "nation")


def chain_specs(spark: SparkSession, sf: str, strategy: str = "2pM", count: int = 60) -> tuple[DataFrame, list[J.Spec]]:
    """Queries anchored on orders of the joined frame of orders, customer and nation."""
    wanted = {t: [c for c, _ in cs] for t, cs in FILTERS.items()}
    frame = J.joined(tables(spark, sf, PATH), SCHEMA, PATH, False, wanted)
    return frame, J.anchored_specs(frame, SCHEMA, strategy, PATH, False, FILTERS, count)


@query()
def f3_a1_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of sixty anchored queries, all in one pass; the anchors are among them."""
    frame, specs = chain_specs(spark, sf)
    return J.answers(frame, specs, "o_orderkey")


@query(name="flagship")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Synthesise queries over orders, customer and nation, answer them, and report each with its text and outcome."""
    frame, specs = chain_specs(spark, sf, "2pE", 40)
    texts = spark.createDataFrame([(s.number, J.render(s, SCHEMA)) for s in specs], "spec int, sql string")
    return J.outcomes(specs, J.answers(frame, specs, "o_orderkey"), 15).join(texts, "spec")


_ONE = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE"


@query(f"SELECT 0 AS spec, o_orderkey AS answer {_ONE} c_mktsegment = 'BUILDING' AND o_totalprice >= 400000.0 UNION SELECT 1, o_orderkey {_ONE} contains(lower(c_name), '00001') AND o_orderstatus = 'F' UNION SELECT 2, o_orderkey {_ONE} n_nationkey > 20 AND c_acctbal < 0.0")
def f1_f2_predicates(spark: SparkSession, sf: str) -> DataFrame:
    p = J.Predicate
    specs = [J.Spec(0, "2pE", PATH, False, (p("customer", "c_mktsegment", "=", "BUILDING", "ENUM"), p("orders", "o_totalprice", ">=", 400000.0, "NUMERIC"))),
             J.Spec(1, "2pE", PATH, False, (p("customer", "c_name", "LIKE", "00001", "COMMA_SEPARATED"), p("orders", "o_orderstatus", "=", "F", "ENUM"))),
             J.Spec(2, "2pE", PATH, False, (p("nation", "n_nationkey", ">", 20, "NUMERIC"), p("customer", "c_acctbal", "<", 0.0, "NUMERIC")))]
    return J.answers(J.joined(tables(spark, sf, PATH), SCHEMA, PATH, False), specs, "o_orderkey")


@query("SELECT s AS strategy, 60 AS specs, 0 AS out_of_range, 0 AS wrong_operator, 0 AS lost FROM (VALUES ('2pE'), ('2pM')) AS v(s) WHERE (SELECT count(*) FROM orders) >= 60")
def f4_f6_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Of sixty anchored queries of two classes: those with too few or too many predicates, with an operator that the type does not have, without an answer."""
    rows = []
    for strategy in ("2pE", "2pM"):
        frame, specs = chain_specs(spark, sf, strategy)
        low, high = C.TIER_RANGE[strategy[-1]]
        found = {r.spec for r in J.answers(frame, specs, "o_orderkey").select("spec").distinct().collect()}
        rows.append((strategy, len(specs), sum(not low <= len(s.predicates) <= high for s in specs), sum(p.op not in J.OPERATORS[p.kind] for s in specs for p in s.predicates), sum(s.number not in found for s in specs)))
    return spark.createDataFrame(rows, "strategy string, specs int, out_of_range int, wrong_operator int, lost int")


@query("SELECT 40 AS specs, 0 AS wrong_operator, 0 AS unknown_value WHERE (SELECT count(*) FROM orders) > 0")
def f5_random_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Of forty random queries: predicates whose operator the type does not have (numbers have strict ones too), and whose value the column does not have."""
    samples, specs = random_baseline(spark, sf)
    known = {(t, c): set(values) for t, cs in samples.items() for c, _, values in cs}
    ops = lambda p: (*J.OPERATORS[p.kind], ">", "<") if p.kind == "NUMERIC" else J.OPERATORS[p.kind]
    preds = [p for s in specs for p in s.predicates]
    return spark.createDataFrame([(len(specs), sum(p.op not in ops(p) for p in preds), sum(p.value not in known[p.alias, p.column] for p in preds))], "specs int, wrong_operator int, unknown_value int")


@query()
def a2_v4_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    frame, specs = chain_specs(spark, sf, "2pE", 60)
    return J.outcomes(specs, J.answers(frame, specs, "o_orderkey"), 15)


@query("SELECT 0 AS wrong WHERE (SELECT count(*) FROM orders) > 0")
def v1_gold_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between the batch's answers and twelve statements run by their text: none."""
    frame, specs = chain_specs(spark, sf, "2pM", 12)
    stored = J.answers(frame, specs, "o_orderkey")
    t = tables(spark, sf, PATH)
    return J.gold_gate(spark, t, specs, SCHEMA, stored).agg(F.count(F.lit(1)).cast("int").alias("wrong"))


RANDOM = P.Schema("orders", SCHEMA.primary, [f for f in SCHEMA.foreign if "lineitem" not in (f.child, f.parent)])


def random_baseline(spark: SparkSession, sf: str) -> tuple[dict, list[J.Spec]]:
    """Values that some columns have, and forty random queries on them."""
    t = tables(spark, sf)
    kinds = {"orders": FILTERS["orders"][:2], "customer": FILTERS["customer"][:2]}
    samples = {n: [(c, k, [r[0] for r in t[n].select(c).distinct().orderBy(c).limit(20).collect()]) for c, k in cs] for n, cs in kinds.items()}
    return samples, J.random_specs(RANDOM, samples, 40)


@query()
def b1_random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    t, (_, specs) = tables(spark, sf), random_baseline(spark, sf)
    alone = [s for s in specs if len(s.tables) == 1]
    both = [s for s in specs if len(s.tables) == 2]
    found = J.answers(J.joined(t, RANDOM, ("orders",), False), alone, "o_orderkey").unionByName(J.answers(J.joined(t, RANDOM, ("orders", "customer"), True), both, "o_orderkey"))
    return found.groupBy("spec").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT \"table\", coalesce(primary_key, (SELECT arg_min(col, (CASE WHEN col IN ('id', 'uid', 'uuid', 'key', 'code') THEN 0 WHEN regexp_matches(col, '_id$|key$') THEN 1 ELSE 2 END, place)) FROM {_catalog(t)})) AS id_column FROM ({_key_sql(t)})" for t in ("region", "nation", "orders", "lineitem")))
def p2_p26_id_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = P.pinned(P.typed(P.profile(spark, tables(spark, sf, ("region", "nation", "orders", "lineitem")))))
    return P.id_columns(t, P.primary_keys(t))


_STEMS = "list_filter(list_distinct([regexp_replace(lower({c}), '_?(id|key|fk)$', ''), regexp_replace(regexp_replace(lower({c}), '_?(id|key|fk)$', ''), '^[a-z]{{1,2}}_', '')]), lambda x: x <> '')"


@query(f"""WITH k AS ({' UNION ALL '.join(map(_key_sql, _COLS))}), c AS (SELECT tab AS child_table, col AS child_column, unnest({_STEMS.format(c='col')}) AS s FROM {_catalog(*NAMES)} WHERE regexp_matches(lower(col), '(id|key|fk)$')),
p AS (SELECT "table" AS parent_table, primary_key, unnest(list_distinct(list_append({_STEMS.format(c='primary_key')}, "table"))) AS n FROM k WHERE primary_key IS NOT NULL)
SELECT DISTINCT child_table, child_column, parent_table FROM c JOIN p ON (child_table, child_column) <> (parent_table, primary_key) AND (s = n OR s || 's' = n OR starts_with(n, s) OR (starts_with(s, n) AND length(n) >= 3))
WHERE (child_table, child_column) NOT IN (SELECT "table", primary_key FROM k WHERE primary_key IS NOT NULL)""")
def p6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = types(spark, sf)
    own = P.primary_keys(t).select(F.col("table").alias("child_table"), F.col("primary_key").alias("child_column"))
    return P.candidate_parents(t, P.pinned(P.primary_keys(t))).join(own, ["child_table", "child_column"], "left_anti").select("child_table", "child_column", "parent_table")


@query(f"SELECT child_table, child_column FROM ({_OVERLAP}) WHERE child_table = 'orders' AND coverage >= 0.9")
def p9_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """External verdicts take the place of the rules."""
    t = P.pinned(P.typed(P.profile(spark, tables(spark, sf, ("orders", "customer")))))
    said = key_rows(spark).filter("child_table = 'orders'")
    return P.discover(tables(spark, sf, ("orders", "customer")), t, P.primary_keys(t), "orders", said).select("child_table", "child_column")


@query("SELECT 'orders/customer' AS path WHERE (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) <= (SELECT 2 * count(*) FROM orders)")
def j6_guard(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    most = 2 * t["orders"].count()
    kept = J.small_enough(t, SCHEMA, [(("orders", "customer"), False), (("orders", "lineitem", "part", ), False)], most)
    return spark.createDataFrame([("/".join(names),) for names, _ in kept], "path string")


@query("SELECT spec, 'orders,customer,nation' AS tables FROM range(10) AS g(spec)")
def v3_v5_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Ten anchored queries whose text resolves, with the tables that they touch."""
    _, specs = chain_specs(spark, sf, "2pE", 10)
    for n in PATH:
        tables(spark, sf, PATH)[n].createOrReplaceTempView(n)
    good = [s for s in specs if J.resolves(spark, J.render(s, SCHEMA)) is None]
    return spark.createDataFrame([(s.number, ",".join(J.involved(s)[0])) for s in good], "spec long, tables string")


@query()
def v6_reasons(spark: SparkSession, sf: str) -> DataFrame:
    frame, specs = chain_specs(spark, sf, "2pE", 60)
    more = J.anchored_specs(frame, SCHEMA, "2pM", PATH, False, FILTERS, 60, first=60, seed=1)
    return J.primary_reason(J.outcomes(specs + more, J.answers(frame, specs + more, "o_orderkey"), 15))


@query("SELECT 'a' AS uid, 'too_many' AS status, 16 AS n UNION ALL SELECT 'b', 'error', 0 UNION ALL SELECT 'c', 'empty', 0 UNION ALL SELECT 'd', 'ok', (SELECT count(*) FROM region)")
def b2_supplied_statements(spark: SparkSession, sf: str) -> DataFrame:
    for n in ("orders", "region"):
        table(spark, sf, n).createOrReplaceTempView(n)
    return J.execute_pairs(spark, [("a", "SELECT o_orderkey FROM orders"), ("b", "SELECT lost FROM orders"), ("c", "SELECT o_orderkey FROM orders WHERE o_orderkey < 0"), ("d", "SELECT r_regionkey FROM region")], 15)


_LEVEL = "20000 * n_nationkey"


@query(f"""WITH a AS (SELECT n_nationkey, n_name, s FROM nation, (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus IS NOT NULL)),
h AS (SELECT n_nationkey AS k, o_orderstatus AS s, count(DISTINCT o_orderkey) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= {_LEVEL} GROUP BY ALL)
SELECT n_name || '/' || a.s AS uid, CASE WHEN c IS NULL THEN 'empty' WHEN c <= 100 THEN 'ok' ELSE 'too_many' END AS status, least(coalesce(c, 0), 101) AS n FROM a LEFT JOIN h ON h.k = n_nationkey AND h.s = a.s
UNION ALL SELECT n_name || '/cheapest', 'error', 0 FROM nation""")
def b2_statements_by_structure(spark: SparkSession, sf: str) -> DataFrame:
    """A supplied statement per nation and order status, answered in one pass, and one per nation with an aggregate in its condition, which is an error."""
    t = tables(spark, sf, PATH)
    for n in PATH:
        t[n].createOrReplaceTempView(n)
    # Nations times states of an order: the statements, not the rows that they are about.
    asked = t["nation"].crossJoin(F.broadcast(t["orders"].select("o_orderstatus").filter("o_orderstatus IS NOT NULL").distinct())).select("n_nationkey", "n_name", "o_orderstatus").collect()
    read = "SELECT o.o_orderkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE"
    pairs = [(f"{r.n_name}/{r.o_orderstatus}", f"{read} n.n_nationkey = {r.n_nationkey} AND o.o_orderstatus = {J.literal(r.o_orderstatus)} AND o.o_totalprice >= {20000 * r.n_nationkey}") for r in asked]
    pairs += [(f"{name}/cheapest", f"{read} n.n_name = {J.literal(name)} AND o.o_totalprice = min(o.o_totalprice)") for name in dict.fromkeys(r.n_name for r in asked)]
    return J.execute_pairs(spark, pairs, 100)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'id' || c_custkey ELSE 'no' || c_custkey END AS row_id FROM customer")
def m18_result_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Row identifiers by the priority of field names."""
    from skemara.operators.metrics import result_id

    c = table(spark, sf, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("id"), F.col("c_custkey").cast("string"))).alias("row_id"), F.concat(F.lit("no"), F.col("c_custkey").cast("string")).alias("a_number"), F.lit("x").alias("other"))
    return rows.select("c_custkey", result_id(rows.drop("c_custkey")).alias("row_id"))
