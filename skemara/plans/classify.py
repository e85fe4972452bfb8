"""Queries over a corpus of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.operators import classify as K
from skemara.operators.metrics import CLAUSES, components
from skemara.operators.quota import group_split
from skemara.plans.derived import RECORDS_SQL, STATEMENTS_SQL, records, statement_pairs, statements
from skemara.plans.metrics import clause_parts
from skemara.registry import query

_FLAT = "trim(regexp_replace(regexp_replace(sql, '''[^'']*''', '''''', 'g'), '\\s+', ' ', 'g'))"
_REASON = """CASE WHEN NOT regexp_matches(f, '(?i)^\\s*\\(*\\s*select\\b') THEN 'not_select' WHEN regexp_matches(f, '(?i)\\b(count|sum|avg|min|max)\\s*\\(') THEN 'aggregate' WHEN regexp_matches(f, '(?i)\\bhaving\\b') THEN 'having'
WHEN regexp_matches(f, '(?i)\\bgroup by\\b') THEN 'group_by' WHEN regexp_matches(f, '(?i)\\b(union|intersect|except)\\b') THEN 'set_op' WHEN regexp_matches(f, '(?i)\\(\\s*select\\b') THEN 'subquery'
WHEN regexp_matches(f, '(?i)\\bcross join\\b') THEN 'cross_join' WHEN regexp_matches(f, '(?i)\\bor\\b') THEN 'or_condition' END"""
_BODY = "regexp_extract(f, '(?i)\\bwhere\\b (.*?)(?: (?:group by|order by|having|limit|union|intersect|except)\\b|;|$)', 1)"
_D = f"""f AS (SELECT *, {_FLAT} AS f FROM {STATEMENTS_SQL}), d AS (SELECT sql_id, db_id, sql, f, {_REASON} AS reason, len(regexp_extract_all(f, '(?i)\\bjoin\\b'))::BIGINT AS joins,
CASE WHEN {_BODY} = '' THEN 0 ELSE len(regexp_extract_all({_BODY}, '(?i)\\band\\b')) + 1 END::BIGINT AS conditions, list_transform(regexp_extract_all(f, '(?i)\\b(?:from|join|update|into) ([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x)) AS tables FROM f),
e AS (SELECT *, reason IS NULL AS in_scope, CASE WHEN joins = 0 THEN '0' WHEN joins = 1 THEN '1p' WHEN joins = 2 THEN '2p_or_2i' WHEN joins = 3 THEN '3p_or_3i' WHEN joins = 4 THEN '4i_or_more' ELSE 'Xm' END AS pattern FROM d)"""


def described(spark: SparkSession, sf: str) -> DataFrame:
    return K.describe(statements(spark, sf))


@query(f"SELECT DISTINCT strategy, CASE regexp_extract(strategy, '^(.*)([EMH])$', 1) WHEN '0' THEN 0.0 WHEN '1p' THEN 1.0 WHEN '2p' THEN 2.0 WHEN '2i' THEN 2.0 WHEN '4i' THEN 4.0 ELSE 3.0 END::DOUBLE + CASE right(strategy, 1) WHEN 'E' THEN 0.0 WHEN 'M' THEN 0.3 ELSE 0.6 END::DOUBLE AS score FROM {RECORDS_SQL}")
def k2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("strategy").distinct().withColumn("score", K.score(F.col("strategy")))


@query(f"WITH s AS (SELECT uid, model, CASE pattern WHEN '0' THEN 0.0 WHEN '1p' THEN 1.0 WHEN '2p' THEN 2.0 WHEN '2i' THEN 2.0 WHEN '4i' THEN 4.0 ELSE 3.0 END + CASE tier WHEN 'E' THEN 0.0 WHEN 'M' THEN 0.3 ELSE 0.6 END AS s FROM {RECORDS_SQL}) SELECT CASE WHEN s < 1 THEN 'easy' WHEN s < 2 THEN 'medium' WHEN s < 3 THEN 'hard' ELSE 'expert' END AS tier, count(*) AS n FROM s GROUP BY 1")
def k3_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy(K.tier_name(K.score(F.col("strategy"))).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS (SELECT unnest(['0', '1p', '2p', '3p', '2i', '3i', '4i']) AS p), t AS (SELECT unnest(['E', 'M', 'H']) AS t), c AS (SELECT strategy, count(*) AS n FROM {RECORDS_SQL} GROUP BY strategy) SELECT p || t AS strategy, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'OK' ELSE 'MISSING' END AS state FROM p, t LEFT JOIN c ON c.strategy = p || t")
def k4_k16_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """All 21 codes against the classes that a set has."""
    codes = spark.range(1).select(F.explode(F.array(*(F.lit(p + t) for p in K.PATTERNS for t in K.TIERS))).alias("strategy"))
    n = records(spark, sf).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return codes.join(n, "strategy", "left").fillna(0, ["n"]).withColumn("state", F.when(F.col("n") > 0, "OK").otherwise("MISSING"))


@query(f"WITH {_D} SELECT sql_id, reason, conditions, joins, pattern FROM e")
def k5_k6_k7_described(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).select("sql_id", "reason", "conditions", "joins", "pattern")


@query(f"WITH {_D} SELECT db_id, count(*) AS n, CAST(sum(in_scope::INT) AS BIGINT) AS in_scope, avg(in_scope::INT) AS share FROM e GROUP BY db_id")
def k8_coverage_by_db(spark: SparkSession, sf: str) -> DataFrame:
    return K.coverage(described(spark, sf), "db_id")


@query(f"WITH {_D} SELECT coalesce(reason, 'in_scope') AS reason, pattern, count(*) AS n FROM e GROUP BY 1, 2")
def k8_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).groupBy(F.coalesce("reason", F.lit("in_scope")).alias("reason"), "pattern").agg(F.count(F.lit(1)).alias("n"))


_EDGES = (("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"))
_SHAPE = f"""g AS (SELECT * FROM (VALUES {', '.join(map(str, _EDGES))}) AS v(child, parent)), u AS (SELECT DISTINCT sql_id, unnest(tables) AS t FROM e),
p AS (SELECT c.sql_id, g.parent, count(DISTINCT g.child) AS d FROM u c JOIN g ON g.child = c.t JOIN u p ON p.sql_id = c.sql_id AND p.t = g.parent GROUP BY ALL), m AS (SELECT sql_id, max(d) AS d FROM p GROUP BY sql_id),
h AS (SELECT e.sql_id, CASE WHEN joins = 0 THEN '0' WHEN d > 4 THEN 'Xm' WHEN d >= 2 THEN d || 'i' WHEN d IS NULL THEN 'unknown' WHEN joins > 3 THEN 'Xm' ELSE joins || 'p' END AS shape FROM e LEFT JOIN m ON m.sql_id = e.sql_id)"""


def edges(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(_EDGES), "child string, parent string"))


@query(f"WITH {_D}, {_SHAPE} SELECT * FROM h")
def k9_join_shape(spark: SparkSession, sf: str) -> DataFrame:
    return K.join_shape(described(spark, sf), edges(spark))


@query(f"WITH {_D}, {_SHAPE} SELECT count(*) AS n, CAST(sum((shape <> 'unknown')::INT) AS BIGINT) AS precise, CAST(sum((shape = 'unknown')::INT) AS BIGINT) AS unknown FROM h")
def k10_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return K.resolution(K.join_shape(described(spark, sf), edges(spark)))


@query(f"WITH {_D} SELECT sql_id, array_to_string(tables, ',') AS tables, array_to_string(list_transform(regexp_extract_all({_BODY}, '([A-Za-z_][A-Za-z0-9_.]*) ?(?:>=|<=|<>|!=|=|>|<)', 1), lambda x: lower(x)), ',') AS columns FROM e WHERE in_scope")
def k11_parsed(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf).filter("in_scope")
    return d.select("sql_id", F.array_join("tables", ",").alias("tables"), F.array_join(F.transform(K.predicates(F.col("sql")), lambda p: F.split_part(p, F.lit(" "), F.lit(1))), ",").alias("columns"))


@query(f"WITH {_D} SELECT sql_id, 'pattern ' || pattern || ' | tables ' || array_to_string(tables, ' -> ') || ' | predicates ' || conditions || ' | select ' || regexp_extract(lower(f), 'select (.*?) from', 1) AS chain FROM e WHERE in_scope")
def k12_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf).filter("in_scope")
    return d.select("sql_id", K.reasoning(F.col("pattern"), F.col("tables"), F.col("conditions"), K.select_columns(F.col("sql"))).alias("chain"))


@query(f"""WITH {_D}, g AS (SELECT DISTINCT db_id FROM e WHERE in_scope), r AS (SELECT db_id, row_number() OVER (ORDER BY md5('7:' || db_id), db_id) AS r, count(*) OVER () AS n FROM g)
SELECT sql_id, db_id, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM e JOIN r USING (db_id) WHERE in_scope""")
def k13_group_split(spark: SparkSession, sf: str) -> DataFrame:
    return group_split(described(spark, sf).filter("in_scope"), "db_id", 0.2, 7).select("sql_id", "db_id", "split")


@query(f"""WITH f AS (SELECT sql_id, {_FLAT} AS f FROM {STATEMENTS_SQL}) SELECT sql_id, len(regexp_extract_all(regexp_replace(f, '\\([^()]*\\)', '', 'g'), '(?i)\\bjoin\\b'))::BIGINT AS joins, regexp_matches(f, '(?i)\\(\\s*select\\b') AS subquery,
regexp_matches(f, '(?i)\\bor\\b') AS has_or, regexp_matches(f, '(?i)\\b(count|sum|avg|min|max)\\s*\\(') AS aggregate, regexp_matches(f, '(?i)\\bgroup by\\b') AS group_by FROM f""")
def k14_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("sql_id", K.decompose(F.col("sql")).alias("d")).select("sql_id", "d.joins", "d.subquery", "d.has_or", "d.aggregate", "d.group_by")


@query(f"WITH {_D}, {_SHAPE} SELECT shape, count(*) AS n, CAST(min(h.sql_id) AS BIGINT) AS first_id FROM h JOIN e USING (sql_id) WHERE in_scope GROUP BY shape")
def k15_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf).filter("in_scope")
    return K.join_shape(d, edges(spark)).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("sql_id").alias("first_id"))


@query(f"WITH {_D}, u AS (SELECT DISTINCT db_id, sql, reason FROM e) SELECT count(*) AS n, avg((reason IS NULL)::INT) AS in_scope, count(DISTINCT reason) AS reasons FROM u")
def k17_suite(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf).dropDuplicates(["db_id", "sql"])
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("in_scope").cast("int")).alias("in_scope"), F.countDistinct("reason").alias("reasons"))


@query(f"WITH {_D} SELECT count(DISTINCT t) AS tables, count(DISTINCT db_id) AS dbs FROM (SELECT db_id, unnest(tables) AS t FROM e)")
def k18_flat_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).select("db_id", F.explode("tables").alias("t")).agg(F.countDistinct("t").alias("tables"), F.countDistinct("db_id").alias("dbs"))


_PARTS = ", ".join(f"array_to_string(list_sort({clause_parts('sql', c)}), ' ; ') AS {c.replace(' ', '_')}" for c in CLAUSES)


@query(f"SELECT sql_id, {_PARTS} FROM {STATEMENTS_SQL}")
def k19_clauses(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf)
    return s.select("sql_id", *(F.array_join(F.array_sort(v), " ; ").alias(k.replace(" ", "_")) for k, v in components(F.col("sql")).items()))


_MIXED = f"(SELECT a.sql_id, a.sql AS gold, b.sql AS pred FROM {STATEMENTS_SQL} a JOIN {STATEMENTS_SQL} b ON b.sql_id = a.sql_id + [0, 14, 1][a.sql_id % 3 + 1])"


def _taken(x: str) -> str:
    """SQL columns of one side: its tables, columns and operators of its conditions, literals, all sorted."""
    flat = _FLAT.replace("(sql,", f"({x},")
    body = _BODY.replace("(f,", f"({flat},")
    pattern = "'([A-Za-z_][A-Za-z0-9_.]*) ?(>=|<=|<>|!=|=|>|<|(?i:like)) ?'"
    found = {
        "t": f"list_transform(regexp_extract_all({flat}, '(?i)\\b(?:from|join|update|into) ([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x))",
        "c": f"list_transform(regexp_extract_all({body}, {pattern}, 1), lambda x: regexp_replace(lower(x), '^\\w+\\.', ''))",
        "o": f"list_transform(list_zip(regexp_extract_all({body}, {pattern}, 1), regexp_extract_all({body}, {pattern}, 2)), lambda x: regexp_replace(lower(x[1]), '^\\w+\\.', '') || ' ' || lower(x[2]))",
        "v": f"regexp_extract_all(regexp_replace({x}, '\\s+', ' ', 'g'), '(?:>=|<=|<>|!=|=|>|<) ?(''[^'']*''|\\d+(?:\\.\\d+)?)', 1)",
    }
    return ", ".join(f"list_sort({v}) AS {x[0]}{k}" for k, v in found.items())


@query(f"""WITH x AS (SELECT sql_id, {_taken('gold')}, {_taken('pred')} FROM {_MIXED}) SELECT sql_id, CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN 'other' WHEN gt <> pt THEN 'join_path' WHEN len(po) < len(go) THEN 'missing_predicate' WHEN len(po) > len(go) THEN 'extra_predicate'
WHEN gc <> pc THEN 'other' WHEN go <> po THEN 'operator' WHEN gv <> pv THEN 'value' ELSE 'other' END AS category FROM x""")
def k20_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Of all statements, each against itself, the next of its shape or one of another shape."""
    step = F.element_at(F.array(F.lit(0), F.lit(14), F.lit(1)), (F.col("sql_id") % 3 + 1).cast("int"))
    return K.failures(statement_pairs(spark, sf, step), "gold", "pred").select("sql_id", "category")


@query(f"WITH {_D} SELECT sql_id, CASE WHEN n >= 3 OR (rich AND n >= 2) THEN 'complex' WHEN n = 2 OR rich THEN 'medium' ELSE 'simple' END AS complexity FROM (SELECT sql_id, len(list_distinct(tables)) AS n, regexp_matches(f, '(?i)\\b(group by|having|union|intersect|except)\\b|\\(\\s*select\\b|\\b(count|sum|avg|min|max)\\s*\\(') AS rich FROM e)")
def k21_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("sql_id", K.complexity(F.col("sql")).alias("complexity"))


@query(f"WITH {_D}, u AS (SELECT DISTINCT sql_id, unnest(tables) AS name FROM e) SELECT sql_id, name, 'part_list' AS suggestion FROM u WHERE name = 'part'")
def k22_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(t,) for t in ("orders", "customer", "nation", "region", "supplier", "part_list")], "table string")
    return K.unknown_identifiers(statements(spark, sf), known)


_LIST = f"list_filter(list_transform(string_split(lower(regexp_extract({_FLAT.replace('(sql,', '(body,')}, '(?i)\\bselect (?:distinct )?(.*?) from\\b', 1)), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH r AS (SELECT sql_id, CASE WHEN sql_id % 3 = 1 AND NOT regexp_matches(sql, '(?i)\\bselect\\b') THEN '' ELSE sql END AS body FROM {STATEMENTS_SQL}), c AS (SELECT sql_id, body, {_LIST} AS cols FROM r)
SELECT sql_id, body, len(list_filter(cols, lambda x: x = 'o_orderkey' OR x LIKE '%.o_orderkey' OR x = '*')) > 0 AS has_id,
CASE WHEN has_id THEN body ELSE regexp_replace(body, '(?i)^\\s*select (distinct )?', 'SELECT \\1o_orderkey, ') END AS with_id,
array_to_string(list_transform(string_split(body, ''''), lambda x, i: CASE WHEN i % 2 = 1 THEN lower(x) ELSE x END), '''') AS lowered FROM c""")
def k23_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with every statement, fenced, bare, or with a parenthesis left open; the statement, with its id column, and in lower case."""
    kind, sql = F.col("sql_id") % 3, F.col("sql")
    fenced = lambda x: F.concat(F.lit("Here it is:\n```sql\n"), x, F.lit(";\n```\nDone."))
    reply = F.when(kind == 0, fenced(sql)).when(kind == 1, F.concat(F.lit("The answer is "), sql, F.lit(" ;; "))).otherwise(fenced(F.regexp_replace(sql, r"\)$", "")))
    s = statements(spark, sf).select("sql_id", K.clean_reply(reply).alias("body"))
    there = F.exists(K.select_columns(F.col("body")), lambda c: (c == "o_orderkey") | c.endswith(".o_orderkey") | (c == "*"))
    return s.select("sql_id", "body", there.alias("has_id"), K.ensure_id(F.col("body"), "o_orderkey").alias("with_id"), K.lower_identifiers(F.col("body")).alias("lowered"))


@query(f"SELECT uid, model, strategy FROM {RECORDS_SQL}")
def k1_plan_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of a plan of each record's shape, from its paths and number of predicates."""
    hops, star = F.substring("pattern", 1, 1).cast("int"), F.col("pattern").endswith("i")
    chain = F.array(F.concat(F.array(F.lit("t")), F.when(hops == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(hops, F.lit(1))), lambda i: i.cast("string")))))
    arms = F.transform(F.sequence(F.lit(1), F.greatest(hops, F.lit(1))), lambda i: F.array(F.lit("t"), i.cast("string")))
    filters = F.when(F.col("tier") == "E", 1 + F.col("uid") % 2).when(F.col("tier") == "M", 3 + F.col("uid") % 3).otherwise(6 + F.col("uid") % 3)
    return records(spark, sf).select("uid", "model", K.plan_code(F.when(star, arms).otherwise(chain), star, filters).alias("strategy"))
