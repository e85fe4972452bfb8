"""Quota, sampling, split and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import mix_sql, name_seed, normal_id, sql_uid, text_number_sql
from skemara.operators import quota as Q
from skemara.operators.classify import alias_pairs, predicates, tables_of
from skemara.plans.derived import PATTERNS, RECORDS_SQL, STATEMENTS_SQL, TIERS, records, statements
from skemara.registry import oracle_of, query, table

_ORDINAL = " ".join(f"WHEN '{p}{t}' THEN {i * 3 + j}" for i, p in enumerate(PATTERNS) for j, t in enumerate(TIERS))
_CLASSES = f"(SELECT strategy, any_value(tier) AS tier, CAST(CASE strategy {_ORDINAL} END AS INT) AS ordinal, count(*) AS n, count(*) >= 20 AS feasible FROM {RECORDS_SQL} GROUP BY strategy)"


def classes(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("strategy").agg(F.first("tier").alias("tier"), F.count(F.lit(1)).alias("n")).withColumns({"ordinal": F.expr(f"CAST(CASE strategy {_ORDINAL} END AS INT)"), "feasible": F.col("n") >= 20})


_TIER_W = "(VALUES ('E', 1.0), ('M', 2.0), ('H', 1.0)) AS tw(tier, tw)"
_WEIGHTS = f"w AS (SELECT strategy, tier, ordinal, n, w / sum(w) OVER () AS weight FROM (SELECT c.*, tw::DOUBLE / count(*) OVER (PARTITION BY c.tier) AS w FROM {_CLASSES} c JOIN {_TIER_W} ON tw.tier = c.tier WHERE feasible))"
_QUOTA = """b AS (SELECT *, CAST(floor(round_even(weight * 997, 9)) AS BIGINT) AS base, round_even(round_even(weight * 997, 9) - floor(round_even(weight * 997, 9)), 9) AS frac FROM w),
q AS (SELECT strategy, tier, ordinal, weight, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, ordinal) <= 997 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return Q.class_weights(classes(spark, sf), tier_weights=spark.createDataFrame([("E", 1.0), ("M", 2.0), ("H", 1.0)], "tier string, weight double"))


@query(f"WITH {_WEIGHTS} SELECT strategy, weight FROM w")
def q1_weights(spark: SparkSession, sf: str) -> DataFrame:
    return weights(spark, sf).select("strategy", "weight")


@query(f"WITH {_WEIGHTS}, {_QUOTA} SELECT strategy, quota FROM q")
def q2_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return Q.largest_remainder(weights(spark, sf), 997).select("strategy", "quota")


@query(f"""WITH {_WEIGHTS}, z AS (SELECT strategy, sum(weight) OVER (ORDER BY ordinal) - weight AS low, sum(weight) OVER (ORDER BY ordinal) AS high, row_number() OVER (ORDER BY ordinal DESC) AS r FROM w),
u AS (SELECT i AS draw, {mix_sql('i')} / 2147483647.0::DOUBLE AS u FROM range(500) AS g(i)) SELECT draw, strategy FROM u JOIN z ON u >= low AND (u < high OR r = 1)""")
def q3_draws(spark: SparkSession, sf: str) -> DataFrame:
    return Q.draw_classes(weights(spark, sf), 500)


_ATTEMPTS = f"(SELECT strategy, uid * 10 + ascii(model) % 10 AS attempt, CASE WHEN status <> 'ok' THEN 'validation' WHEN correct THEN 'ok' WHEN row_f1 < 0.4 THEN 'no_results' ELSE 'too_many' END AS outcome FROM {RECORDS_SQL})"
_SMALL = "q AS (SELECT strategy, ordinal, greatest(5, 40 - ordinal) AS quota FROM " + _CLASSES + ")"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("status") != "ok", "validation").when(F.col("correct"), "ok").when(F.col("row_f1") < 0.4, "no_results").otherwise("too_many")
    return records(spark, sf).select("strategy", (F.col("uid") * 10 + F.ascii("model") % 10).alias("attempt"), outcome.alias("outcome"))


def small_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return classes(spark, sf).select("strategy", F.greatest(F.lit(5), 40 - F.col("ordinal")).alias("quota"))


@query(f"WITH {_SMALL}, a AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY attempt) AS k FROM {_ATTEMPTS} WHERE outcome = 'ok') SELECT strategy, attempt FROM a JOIN q USING (strategy) WHERE k <= quota")
def q4_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return Q.accept(attempts(spark, sf), small_quotas(spark, sf)).select("strategy", "attempt")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY sql ORDER BY sql_id) AS k FROM (SELECT sql_id, sql, 'Which  ' || db_id || ' has ' || CAST(sql_id % 200 AS VARCHAR) || '??' AS question FROM {STATEMENTS_SQL})),
b AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sql_id) AS j FROM a WHERE k = 1) SELECT sql_id, question FROM b WHERE j = 1""")
def q5_distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).select("sql_id", "sql", F.concat(F.lit("Which  "), "db_id", F.lit(" has "), (F.col("sql_id") % 200).cast("string"), F.lit("??")).alias("question"))
    return Q.distinct_pairs(s, "sql_id").select("sql_id", "question")


_SHORT = f"""{_SMALL}, p AS (SELECT strategy, sum((outcome = 'ok')::INT) AS ok, count(*) AS attempts FROM {_ATTEMPTS} GROUP BY strategy),
y AS (SELECT strategy, arg_min(outcome, (-c, outcome)) AS reason FROM (SELECT strategy, outcome, count(*) AS c FROM {_ATTEMPTS} WHERE outcome <> 'ok' GROUP BY ALL) GROUP BY strategy),
s AS (SELECT q.strategy, CAST(quota AS INT) AS quota, attempts, CAST(least(ok, quota) AS BIGINT) AS accepted, CAST(quota - least(ok, quota) AS BIGINT) AS shortfall, least(ok, quota) / quota AS fulfilment, CASE WHEN ok < quota THEN reason END AS reason FROM q LEFT JOIN p USING (strategy) LEFT JOIN y USING (strategy))"""


@query(f"WITH {_SHORT} SELECT * FROM s")
def q6_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    return Q.shortfall(attempts(spark, sf), small_quotas(spark, sf))


@query(f"""WITH {_SHORT}, t AS (SELECT right(strategy, 1) AS tier, * FROM s), yy AS (SELECT tier, arg_min(reason, (-c, reason)) AS top_reason FROM (SELECT tier, reason, sum(shortfall) AS c FROM t WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY tier)
SELECT t.tier, CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(shortfall) AS BIGINT) AS shortfall, sum(accepted) / sum(quota) AS fulfilment, any_value(top_reason) AS top_reason FROM t LEFT JOIN yy ON yy.tier = t.tier GROUP BY t.tier""")
def q7_reports(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.shortfall(attempts(spark, sf), small_quotas(spark, sf)).withColumn("tier", F.expr("right(strategy, 1)"))
    return Q.aggregate_reports(rows, "tier")


@query(f"WITH c AS (SELECT db_id, strategy, count(*) AS c FROM {RECORDS_SQL} GROUP BY ALL), p AS (SELECT db_id, c / sum(c) OVER (PARTITION BY db_id) AS p FROM c) SELECT db_id, sum(-p * ln(p)) / ln(21) AS entropy, count(*) AS populated FROM p GROUP BY db_id")
def q8_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return Q.entropy_by(records(spark, sf), "db_id", "strategy", 21)


@query(f"WITH c AS (SELECT db_id, strategy AS k, count(*) AS c FROM {RECORDS_SQL} GROUP BY ALL) SELECT db_id, string_agg(k || ':' || CAST(c AS VARCHAR), '; ' ORDER BY c DESC, k) AS text, arg_min(k, (-c, k)) AS top FROM c GROUP BY db_id")
def q9_counter_text(spark: SparkSession, sf: str) -> DataFrame:
    return Q.counter_text(records(spark, sf), "db_id", "strategy")


@query(f"WITH {_SHORT} SELECT CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(shortfall) AS BIGINT) AS shortfall, sum(accepted) / sum(quota) AS fulfilment, (SELECT arg_min(reason, (-c, reason)) FROM (SELECT reason, sum(shortfall) AS c FROM s WHERE reason IS NOT NULL GROUP BY reason)) AS top_reason FROM s")
def q10_run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return Q.aggregate_reports(Q.shortfall(attempts(spark, sf), small_quotas(spark, sf)))


_QUESTIONS = f"(SELECT uid, strategy, pattern, tier, db_id FROM {RECORDS_SQL} WHERE model = 'ash')"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter("model = 'ash'").select("uid", "strategy", "pattern", "tier", "db_id")


@query(f"WITH r AS (SELECT uid, strategy, count(*) OVER (PARTITION BY strategy) AS n, row_number() OVER (PARTITION BY strategy ORDER BY {mix_sql('uid')}, uid) AS k FROM {_QUESTIONS}) SELECT uid, CASE WHEN k <= floor(n * 0.1) THEN 'test' WHEN k <= floor(n * 0.1) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r")
def q11_split(spark: SparkSession, sf: str) -> DataFrame:
    return Q.stratified_split(questions(spark, sf), "strategy", "uid", 0.2, 0.1).select("uid", "split")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY {mix_sql('uid')}, uid) AS k FROM {_QUESTIONS}), p AS (SELECT *, row_number() OVER (ORDER BY k, strategy) AS place FROM r) SELECT uid, place FROM p WHERE place <= 100")
def q12_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return Q.round_robin(questions(spark, sf), "strategy", "uid", 100).select("uid", "place")


@query(f"""WITH f AS (SELECT * FROM {_QUESTIONS} WHERE uid IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY tier, strategy ORDER BY {mix_sql('uid')}, uid) AS k FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY k, strategy) AS place FROM r) SELECT uid, tier FROM p WHERE place <= CASE tier WHEN 'E' THEN 22 WHEN 'M' THEN 22 ELSE 27 END""")
def q13_tier_targets(spark: SparkSession, sf: str) -> DataFrame:
    pool = questions(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("uid")), "uid", "left_semi")
    parts = [Q.round_robin(pool.filter(F.col("tier") == t), "strategy", "uid", n).select("uid", "tier") for t, n in (("E", 22), ("M", 22), ("H", 27))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY {mix_sql('uid')}, uid) AS k FROM {_QUESTIONS}) SELECT uid, strategy FROM r WHERE k <= 100 // 21")
def q14_even_cap(spark: SparkSession, sf: str) -> DataFrame:
    return Q.even_cap(questions(spark, sf), "strategy", "uid", 100, 21).select("uid", "strategy")


@query(f"""WITH a AS (SELECT * FROM {_QUESTIONS} WHERE pattern = '0'), w AS (SELECT db_id, count(*) AS want FROM a GROUP BY db_id), r AS (SELECT b.uid, b.db_id, want, row_number() OVER (PARTITION BY b.db_id ORDER BY {mix_sql('b.uid')}, b.uid) AS k FROM {_QUESTIONS} b JOIN w USING (db_id) WHERE b.pattern <> '0')
SELECT db_id, substr(sha1('control:' || db_id || ':' || CAST(uid AS VARCHAR)), 1, 16) AS uid FROM r WHERE k <= want""")
def q15_matched_control(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    return Q.matched_control(q.filter("pattern = '0'"), q.filter("pattern <> '0'"), "db_id", "uid").select("db_id", "uid")


@query(f"""WITH p AS (SELECT uid, tier FROM {_QUESTIONS}), d AS (SELECT * FROM (VALUES ('E', 0.5), ('M', 0.25), ('H', 0.25)) AS v(tier, share)), h AS (SELECT tier, count(*) AS have FROM p GROUP BY tier),
n AS (SELECT floor(min(have / share::DOUBLE)) AS n FROM d JOIN h USING (tier)), t AS (SELECT tier, floor(round_even(share::DOUBLE * n, 6)) AS take FROM d, n),
r AS (SELECT rep, uid, tier, row_number() OVER (PARTITION BY rep, tier ORDER BY {mix_sql('uid', 0, 'rep')}, uid) AS k FROM p, (SELECT unnest(range(4)) AS rep)) SELECT CAST(rep AS INT) AS rep, uid, r.tier FROM r JOIN t ON t.tier = r.tier WHERE k <= take""")
def q16_quota_matched(spark: SparkSession, sf: str) -> DataFrame:
    demand = spark.createDataFrame([("E", 0.5), ("M", 0.25), ("H", 0.25)], "tier string, share double")
    return Q.quota_matched(questions(spark, sf), demand, "tier", "uid", 4)


@query(f"SELECT sql_id, substr(sha256(sql), 1, 16) AS uid, sha1(sql) AS s1, md5(sql) AS m5 FROM {STATEMENTS_SQL}")
def q17_digests(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("sql_id", sql_uid(F.col("sql")).alias("uid"), F.sha1("sql").alias("s1"), F.md5("sql").alias("m5"))


_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda i: i::BIGINT), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))"


@query(f"SELECT db_id, CAST(xor({_CRC.format(x=chr(39) + '42:' + chr(39) + ' || db_id')}, 4294967295::BIGINT) % 2147483648 AS BIGINT) AS seed FROM (SELECT DISTINCT db_id FROM {STATEMENTS_SQL})")
def q17_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return statements(spark, sf).select("db_id").distinct().select("db_id", name_seed(42, F.col("db_id")).alias("seed"))


@query(f"""WITH e AS (SELECT doc_id, list_filter([CASE WHEN trim(lang) = '' THEN 'empty_question' END, CASE WHEN n_chars % 17 = 0 THEN 'empty_answers' END, CASE WHEN n_chars % 17 > 15 THEN 'too_many_answers' END, CASE WHEN len(string_split(lang || ' a b ' || source, ' ')) < 5 THEN 'short_question' END, CASE WHEN doc_id % 3 > 0 THEN 'no_select' END], lambda x: x IS NOT NULL) AS e FROM documents)
SELECT doc_id, array_to_string(e, ',') AS errors FROM e""")
def q21_pair_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    errors = Q.pair_errors(F.concat_ws(" ", "lang", F.lit("a b"), "source"), F.col("n_chars") % 17, F.when(F.col("doc_id") % 3 == 0, "select 1").otherwise("drop"))
    return d.select("doc_id", F.array_join(errors, ",").alias("errors"))


@query(f"""WITH a AS (SELECT 0 AS f, sql, substr(sha256(sql), 1, 16) AS uid FROM {STATEMENTS_SQL} WHERE sql_id % 2 = 0 UNION ALL SELECT 1, sql, substr(sha256(sql), 1, 16) FROM {STATEMENTS_SQL} WHERE sql_id % 3 = 0) SELECT uid, any_value(sql) AS sql FROM a GROUP BY uid""")
def q22_merged(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).withColumn("uid", F.lit(None).cast("string"))
    return Q.merge_pairs([s.filter("sql_id % 2 = 0").select("sql", "uid"), s.filter("sql_id % 3 = 0").select("sql", "uid")]).select("uid", "sql")


@query(f"SELECT strategy, tier, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS valid FROM {RECORDS_SQL} GROUP BY CUBE (strategy, tier)")
def q23_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return Q.statistics(records(spark, sf).withColumn("is_valid", F.col("correct")))


@query(f"SELECT q.uid, coalesce(l.quality = 1 AND l.toxic = 0, false) AS is_valid FROM {_QUESTIONS} q LEFT JOIN labels l ON l.doc_id = q.uid")
def q24_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), (F.col("quality") == 1).alias("faithful"), (F.col("toxic") == 0).alias("coherent"))
    return Q.with_verdicts(questions(spark, sf), v).select("uid", "is_valid")


_LITERALS = "list_distinct(regexp_extract_all(regexp_replace(sql, '''[^'']*''', '', 'g'), '(?:^|[^A-Za-z0-9_.])(\\d+(?:\\.\\d+)?)', 1))"


@query(f"""WITH l AS (SELECT sql_id, {_LITERALS} AS x FROM {STATEMENTS_SQL}) SELECT sql_id, CASE sql_id % 4 WHEN 0 THEN false WHEN 1 THEN len(list_filter(x, lambda v: NOT contains('Find rows of 1995', v))) = 0 ELSE true END AS faithful FROM l""")
def q19_literal_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that have all literals, with thousands separators, that soften them, and that have others."""
    grouped = F.transform(Q.literals(F.col("sql")), lambda x: F.regexp_replace(x, r"(?<=\d)(?=(\d{3})+$)", ","))
    kind = F.col("sql_id") % 4
    question = F.when(kind == 1, F.lit("Find rows of 1,995")).otherwise(F.concat(F.lit("Find rows with "), F.array_join(grouped, " and "), F.when(kind == 0, " or about so").otherwise("")))
    return statements(spark, sf).select("sql_id", Q.faithful(question, F.col("sql")).alias("faithful"))


_PRED = "'([A-Za-z_][A-Za-z0-9_.]*) ?(>=|<=|<>|!=|=|>|<|(?i:like)) ?'"
_BODY = "regexp_extract(f, '(?i)\\bwhere\\b (.*?)(?: (?:group by|order by|having|limit|union|intersect|except)\\b|;|$)', 1)"


@query(f"""WITH a AS (SELECT sql_id, trim(regexp_replace(regexp_replace(sql, '''[^'']*''', '''''', 'g'), '\\s+', ' ', 'g')) AS f FROM {STATEMENTS_SQL}),
b AS (SELECT sql_id, list_transform(regexp_extract_all(f, '(?i)\\b(?:from|join) ([A-Za-z_][A-Za-z0-9_]*) as ([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x)) AS names, list_transform(regexp_extract_all(f, '(?i)\\b(?:from|join) ([A-Za-z_][A-Za-z0-9_]*) as ([A-Za-z_][A-Za-z0-9_]*)', 2), lambda x: lower(x)) AS marks,
  list_transform(list_zip(regexp_extract_all({_BODY}, {_PRED}, 1), regexp_extract_all({_BODY}, {_PRED}, 2)), lambda x: lower(x[1]) || ' ' || lower(x[2])) AS preds, lower(regexp_extract(f, '(?i)\\b(?:from|join|update|into) ([A-Za-z_][A-Za-z0-9_]*)', 1)) AS first FROM a),
c AS (SELECT sql_id, names, list_transform(preds, lambda p: names[list_position(marks, split_part(p, '.', 1))]) AS tested, 'List ' || coalesce(names[1], first) || ' where ' || array_to_string(preds, ' and ') AS question FROM b)
SELECT sql_id, question, array_to_string(list_sort(list_distinct(list_filter(names, lambda t: NOT list_contains(tested, t) AND NOT contains(lower(question), replace(t, '_', ' '))))), ',') AS silent FROM c""")
def q18_q20_questions(spark: SparkSession, sf: str) -> DataFrame:
    named = statements(spark, sf).withColumns({"pairs": alias_pairs(F.col("sql")), "preds": predicates(F.col("sql"))})
    joined = F.transform("pairs", lambda p: F.split_part(p, F.lit("="), F.lit(2)))
    tables = F.when(F.size("pairs") > 0, F.str_to_map(F.array_join("pairs", ","), F.lit(","), F.lit("=")))
    tested = F.array_distinct(F.transform("preds", lambda p: F.try_element_at(tables, F.split_part(p, F.lit("."), F.lit(1)))))
    question = F.concat(F.lit("List "), F.coalesce(F.get(joined, F.lit(0)), F.get(tables_of(F.col("sql")), F.lit(0))), F.lit(" where "), F.array_join("preds", " and "))
    return named.select("sql_id", question.alias("question"), F.array_join(F.array_sort(Q.silent_branches(joined, tested, question)), ",").alias("silent"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 7 = floor(l_quantity / 7) THEN CAST(CAST(l_quantity / 7 AS BIGINT) AS VARCHAR) ELSE printf('%.6f', round_even(l_quantity / 7, 6)) END AS id FROM lineitem")
def v2_normal_ids(spark: SparkSession, sf: str) -> DataFrame:
    x = normal_id(F.col("l_quantity") / 7)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.contains(x, F.lit(".")), F.format_string("%.6f", x.cast("double"))).otherwise(x).alias("id"))


# The same samples over identifiers that are texts, as stored questions have them.
_TEXT_QUESTIONS = f"(SELECT md5(CAST(uid AS VARCHAR)) AS uid, strategy, pattern, tier, db_id FROM {_QUESTIONS})"
_TEXT_NUMBER = text_number_sql("uid")


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).withColumn("uid", F.md5(F.col("uid").cast("string")))


def _text_sql(name: str) -> str:
    """A query's SQL over text identifiers."""
    out = oracle_of(name).replace("SELECT doc_id FROM labels", "SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels")
    for a, b in ((_QUESTIONS, _TEXT_QUESTIONS), (mix_sql("uid"), mix_sql(_TEXT_NUMBER)), (mix_sql("b.uid"), mix_sql(text_number_sql("b.uid"))), (mix_sql("uid", 0, "rep"), mix_sql(_TEXT_NUMBER, 0, "rep"))):
        out = out.replace(a, b)
    return out


@query(_text_sql("q11_split"))
def q11_split_text(spark: SparkSession, sf: str) -> DataFrame:
    return Q.stratified_split(text_questions(spark, sf), "strategy", "uid", 0.2, 0.1).select("uid", "split")


@query(_text_sql("q12_round_robin"))
def q12_round_robin_text(spark: SparkSession, sf: str) -> DataFrame:
    return Q.round_robin(text_questions(spark, sf), "strategy", "uid", 100).select("uid", "place")


@query(_text_sql("q13_tier_targets"))
def q13_tier_targets_text(spark: SparkSession, sf: str) -> DataFrame:
    pool = text_questions(spark, sf).join(table(spark, sf, "labels").select(F.md5(F.col("doc_id").cast("string")).alias("uid")), "uid", "left_semi")
    parts = [Q.round_robin(pool.filter(F.col("tier") == t), "strategy", "uid", n).select("uid", "tier") for t, n in (("E", 22), ("M", 22), ("H", 27))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_text_sql("q14_even_cap"))
def q14_even_cap_text(spark: SparkSession, sf: str) -> DataFrame:
    return Q.even_cap(text_questions(spark, sf), "strategy", "uid", 100, 21).select("uid", "strategy")


@query(_text_sql("q15_matched_control"))
def q15_matched_control_text(spark: SparkSession, sf: str) -> DataFrame:
    q = text_questions(spark, sf)
    return Q.matched_control(q.filter("pattern = '0'"), q.filter("pattern <> '0'"), "db_id", "uid").select("db_id", "uid")


@query(_text_sql("q16_quota_matched"))
def q16_quota_matched_text(spark: SparkSession, sf: str) -> DataFrame:
    demand = spark.createDataFrame([("E", 0.5), ("M", 0.25), ("H", 0.25)], "tier string, share double")
    return Q.quota_matched(text_questions(spark, sf), demand, "tier", "uid", 4)
