"""Scoring queries over gold and predicted result rows derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import mix_sql
from skemara.operators import metrics as M
from skemara.plans.derived import RECORDS_SQL, STATEMENTS_SQL, records, statement_pairs
from skemara.registry import query, table

# A question per customer: gold are its orders' priorities; the prediction loses, doubles and adds some.
_RESULT = f"""(SELECT o_custkey AS uid, 'gold' AS side, o_orderpriority AS "row" FROM orders UNION ALL
SELECT o_custkey, 'pred', CASE WHEN {mix_sql('o_orderkey', 21)} % 10 = 0 THEN 'other' ELSE o_orderpriority END FROM orders WHERE {mix_sql('o_orderkey', 22)} % 12 > 0 UNION ALL
SELECT o_custkey, 'pred', o_orderpriority FROM orders WHERE {mix_sql('o_orderkey', 23)} % 15 = 0)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT * FROM " + _RESULT.replace('"row"', "row").replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=table(spark, sf, "orders"))


_SIDES = f"""s AS (SELECT uid, "row", sum((side = 'gold')::INT) AS g, sum((side = 'pred')::INT) AS p FROM {_RESULT} GROUP BY uid, "row")"""


@query(f"WITH {_SIDES} SELECT uid, max(CASE WHEN (g > 0) = (p > 0) THEN 0 ELSE 1 END) = 0 AS correct FROM s GROUP BY uid")
def m1_set_match(spark: SparkSession, sf: str) -> DataFrame:
    return M.set_match(results(spark, sf))


@query(f"WITH {_SIDES} SELECT uid, max(CASE WHEN g = p THEN 0 ELSE 1 END) = 0 AS correct FROM s GROUP BY uid")
def m2_multiset_match(spark: SparkSession, sf: str) -> DataFrame:
    return M.multiset_match(results(spark, sf))


@query(f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY uid, side ORDER BY "row") AS place FROM {_RESULT}),
s AS (SELECT uid, place, "row", sum((side = 'gold')::INT) AS g, sum((side = 'pred')::INT) AS p FROM q GROUP BY uid, place, "row")
SELECT uid, max(CASE WHEN g = p THEN 0 ELSE 1 END) = 0 AS correct FROM s GROUP BY uid""")
def m2_ordered_match(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    placed = results(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("uid", "side").orderBy("row")))
    return M.ordered_match(placed)


def _f1_sql(least: str, g: str, p: str) -> str:
    return f"""h AS (SELECT uid, CAST(sum({g}) AS BIGINT) AS n_gold, CAST(sum({p}) AS BIGINT) AS n_pred, CAST(sum({least}) AS BIGINT) AS n_hit FROM s GROUP BY uid),
f AS (SELECT *, CASE WHEN n_pred > 0 THEN n_hit / n_pred WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN n_gold > 0 THEN n_hit / n_gold WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END AS recall,
  CASE WHEN n_gold + n_pred = 0 THEN 1.0 WHEN n_hit = 0 THEN 0.0 ELSE 2.0 * (n_hit / n_pred) * (n_hit / n_gold) / (n_hit / n_pred + n_hit / n_gold) END AS f1 FROM h)"""


_MULTI = f"WITH {_SIDES}, {_f1_sql('least(g, p)', 'g', 'p')}"
_SET = f"WITH {_SIDES}, {_f1_sql('least(g, p, 1)', 'least(g, 1)', 'least(p, 1)')}"


@query(f"{_MULTI} SELECT * FROM f")
def m3_row_f1(spark: SparkSession, sf: str) -> DataFrame:
    return M.row_f1(results(spark, sf))


@query(f"{_SET} SELECT * FROM f")
def m4_key_f1(spark: SparkSession, sf: str) -> DataFrame:
    return M.row_f1(results(spark, sf), multiset=False)


@query(f"""WITH a AS (SELECT uid, list(DISTINCT "row") FILTER (side = 'gold') AS g, coalesce(list(DISTINCT "row") FILTER (side = 'pred'), []) AS p FROM {_RESULT} GROUP BY uid), n AS (SELECT uid, len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS h FROM a)
SELECT uid, CASE WHEN p > 0 THEN h / p ELSE 0.0 END AS precision, CASE WHEN g > 0 THEN h / g ELSE 0.0 END AS recall, CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * (h / p) * (h / g) / (h / p + h / g) END AS f1, CAST(h AS BIGINT) AS n_hit FROM n""")
def m5_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda n: F.collect_set(F.when(F.col("side") == n, F.col("row")))
    return results(spark, sf).groupBy("uid").agg(M.array_scores(side("gold"), side("pred")).alias("s")).select("uid", "s.*")


@query(f"{_MULTI} SELECT uid, CASE WHEN f1 = 1 THEN 1 ELSE 0 END AS accuracy, f1 FROM f")
def m6_execution_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return M.row_f1(results(spark, sf)).select("uid", F.when(F.col("f1") == 1, 1).otherwise(0).alias("accuracy"), "f1")


@query(f"SELECT uid, model, CASE WHEN correct THEN 2410.01066 / (2410.01066 + latency_s * 1000) ELSE 0.0 END AS ves FROM {RECORDS_SQL}")
def m7_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("uid", "model", M.efficiency(F.col("correct"), F.col("latency_s") * 1000).alias("ves"))


_PAIRS = f"(SELECT a.sql_id, a.sql AS gold, b.sql AS pred FROM {STATEMENTS_SQL} a JOIN {STATEMENTS_SQL} b ON b.sql_id = a.sql_id + CASE WHEN a.sql_id % 3 = 0 THEN 0 ELSE 14 END)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Gold and predicted statements: the same one, or the next of its shape."""
    return statement_pairs(spark, sf, F.when(F.col("sql_id") % 3 == 0, 0).otherwise(14))


def _norm(x: str) -> str:
    flat = f"trim(regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '[ ;]+$', ''))"
    return f"(CASE WHEN contains({flat}, ' where ') THEN split_part({flat}, ' where ', 1) || ' where ' || array_to_string(list_sort(string_split(substr({flat}, strpos({flat}, ' where ') + 7), ' and ')), ' and ') ELSE {flat} END)"


@query(f"SELECT sql_id, CASE WHEN {_norm('gold')} = {_norm('pred')} THEN 1 ELSE 0 END AS exact_match FROM {_PAIRS}")
def m8_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return M.text_metrics(pairs(spark, sf), "gold", "pred", ["exact_match"]).select("sql_id", "exact_match")


def _tok(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]+'))"


@query(f"WITH t AS (SELECT sql_id, {_tok('gold')} AS g, {_tok('pred')} AS p FROM {_PAIRS}), h AS (SELECT sql_id, len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS h FROM t) SELECT sql_id, CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * (h / p) * (h / g) / (h / p + h / g) END AS soft_f1, CAST(g + p - 2 * h AS BIGINT) AS set_distance FROM h")
def m10_soft_f1_m11_distance(spark: SparkSession, sf: str) -> DataFrame:
    return M.text_metrics(pairs(spark, sf), "gold", "pred", ["soft_f1", "set_distance"]).select("sql_id", "soft_f1", "set_distance")


def clause_parts(x: str, name: str) -> str:
    """SQL of the parts of one clause, distinct, in no order."""
    later = {"select": "from", "from": "where|group by|order by|limit", "where": "group by|order by|limit", "group by": "having|order by|limit", "order by": "limit"}[name]
    text = f"trim(regexp_extract({_norm(x)}, '\\b{name}\\b (.*?)(?: (?:{later})\\b|$)', 1))"
    cut = "\\s+and\\s+" if name == "where" else "\\s*,\\s*"
    return f"list_filter(list_distinct(list_transform(regexp_split_to_array({text}, '{cut}'), lambda x: trim(x))), lambda x: x <> '')"


_CLAUSES = list(enumerate(M.CLAUSES))
_F1 = "CASE WHEN g{k} = 0 AND p{k} = 0 THEN 1.0 WHEN h{k} = 0 THEN 0.0 ELSE 2 * (h{k} / p{k}) * (h{k} / g{k}) / (h{k} / p{k} + h{k} / g{k}) END::DOUBLE"
_JACCARD = "CASE WHEN g{k} + p{k} = 0 THEN 1.0 ELSE h{k} / (g{k} + p{k} - h{k}) END::DOUBLE"


@query(f"""WITH c AS (SELECT sql_id, gold, pred, {', '.join(f"{clause_parts('gold', c)} AS a{k}, {clause_parts('pred', c)} AS b{k}" for k, c in _CLAUSES)}, {_tok('gold')} AS ta, {_tok('pred')} AS tb FROM {_PAIRS}),
n AS (SELECT sql_id, CASE WHEN {_norm('gold')} = {_norm('pred')} THEN 1 ELSE 0 END AS exact_match, {', '.join(f'len(a{k}) AS g{k}, len(b{k}) AS p{k}, len(list_intersect(a{k}, b{k})) AS h{k}' for k, _ in _CLAUSES)}, len(ta) AS g9, len(tb) AS p9, len(list_intersect(ta, tb)) AS h9 FROM c)
SELECT sql_id, exact_match, ({' + '.join(_F1.format(k=k) for k, _ in _CLAUSES)}) / 5 AS component_f1, {_F1.format(k=9)} AS soft_f1, CAST(g9 + p9 - 2 * h9 AS BIGINT) AS set_distance, ({' + '.join(_JACCARD.format(k=k) for k, _ in _CLAUSES)}) / 5 AS clause_jaccard FROM n""")
def m9_m12_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.text_metrics(pairs(spark, sf), "gold", "pred").drop("gold", "pred")


@query(f"""WITH g AS (SELECT sql_id, t, count(*) AS c FROM (SELECT sql_id, unnest(regexp_extract_all(lower(gold), '[a-z0-9_]+')) AS t FROM {_PAIRS}) GROUP BY ALL), p AS (SELECT sql_id, t, count(*) AS c FROM (SELECT sql_id, unnest(regexp_extract_all(lower(pred), '[a-z0-9_]+')) AS t FROM {_PAIRS}) GROUP BY ALL),
s AS (SELECT coalesce(g.sql_id, p.sql_id) AS sql_id, coalesce(g.c, 0) AS g, coalesce(p.c, 0) AS p FROM g FULL JOIN p ON g.sql_id = p.sql_id AND g.t = p.t), h AS (SELECT sql_id, sum(g) AS g, sum(p) AS p, sum(least(g, p)) AS h FROM s GROUP BY sql_id)
SELECT sql_id, CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * (h / p) * (h / g) / (h / p + h / g) END AS f1 FROM h""")
def m13_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_f1(pairs(spark, sf), ["sql_id"], "gold", "pred")


@query(f"WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, array_to_string(w[:len(w) * 60 // 100], ' ') AS prefix, array_to_string(w[len(w) * 60 // 100 + 1:], ' ') AS suffix FROM w")
def m13_split(spark: SparkSession, sf: str) -> DataFrame:
    a, b = M.split_at(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", a.alias("prefix"), b.alias("suffix"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS id, q.label, max(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS best FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id GROUP BY 1, 2)
SELECT label, round(avg(best), 6) AS mean_best, count(*) AS n FROM s GROUP BY label""")
def m14_best_match(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    best = M.best_cosines(e.filter("id % 20 = 0"), e, "label")
    return best.filter("best IS NOT NULL").groupBy("label").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.count(F.lit(1)).alias("n"))


@query(f"""{_MULTI}, t AS (SELECT f.*, c_mktsegment AS seg FROM f JOIN customer ON c_custkey = uid), a AS (SELECT seg, count(*) AS n, avg(CASE WHEN n_hit > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(CASE WHEN f1 = 1 THEN 1.0 ELSE 0.0 END) AS exact_rate,
sum(n_hit) / sum(n_pred) AS micro_p, sum(n_hit) / sum(n_gold) AS micro_r, avg(precision) AS macro_p, avg(recall) AS macro_r, avg(f1) AS macro_f1 FROM t GROUP BY seg) SELECT *, 2 * micro_p * micro_r / (micro_p + micro_r) AS micro_f1 FROM a""")
def m15_summary(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("seg"))
    return M.summary(M.row_f1(results(spark, sf)).join(seg, "uid"), "seg")


@query(f"""WITH v AS (SELECT model, list_sort(list(latency_s)) AS v, count(*) AS n, avg(latency_s) AS mean, median(latency_s) AS median, min(latency_s) AS least, max(latency_s) AS most FROM {RECORDS_SQL} GROUP BY model),
q AS (SELECT *, greatest(1, least((n + 1) * 95 // 100, n - 1)) AS i, greatest(1, least((n + 1) * 99 // 100, n - 1)) AS j FROM v)
SELECT model, mean, median, least, most, CASE WHEN n >= 20 THEN (v[i] * (100 - ((n + 1) * 95 - i * 100)) + v[i + 1] * ((n + 1) * 95 - i * 100)) / 100 ELSE v[n] END AS p95,
CASE WHEN n >= 100 THEN (v[j] * (100 - ((n + 1) * 99 - j * 100)) + v[j + 1] * ((n + 1) * 99 - j * 100)) / 100 ELSE v[n] END AS p99 FROM q""")
def m16_latency(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency_summary(records(spark, sf), "latency_s", "model")


@query(f"""WITH r AS (SELECT *, CAST(correct AS INT) AS x FROM {RECORDS_SQL}) SELECT 'strategy' AS axis, strategy AS key, count(*) AS n, avg(x) AS mean FROM r GROUP BY strategy UNION ALL SELECT 'tier', tier, count(*), avg(x) FROM r GROUP BY tier UNION ALL SELECT 'all', '', count(*), avg(x) FROM r""")
def m17_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return M.breakdown(records(spark, sf).withColumn("x", F.col("correct").cast("int")), "x", "strategy", "tier")


@query(f"{_SET} SELECT 'all' AS mode, count(*) AS n, avg(f1) AS mean_f1 FROM f UNION ALL SELECT 'even', count(*), avg(f1) FROM f WHERE uid % 2 = 0")
def m19_modes(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    both = r.withColumn("mode", F.lit("all")).unionByName(r.filter("uid % 2 = 0").withColumn("mode", F.lit("even"))).withColumn("key", F.struct("mode", "uid"))
    return M.row_f1(both, "key", multiset=False).groupBy(F.col("key.mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("mean_f1"))


_RUNS = f"(SELECT model AS mode, uid, uid % 7 AS evaluated_at, 1 AS file, row_f1 FROM {RECORDS_SQL} WHERE uid % 11 <> 0 OR model <> 'ash' UNION ALL SELECT model, uid, uid % 5, 2, row_f1 / 2 FROM {RECORDS_SQL} WHERE uid % 3 = 0 AND model <> 'birch')"


@query(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY mode, uid ORDER BY evaluated_at DESC, file DESC) AS k FROM {_RUNS}), o AS (SELECT * FROM l WHERE k = 1), c AS (SELECT uid FROM o GROUP BY uid HAVING count(DISTINCT mode) = 4) SELECT mode, uid, file, row_f1 FROM o WHERE uid IN (SELECT uid FROM c)")
def m20_merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumnRenamed("model", "mode")
    one = r.filter("uid % 11 <> 0 OR mode <> 'ash'").select("mode", "uid", (F.col("uid") % 7).alias("evaluated_at"), F.lit(1).alias("file"), "row_f1")
    two = r.filter("uid % 3 = 0 AND mode <> 'birch'").select("mode", "uid", (F.col("uid") % 5).alias("evaluated_at"), F.lit(2).alias("file"), (F.col("row_f1") / 2).alias("row_f1"))
    return M.merge_runs(one.unionByName(two)).select("mode", "uid", "file", "row_f1")


@query(f"{_MULTI}, t AS (SELECT f.*, c_mktsegment AS seg FROM f JOIN customer ON c_custkey = uid) SELECT seg, count(*) AS n, avg(CASE WHEN n_hit > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, 2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)) AS f1_of_means FROM t GROUP BY seg")
def m21_mean_f1(spark: SparkSession, sf: str) -> DataFrame:
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("seg"))
    return M.mean_f1_summary(M.row_f1(results(spark, sf)).join(seg, "uid"), "seg")


@query(f"SELECT model, avg(CASE WHEN tier = 'E' THEN row_f1 END) AS E, avg(CASE WHEN tier = 'M' THEN row_f1 END) AS M, avg(CASE WHEN tier = 'H' THEN row_f1 END) AS H FROM {RECORDS_SQL} GROUP BY model")
def m22_tier_table(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("model").pivot("tier", ["E", "M", "H"]).agg(F.avg("row_f1"))


@query(f"SELECT pattern, CASE WHEN status <> 'ok' THEN 'not_run' WHEN correct THEN 'right' ELSE 'wrong' END AS bucket, count(*) AS n, avg(latency_s) AS latency FROM {RECORDS_SQL} GROUP BY ALL")
def m23_error_buckets(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("status") != "ok", "not_run").when(F.col("correct"), "right").otherwise("wrong")
    return records(spark, sf).groupBy("pattern", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_s").alias("latency"))


@query(f"SELECT uid, model, CASE WHEN status = 'pred_error' THEN -0.5::DOUBLE ELSE CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN row_f1 > 0.5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END END AS reward FROM {RECORDS_SQL}")
def m24_reward(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("uid", "model", M.reward(F.col("status") != "pred_error", F.col("correct"), F.col("row_f1") > 0.5).alias("reward"))


@query(f"SELECT pattern, tier, count(*) AS n, avg(CAST(correct AS INT)) AS mean FROM {RECORDS_SQL} GROUP BY pattern, tier")
def m25_surface(spark: SparkSession, sf: str) -> DataFrame:
    return M.surface(records(spark, sf), "pattern", "tier", "correct")


@query("""WITH g AS (SELECT CAST(p_size // 10 AS BIGINT) AS x, CAST(floor(p_retailprice / 40) AS BIGINT) AS y, count(*) AS n, avg(p_size) AS mean FROM part GROUP BY 1, 2),
b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM g), cells AS (SELECT x, unnest(range(c, d + 1)) AS y FROM (SELECT unnest(range(a, b + 1)) AS x, c, d FROM b)),
l AS (SELECT cells.x, cells.y, sum(g.n * g.mean) / sum(g.n) AS loc FROM cells LEFT JOIN g ON abs(g.x - cells.x) <= 1 AND abs(g.y - cells.y) <= 1 GROUP BY ALL)
SELECT l.x, l.y, coalesce(g.n, 0) AS n, CASE WHEN g.n IS NULL THEN loc ELSE (g.n * g.mean + 10 * loc) / (g.n + 10) END AS filled FROM l LEFT JOIN g ON g.x = l.x AND g.y = l.y""")
def m26_filled_surface(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.floor(F.col("p_size") / 10).cast("long").alias("x"), F.floor(F.col("p_retailprice") / 40).cast("long").alias("y"), "p_size")
    return M.fill_surface(M.surface(p, "x", "y", "p_size"), "x", "y")
