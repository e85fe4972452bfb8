"""Significance and ranking queries over evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import mix_sql, text_number_sql
from skemara.operators import stats as T
from skemara.plans.derived import MODELS, RECORDS_SQL, records
from skemara.registry import query, table

REPS = T.REPS
_OK = f"o AS (SELECT * FROM {RECORDS_SQL} WHERE status = 'ok'), c AS (SELECT uid FROM o GROUP BY uid HAVING count(DISTINCT model) = {len(MODELS)}), r AS (SELECT * FROM o WHERE uid IN (SELECT uid FROM c))"
_D = "d AS (SELECT x.model AS a, y.model AS b, x.uid, x.db_id AS cluster, CAST(x.correct AS INT)::DOUBLE - CAST(y.correct AS INT)::DOUBLE AS d FROM r x JOIN r y ON x.uid = y.uid AND x.model < y.model)"
_BOOT = f"""s AS (SELECT a, b, cluster, sum(d) AS s, count(*) AS n FROM d GROUP BY a, b, cluster),
u AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS unit FROM (SELECT DISTINCT cluster FROM s)), k AS (SELECT count(*) AS k FROM u),
w AS (SELECT i // k AS rep, {mix_sql('i', 0)} % k AS unit, count(*) AS times FROM k, range((SELECT {REPS} * count(*) FROM u)) AS g(i) GROUP BY 1, 2),
b AS (SELECT a, b, rep, sum(s * times) / sum(n * times) AS mean FROM w JOIN u USING (unit) JOIN s USING (cluster) GROUP BY a, b, rep)"""
_P = "m0 AS (SELECT a, b, avg(d) AS mean_d FROM d GROUP BY a, b), p AS (SELECT a, b, CASE WHEN any_value(mean_d) = 0 THEN 1.0 ELSE least(1.0, 2 * least(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END))) END AS p FROM b JOIN m0 USING (a, b) GROUP BY a, b)"


@query(f"WITH {_OK} SELECT uid, model, correct FROM r")
def t1_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return T.aligned(records(spark, sf)).select("uid", "model", "correct")


@query(f"WITH {_OK} SELECT model, count(*) AS n, avg(CAST(correct AS INT)) AS accuracy FROM r GROUP BY model")
def t2_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return T.accuracy(T.aligned(records(spark, sf)), "model")


@query(f"WITH {_OK}, a AS (SELECT model, avg(CAST(correct AS INT)) AS accuracy FROM r GROUP BY model) SELECT count(*) AS models, stddev_pop(accuracy) AS spread, avg(CASE WHEN accuracy >= 0.7 THEN 1.0 ELSE 0.0 END) AS ceiling_rate FROM a")
def t2_spread(spark: SparkSession, sf: str) -> DataFrame:
    return T.spread(T.aligned(records(spark, sf)), 0.7)


@query(f"WITH {_OK}, {_D}, {_BOOT}, {_P} SELECT a, b, p FROM p")
def t3_bootstrap_p(spark: SparkSession, sf: str) -> DataFrame:
    diffs = T.paired(T.aligned(records(spark, sf)))
    return T.p_values(T.bootstrap(diffs, REPS), T.cohen_d(diffs))


@query(f"WITH {_OK}, {_D} SELECT a, b, count(*) AS n, avg(d) AS mean_d, avg(d) / stddev_samp(d) AS cohen_d FROM d GROUP BY a, b")
def t4_cohen_d(spark: SparkSession, sf: str) -> DataFrame:
    return T.cohen_d(T.paired(T.aligned(records(spark, sf))))


_BH = """k AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS rank, count(*) OVER () AS m FROM p)
SELECT a, b, rank, coalesce(rank <= max(CASE WHEN p <= 0.05 * rank / m THEN rank END) OVER (), false) AS rejected FROM k"""


@query(f"WITH {_OK}, {_D}, {_BOOT.replace('k AS (SELECT count', 'kk AS (SELECT count').replace('FROM k, range', 'FROM kk, range')}, {_P}, {_BH}")
def t5_benjamini_hochberg(spark: SparkSession, sf: str) -> DataFrame:
    diffs = T.paired(T.aligned(records(spark, sf)))
    tests = T.p_values(T.bootstrap(diffs, REPS), T.cohen_d(diffs))
    return T.benjamini_hochberg(tests).select("a", "b", "rank", "rejected")


@query(f"WITH {_OK}, {_D}, {_BOOT.replace('k AS (SELECT count', 'kk AS (SELECT count').replace('FROM k, range', 'FROM kk, range')}, {_P}, z AS ({_BH.replace('k AS', 'WITH k AS', 1)}) SELECT count(*) AS pairs, avg(CASE WHEN rejected THEN 1.0 ELSE 0.0 END) AS separable FROM z")
def t6_separable(spark: SparkSession, sf: str) -> DataFrame:
    return T.separable(records(spark, sf), REPS).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("rejected").cast("double")).alias("separable"))


_PIVOT = ", ".join(f"avg(CASE WHEN model = '{m}' THEN CAST(correct AS INT) END) AS {m}" for m in MODELS)


@query(f"WITH {_OK} SELECT strategy, {_PIVOT}, count(DISTINCT uid) AS n FROM r GROUP BY strategy HAVING count(DISTINCT uid) >= 5")
def t7_class_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return T.class_matrix(T.aligned(records(spark, sf)), list(MODELS))


@query(f"SELECT model, count(*) AS n FROM {RECORDS_SQL} WHERE status = 'ok' AND model IN ('ash', 'cedar') GROUP BY model")
def t8_model_pool(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter(F.col("model").isin("ash", "cedar") & (F.col("status") == "ok")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_OK}, n AS (SELECT strategy, count(DISTINCT uid) AS n FROM r GROUP BY strategy), t AS (SELECT count(*) AS m, sum(n) AS s FROM n),
g AS (SELECT strategy, n, alpha, (1 - alpha) * n / s + alpha / m AS pi FROM n, t, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)),
w AS (SELECT strategy, alpha, pi / sum(pi) OVER (PARTITION BY alpha) / n AS w FROM g)
SELECT alpha, model, sum(w * CAST(correct AS INT)) / sum(w) AS accuracy FROM r JOIN w USING (strategy) GROUP BY alpha, model""")
def t9_reweighted(spark: SparkSession, sf: str) -> DataFrame:
    r = T.aligned(records(spark, sf))
    classes = r.select("strategy").distinct()
    return T.reweighted(r, classes.withColumn("share", F.lit(1.0) / classes.count()), [0.0, 0.25, 0.5, 0.75, 1.0])


_REGIMES = {"correct": "CAST(correct AS INT)::DOUBLE", "row_f1": "row_f1"}


def _ranks(rows: str = "r", regimes: dict[str, str] | None = None, seed: int = 0, number: str = "uid", pooled: bool = True) -> str:
    """SQL of the ranks per regime and replicate over `rows` (uid, model, ...): questions of equal values are one cell, drawn Poisson(size) times, or each is drawn on its own."""
    regimes = regimes or _REGIMES
    cells = [(k, v, m) for k, v in regimes.items() for m in MODELS]
    wide = ", ".join(f"max(CASE WHEN model = '{m}' THEN {v} END) AS v{i}" for i, (_, v, m) in enumerate(cells))
    names = ", ".join(f"v{i}" for i in range(len(cells)))
    sums = ", ".join(f"sum(t * v{i}) / sum(t) AS m{i}" for i in range(len(cells)))
    long = " UNION ALL ".join(f"SELECT '{k}' AS regime, rep, '{m}' AS model, round(m{i}, 9) AS mean FROM g" for i, (k, _, m) in enumerate(cells))
    if not pooled:
        # The steps that a draw of 31 bits can tell apart.
        times = " + ".join(f"CASE WHEN u >= {float(e)!r} THEN 1 ELSE 0 END" for e in T.poisson_steps(1) if e < 1 - 2**-32)
        return f"""(WITH q AS (SELECT min({number}) AS unit, {wide} FROM {rows} GROUP BY uid), u AS (SELECT q.*, rep, {mix_sql('unit', seed, 'rep')} / 2147483647.0::DOUBLE AS u FROM q, range({REPS}) AS x(rep)), w AS (SELECT *, {times} AS t FROM u),
  g AS (SELECT rep, {sums} FROM w GROUP BY rep) SELECT *, row_number() OVER (PARTITION BY regime, rep ORDER BY mean DESC, model) AS rank FROM ({long}))"""
    return f"""(WITH q AS (SELECT min({number}) AS unit, {wide} FROM {rows} GROUP BY uid), e AS (SELECT {names}, count(*) AS size, min(unit) AS unit FROM q GROUP BY {names}),
  f AS (SELECT size, k, sum(exp(k * ln(size) - size - lgamma(k + 1))) OVER (PARTITION BY size ORDER BY k) AS upto FROM (SELECT size, unnest(range(CAST(size + 12 * sqrt(size) + 30 AS BIGINT))) AS k FROM (SELECT DISTINCT size FROM e))),
  u AS (SELECT e.*, rep, {mix_sql('unit', seed, 'rep')} / 2147483647.0::DOUBLE AS u FROM e, range({REPS}) AS x(rep)), w AS (SELECT u.*, coalesce(f.k + 1, 0) AS t FROM u ASOF LEFT JOIN f ON u.size = f.size AND u.u >= f.upto),
  g AS (SELECT rep, {sums} FROM w GROUP BY rep) SELECT *, row_number() OVER (PARTITION BY regime, rep ORDER BY mean DESC, model) AS rank FROM ({long}))"""


def ranks(spark: SparkSession, sf: str, values: tuple[str, ...] = tuple(_REGIMES), seed: int = 0) -> DataFrame:
    return T.rank_replicates(T.aligned(records(spark, sf)), values, REPS, seed, list(MODELS))


@query(f"WITH {_OK} SELECT regime, model, rank, count(*) / {REPS} AS share FROM {_ranks()} GROUP BY regime, model, rank")
def t10_rank_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Both regimes: exact answers and row scores, on the same draws."""
    return T.rank_distribution(ranks(spark, sf), REPS)


_TAU = "SELECT p.rep, avg(sign(p.r1 - q.r1) * sign(p.r2 - q.r2)) AS tau FROM z p JOIN z q ON p.rep = q.rep AND p.model < q.model GROUP BY p.rep"
_POINT = "(SELECT model, row_number() OVER (ORDER BY round(avg({v}), 9) DESC, model) AS rank FROM {rows} GROUP BY model)"


def _tau_of(left: str, right: str, point_left: str, point_right: str) -> str:
    """SQL of a summary of tau between two rankings, replicate by replicate."""
    return f"""z AS (SELECT x.rep, x.model, x.rank AS r1, y.rank AS r2 FROM {left} x JOIN {right} y ON x.rep = y.rep AND x.model = y.model), tau AS ({_TAU}),
zp AS (SELECT x.model, x.rank AS r1, y.rank AS r2 FROM {point_left} x JOIN {point_right} y USING (model)), tp AS (SELECT avg(sign(p.r1 - q.r1) * sign(p.r2 - q.r2)) AS tau FROM zp p JOIN zp q ON p.model < q.model)
SELECT (SELECT tau FROM tp) AS point, avg(tau) AS centre, quantile_cont(tau, 0.025) AS low, quantile_cont(tau, 0.975) AS high, avg(CASE WHEN tau <= 0 THEN 1.0 ELSE 0.0 END) AS p_le_0, avg(CASE WHEN tau < 1 THEN 1.0 ELSE 0.0 END) AS p_lt_1 FROM tau"""


@query(f"WITH {_OK}, k AS MATERIALIZED {_ranks()}, {_tau_of('(SELECT * FROM k WHERE regime = $$correct$$)', '(SELECT * FROM k WHERE regime = $$row_f1$$)', _POINT.format(v=_REGIMES['correct'], rows='r'), _POINT.format(v='row_f1', rows='r'))}")
def t11_kendall(spark: SparkSession, sf: str) -> DataFrame:
    """Tau between the rankings of the two regimes."""
    r, k = T.aligned(records(spark, sf)), ranks(spark, sf)
    taus = T.kendall(k.filter("regime = 'correct'"), k.filter("regime = 'row_f1'"), "rep")
    return T.tau_summary(taus, T.kendall(T.point_ranks(r, "correct"), T.point_ranks(r, "row_f1")))


@query(f"""WITH {_OK}, {_D}, {_BOOT}, m AS (SELECT a, b, avg(d) AS mean_d FROM d GROUP BY a, b)
SELECT a, b, avg(CASE WHEN sign(mean) = sign(mean_d) THEN 1.0 ELSE 0.0 END) AS agree, avg(CASE WHEN sign(mean) * sign(mean_d) < 0 THEN 1.0 ELSE 0.0 END) AS flip, quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS excludes_zero FROM b JOIN m USING (a, b) GROUP BY a, b""")
def t12_sign_agreement(spark: SparkSession, sf: str) -> DataFrame:
    diffs = T.paired(T.aligned(records(spark, sf)))
    return T.sign_agreement(T.bootstrap(diffs, REPS), T.cohen_d(diffs).select("a", "b", "mean_d"))


_CLAIM = f"""w AS (SELECT regime, rep, {', '.join(f"max(CASE WHEN model = '{m}' THEN mean END) AS m_{m}, max(CASE WHEN model = '{m}' THEN rank END) AS r_{m}" for m in MODELS)} FROM k GROUP BY regime, rep)"""


@query(f"""WITH {_OK}, k AS {_ranks()}, {_CLAIM} SELECT 'ash first' AS claim, avg(CASE WHEN r_ash = 1 THEN 1.0 ELSE 0.0 END) AS share FROM w WHERE regime = 'correct'
UNION ALL SELECT 'birch over cedar', avg(CASE WHEN m_birch > m_cedar THEN 1.0 ELSE 0.0 END) FROM w WHERE regime = 'correct'
UNION ALL SELECT 'dogwood over ash by rows', avg(CASE WHEN m_dogwood > m_ash THEN 1.0 ELSE 0.0 END) FROM w WHERE regime = 'row_f1'""")
def t13_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return T.claims(ranks(spark, sf), {"ash first": ("correct", c("r_ash") == 1), "birch over cedar": ("correct", c("m_birch") > c("m_cedar")), "dogwood over ash by rows": ("row_f1", c("m_dogwood") > c("m_ash"))})


_HALVES = "ra AS (SELECT * FROM r WHERE db_id < 'src2'), rb AS (SELECT * FROM r WHERE db_id >= 'src2')"
_CORRECT = {"correct": _REGIMES["correct"]}


@query(f"WITH {_OK}, {_HALVES}, {_tau_of(_ranks('ra', _CORRECT, 1, pooled=False), _ranks('rb', _CORRECT, 2, pooled=False), _POINT.format(v=_REGIMES['correct'], rows='ra'), _POINT.format(v=_REGIMES['correct'], rows='rb'))}")
def t13_cross_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Tau between the rankings on two sets of databases, each with draws of its own for every question."""
    halves = [T.aligned(records(spark, sf)).filter(f"db_id {op} 'src2'") for op in ("<", ">=")]
    k = [T.rank_replicates(h, ("correct",), REPS, seed, list(MODELS), pooled=False) for seed, h in enumerate(halves, 1)]
    return T.tau_summary(T.kendall(*k, "rep"), T.kendall(*(T.point_ranks(h, "correct") for h in halves)))


@query(f"""WITH {_OK}, j AS (SELECT uid FROM r WHERE uid IN (SELECT doc_id FROM labels) GROUP BY uid) SELECT model, count(*) AS n, avg(row_f1) AS mean FROM r JOIN j USING (uid) GROUP BY model""")
def t14_joint_subset(spark: SparkSession, sf: str) -> DataFrame:
    joint = T.aligned(records(spark, sf)).join(table(spark, sf, "labels").select(F.col("doc_id").alias("uid")), "uid", "left_semi")
    return joint.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("row_f1").alias("mean"))


@query(f"""WITH {_OK}, m AS (SELECT model, avg(CAST(correct AS INT)) AS x, avg(row_f1) AS y FROM r GROUP BY model),
k AS (SELECT model, row_number() OVER (ORDER BY x DESC, model) AS r1, row_number() OVER (ORDER BY y DESC, model) AS r2 FROM m)
SELECT p.model AS a, q.model AS b FROM k p JOIN k q ON p.r1 < q.r1 AND p.r2 > q.r2""")
def t15_inversions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    r = T.aligned(records(spark, sf))
    rank = lambda v: r.groupBy("model").agg(F.avg(F.col(v).cast("double")).alias("m")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("m"), "model")))
    return T.inversions(rank("correct"), rank("row_f1"))


@query(f"WITH {_OK}, {_D}, {_BOOT} SELECT a, b, avg(mean) AS centre, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM b GROUP BY a, b")
def t16_interval(spark: SparkSession, sf: str) -> DataFrame:
    out = T.intervals(T.bootstrap(T.paired(T.aligned(records(spark, sf))), REPS), "a", "b")
    return out


_FORMS = "correct AS natural, latency_s < 0.9 AND correct AS rewritten, correct OR row_f1 > 0.8 AS canonical"


@query(f"""WITH {_OK}, f AS (SELECT model, uid, tier, {_FORMS} FROM r)
SELECT model, coalesce(tier, 'all') AS tier, count(*) AS n, avg(CAST(natural AS INT)) AS natural, avg(CAST(rewritten AS INT)) AS rewritten, avg(CAST(canonical AS INT)) AS canonical FROM f GROUP BY GROUPING SETS ((model), (model, tier))""".replace("natural", "plain"))
def t17_forms(spark: SparkSession, sf: str) -> DataFrame:
    r = T.aligned(records(spark, sf))
    forms = {"plain": r, "rewritten": r.withColumn("correct", (F.col("latency_s") < 0.9) & F.col("correct")), "canonical": r.withColumn("correct", F.col("correct") | (F.col("row_f1") > 0.8))}
    return T.compare_forms(forms, ["model", "uid"], ["tier"])


@query(f"WITH {_OK} SELECT model, count(*) AS n, avg(CAST(correct AS INT)) AS accuracy FROM r WHERE uid IN (SELECT uid FROM r WHERE correct) GROUP BY model")
def t18_certified(spark: SparkSession, sf: str) -> DataFrame:
    return T.accuracy(T.certified(T.aligned(records(spark, sf))), "model")


@query(f"""WITH {_OK} SELECT pattern, avg(CASE WHEN model = 'ash' THEN CAST(correct AS INT) END) - avg(CASE WHEN model = 'dogwood' THEN CAST(correct AS INT) END) AS gap FROM r GROUP BY pattern""")
def t19_gap_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    acc = lambda m: F.avg(F.when(F.col("model") == m, F.col("correct").cast("double")))
    return T.aligned(records(spark, sf)).groupBy("pattern").agg((acc("ash") - acc("dogwood")).alias("gap"))


@query(f"WITH {_OK} SELECT uid, strategy FROM r GROUP BY uid, strategy HAVING max(CAST(correct AS INT)) = 0")
def t20_unsolved(spark: SparkSession, sf: str) -> DataFrame:
    return T.unsolved(T.aligned(records(spark, sf)))


@query(f"""WITH {_OK}, f AS (SELECT uid, CASE WHEN row_f1 < 0.3 THEN 'join_path' WHEN row_f1 < 0.7 THEN 'value' ELSE 'operator' END AS category FROM r WHERE NOT correct),
k AS (SELECT uid, category, count(*) AS c FROM f GROUP BY uid, category)
SELECT uid, count(*) AS categories, arg_min(category, (-c, category)) AS main FROM k GROUP BY uid""")
def t20_consensus(spark: SparkSession, sf: str) -> DataFrame:
    r = T.aligned(records(spark, sf)).filter(~F.col("correct"))
    return T.consensus(r.withColumn("category", F.when(F.col("row_f1") < 0.3, "join_path").when(F.col("row_f1") < 0.7, "value").otherwise("operator")))


@query(f"""WITH c AS (SELECT r.model, d.text, reverse(d.text) AS answer FROM {RECORDS_SQL} r JOIN documents d ON d.doc_id = r.uid),
p AS (SELECT * FROM (VALUES ('ash', 3.0, 15.0), ('birch', 2.0, 8.0), ('cedar', 0.4, 1.6), ('dogwood', 0.1, 0.5)) AS v(model, i, o))
SELECT model, count(*) AS calls, sum(length(text)) / 4 AS tokens_in, sum(length(answer)) / 4 AS tokens_out, (sum(length(text)) / 4 * any_value(i) + sum(length(answer)) / 4 * any_value(o)) / 1e6 AS cost FROM c JOIN p USING (model) GROUP BY model""")
def t21_costs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text", F.reverse("text").alias("answer"))
    prices = spark.createDataFrame([("ash", 3.0, 15.0), ("birch", 2.0, 8.0), ("cedar", 0.4, 1.6), ("dogwood", 0.1, 0.5)], "model string, price_in double, price_out double")
    return T.costs(records(spark, sf).join(docs, "uid"), prices, "text", "answer").drop("price_in", "price_out")


@query("SELECT source, sum((r = 1)::INT)::BIGINT AS \"1\", sum((r = 2)::INT)::BIGINT AS \"2\", sum((r = 3)::INT)::BIGINT AS \"3\", avg(r) AS mean FROM (SELECT source, doc_id % 3 + 1 AS r FROM documents) GROUP BY source")
def t22_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return T.rating_table(table(spark, sf, "documents").select("source", (F.col("doc_id") % 3 + 1).alias("r")), "source", "r", [1, 2, 3])


@query(f"SELECT db_id, strategy, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY db_id) AS share FROM {RECORDS_SQL} WHERE model = 'ash' GROUP BY db_id, strategy")
def t23_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    return T.shares(records(spark, sf).filter("model = 'ash'"), "db_id", "strategy")


@query(f"""WITH {_OK}, i AS (SELECT DISTINCT uid FROM r), k AS (SELECT rep, uid, row_number() OVER (PARTITION BY rep ORDER BY {mix_sql('uid', 3, 'rep')}, uid) AS n FROM i, (SELECT unnest(range(5)) AS rep))
SELECT rep, model, avg(CAST(correct AS INT)) AS accuracy FROM k JOIN r USING (uid) WHERE n <= 50 GROUP BY rep, model""")
def t24_power_draws(spark: SparkSession, sf: str) -> DataFrame:
    r = T.aligned(records(spark, sf))
    return T.power_draws(r, 50, 5, seed=3).join(r, "uid").groupBy("rep", "model").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


# Rankings over identifiers that are texts, as stored records have them.
_TEXT_OK = _OK.replace(RECORDS_SQL, f"(SELECT * REPLACE (md5(CAST(uid AS VARCHAR)) AS uid) FROM {RECORDS_SQL})")
_NUMBER = text_number_sql("uid")


def text_records(spark: SparkSession, sf: str) -> DataFrame:
    return T.aligned(records(spark, sf).withColumn("uid", F.md5(F.col("uid").cast("string"))))


@query(f"WITH {_TEXT_OK} SELECT regime, model, rank, count(*) / {REPS} AS share FROM {_ranks(number=_NUMBER)} GROUP BY regime, model, rank")
def t10_rank_distribution_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.rank_distribution(T.rank_replicates(text_records(spark, sf), tuple(_REGIMES), REPS, 0, list(MODELS)), REPS)


@query(f"WITH {_TEXT_OK}, k AS MATERIALIZED {_ranks(number=_NUMBER)}, {_tau_of('(SELECT * FROM k WHERE regime = $$correct$$)', '(SELECT * FROM k WHERE regime = $$row_f1$$)', _POINT.format(v=_REGIMES['correct'], rows='r'), _POINT.format(v='row_f1', rows='r'))}")
def t11_kendall_text(spark: SparkSession, sf: str) -> DataFrame:
    r = text_records(spark, sf)
    k = T.rank_replicates(r, tuple(_REGIMES), REPS, 0, list(MODELS))
    taus = T.kendall(k.filter("regime = 'correct'"), k.filter("regime = 'row_f1'"), "rep")
    return T.tau_summary(taus, T.kendall(T.point_ranks(r, "correct"), T.point_ranks(r, "row_f1")))


@query(f"WITH {_TEXT_OK}, k AS {_ranks(number=_NUMBER)}, {_CLAIM} SELECT 'ash first' AS claim, avg(CASE WHEN r_ash = 1 THEN 1.0 ELSE 0.0 END) AS share FROM w WHERE regime = 'correct'")
def t13_claims_text(spark: SparkSession, sf: str) -> DataFrame:
    k = T.rank_replicates(text_records(spark, sf), tuple(_REGIMES), REPS, 0, list(MODELS))
    return T.claims(k, {"ash first": ("correct", F.col("r_ash") == 1)})


@query(f"""WITH {_TEXT_OK}, i AS (SELECT DISTINCT uid FROM r), k AS (SELECT rep, uid, row_number() OVER (PARTITION BY rep ORDER BY {mix_sql(_NUMBER, 3, 'rep')}, uid) AS n FROM i, (SELECT unnest(range(5)) AS rep))
SELECT rep, model, avg(CAST(correct AS INT)) AS accuracy FROM k JOIN r USING (uid) WHERE n <= 50 GROUP BY rep, model""")
def t24_power_draws_text(spark: SparkSession, sf: str) -> DataFrame:
    r = text_records(spark, sf)
    return T.power_draws(r, 50, 5, seed=3).join(r, "uid").groupBy("rep", "model").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
