"""Tables derived from the test tables: a request log, evaluation records, a corpus of statements.

Each comes as a DataFrame and as SQL text that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import mix_sql
from skemara.registry import table
from skemara.sources.scratch import dealt

MODELS = ("ash", "birch", "cedar", "dogwood")
PATTERNS = ("0", "1p", "2p", "3p", "2i", "3i", "4i")
TIERS = ("E", "M", "H")
#: Statements of a task, on each side of a pair.
STATEMENTS = 100_000
#: Per cent of questions that a model of each place answers.
SKILL = (90, 84, 83, 70)

LOG_SQL = """(SELECT event_id AS request_id, ts, event_type AS op, value AS duration_ms, event_type <> 'error' AND event_id % 17 <> 0 AS success,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('run', CAST(user_id % 40 AS VARCHAR(20))) END AS run_id,
  concat('/api/', event_type) AS route, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status_code,
  concat('find ', event_type, ' of user ', CAST(user_id % 100 AS VARCHAR(20))) AS query_text FROM events)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from events: (request_id, ts, op, duration_ms, success, run_id, route, method, status_code, query_text)."""
    return spark.sql("SELECT * FROM " + LOG_SQL.replace("FROM events)", "FROM {events})"), events=table(spark, sf_dir, "events"))


def _records_sql(documents: str) -> str:
    names = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODELS))
    skill = " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SKILL))
    pattern = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PATTERNS))
    tier = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(TIERS))
    rows = " UNION ALL ".join(f"SELECT doc_id, source, {k} AS k FROM {documents}" for k in range(len(MODELS)))
    return f"""(SELECT doc_id AS uid, source AS db_id, CASE k {names} END AS model, concat(pattern, tier) AS strategy, pattern, tier,
  CASE WHEN a % 50 = 0 THEN 'api_error' WHEN a % 53 = 0 THEN 'pred_error' ELSE 'ok' END AS status,
  b % 100 < CASE k {skill} END - hardness AS correct, CAST(b % 1000 AS DOUBLE) / 1000 AS latency_s, CAST(c % 101 AS DOUBLE) / 100 AS row_f1
FROM (SELECT *, CASE pattern_no {pattern} END AS pattern, CASE tier_no {tier} END AS tier, pattern_no * 2 + tier_no * 4 AS hardness
  FROM (SELECT doc_id, source, k, {mix_sql('doc_id', 5)} % 7 AS pattern_no, {mix_sql('doc_id', 6)} % 3 AS tier_no,
    {mix_sql('doc_id', 7, 'k')} AS a, {mix_sql('doc_id', 8, 'k')} AS b, {mix_sql('doc_id', 9, 'k')} AS c FROM ({rows}) AS r0) AS r1) AS r2)"""


RECORDS_SQL = _records_sql("documents")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records: a row per document (as question) and model, clusters by source."""
    return spark.sql("SELECT * FROM " + _records_sql("{documents}"), documents=table(spark, sf_dir, "documents"))


_SHAPES = (
    "SELECT o.o_orderkey FROM orders AS o WHERE o.o_totalprice > @p",
    "SELECT o.o_orderkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal >= @p AND o.o_orderstatus = ''@s''",
    "SELECT o.o_orderkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey = @k AND c.c_acctbal > @p AND o.o_totalprice <= @q",
    "SELECT n.n_nationkey FROM nation AS n JOIN customer AS c ON c.c_nationkey = n.n_nationkey JOIN supplier AS s ON s.s_nationkey = n.n_nationkey WHERE c.c_acctbal > @p AND s.s_acctbal < @q",
    "SELECT count(*) FROM orders WHERE o_totalprice > @p",
    "SELECT o_orderstatus FROM orders WHERE o_totalprice > @p GROUP BY o_orderstatus",
    "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > @p",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > @p UNION SELECT c_custkey FROM customer",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > @p)",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > @p OR o_orderstatus = ''@s''",
    "SELECT o.o_orderkey FROM orders AS o CROSS JOIN nation AS n WHERE o.o_totalprice > @p",
    "UPDATE orders SET o_totalprice = @p WHERE o_orderkey = @k",
    "SELECT r.r_regionkey FROM region AS r JOIN nation AS n ON n.n_regionkey = r.r_regionkey WHERE r.r_name = ''@s''",
    "SELECT p_partkey FROM part WHERE p_size >= @k AND p_brand = ''@s'' AND p_retailprice < @p",
)


def _statements_sql(orders: str) -> str:
    def fill(shape: str) -> str:
        for mark, value in (("@p", "CAST(o_custkey AS VARCHAR(20))"), ("@q", "CAST(o_orderkey AS VARCHAR(20))"), ("@k", "CAST(o_orderkey % 25 AS VARCHAR(20))"), ("@s", "o_orderstatus")):
            shape = shape.replace(mark, f"', {value}, '")
        return f"concat('{shape}')".replace("''', ", "', chr(39), ").replace(", '''", ", chr(39), '")

    cases = " ".join(f"WHEN {k} THEN {fill(s)}" for k, s in enumerate(_SHAPES))
    return f"(SELECT o_orderkey AS sql_id, concat('db', CAST(o_custkey % 10 AS VARCHAR(20))) AS db_id, CASE o_orderkey % {len(_SHAPES)} {cases} END AS sql FROM {orders})"


STATEMENTS_SQL = _statements_sql("orders")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of statements, one per order: (sql_id, db_id, sql), of shapes within and without the fragment."""
    return spark.sql("SELECT * FROM " + _statements_sql("{orders}"), orders=table(spark, sf_dir, "orders"))


def statement_pairs(spark: SparkSession, sf_dir: str, step: Column) -> DataFrame:
    """(sql_id, gold, pred): each statement with the one whose id is `step` higher.

    Both sides are dealt by id to tasks of a bounded number of statements, as
    what is done with a pair is much work on little data.
    """
    s = statements(spark, sf_dir)
    gold = s.select("sql_id", F.col("sql").alias("gold"), (F.col("sql_id") + step).alias("_o"))
    other = s.select(F.col("sql_id").alias("_o"), F.col("sql").alias("pred"))
    return dealt(gold, "_o", rows=STATEMENTS).join(dealt(other, "_o", rows=STATEMENTS), "_o").drop("_o")


def exploded_tokens(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("*", F.explode(F.split(text, " ")).alias("token"))
