"""Round trips through the sources and sinks, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.operators.catalog import lower_names
from skemara.plans.catalog import SCHEMA, key_rows, tables
from skemara.plans.derived import RECORDS_SQL, STATEMENTS_SQL, records, statements
from skemara.registry import query, table
from skemara.sources import readers as I
from skemara.sources import writers as O
from skemara.sources.scratch import scratch


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1_csv_tables(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "csv")
    for n in ("customer", "region"):
        table(spark, sf, n).write.option("header", True).csv(f"{folder}/{n}.csv")
    return I.connect("csv", spark, folder=folder, target="customer")["customer"].select(F.col("c_custkey").cast("long"), "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def s2_s29_named_tables(spark: SparkSession, sf: str) -> DataFrame:
    found, missing = I.named_tables(I.parquet_tables(spark, sf, ["region", "nation", "part"]), ["Nation", "REGION", "lost"])
    assert missing == ["lost"]
    out = None
    for n, df in sorted(found.items()):
        part = df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s3_s4_database(spark: SparkSession, sf: str) -> DataFrame:
    """Through an embedded database, which lives in the driver: the scan is one that only a driver-side engine can serve here."""
    url = f"jdbc:derby:memory:{spark.sparkContext.applicationId.replace('-', '')}{abs(hash(sf)) % 10**6};create=true"
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.mode("overwrite").jdbc(url, "SUPPLIER", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    out = I.connect("database", spark, url=url, names=["SUPPLIER"], keys={"SUPPLIER": ("s_suppkey", 0, 1000, 4)}, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")["supplier"]
    return out.toDF(*[c.lower() for c in out.columns])


@query("SELECT 'fk' || (c_custkey % 50) AS child_table, 'a' || (c_custkey % 50) || ',b' || (c_custkey % 50) AS columns FROM customer GROUP BY ALL")
def s5_declared_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "customer").select((F.col("c_custkey") % 50).cast("string").alias("k")).distinct()
    rows = k.select("k", F.explode(F.array(F.struct(F.lit(2).alias("position"), F.lit("b").alias("c")), F.struct(F.lit(1).alias("position"), F.lit("a").alias("c")))).alias("x"))
    rows = rows.select(F.concat(F.lit("c"), "k").alias("constraint"), "x.position", F.concat(F.lit("fk"), "k").alias("child_table"), F.concat("x.c", "k").alias("child_column"), F.lit("p").alias("parent_table"), F.col("x.c").alias("parent_column"))
    return I.declared_keys(rows).select("child_table", F.array_join("child_columns", ",").alias("columns"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def s10_s11_materialised(spark: SparkSession, sf: str) -> DataFrame:
    out = O.materialise({"orders_by_customer": table(spark, sf, "orders")}, scratch(spark, "tables"), {"orders_by_customer": "o_custkey"})
    return out["orders_by_customer"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


_FKS = ", ".join(f"('{f.child}', '{f.columns[0]}', '{f.parent}', '{f.parent_columns[0]}')" for f in SCHEMA.foreign)


@query(f"SELECT 'db' || k AS db_id, v.* FROM (SELECT DISTINCT c_nationkey AS k FROM customer), (VALUES {_FKS}) AS v(child_table, child_column, parent_table, parent_column)")
def s12_to_s15_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """A schema per nation through JSON, then through the index-encoded form and back."""
    path = scratch(spark, "schema") + "/schema.json"
    O.save_schema(spark, SCHEMA, path)
    schema = I.read_schema(spark, path)
    dbs = table(spark, sf, "customer").select(F.concat(F.lit("db"), F.col("c_nationkey").cast("string")).alias("db_id")).distinct()
    cols = spark.createDataFrame([(t, f.name, i, f.dataType.simpleString()) for t, df in tables(spark, sf).items() for i, f in enumerate(df.schema.fields)], "table string, column string, ordinal int, dtype string")
    fks = key_rows(spark, schema)
    every = lambda df: df.withColumn("_k", F.lit(1)).join(dbs.withColumn("_k", F.lit(1)), "_k").drop("_k")
    coded = O.encode_catalog(every(cols), every(fks), "orders")
    return I.decode_catalog(coded)[1].drop("coverage")


@query("SELECT 'db' || p_partkey AS db_id, 'child' AS child_table, 'a' || p_size AS child_column, 'parent' AS parent_table, 'id' AS parent_column FROM part")
def s16_ddl(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    text = F.concat(F.lit("CREATE TABLE parent (id INT PRIMARY KEY, name VARCHAR(20));\nCREATE TABLE child (\n  a"), F.col("p_size").cast("string"), F.lit(" INT, price DECIMAL(10,2), -- a note\n  FOREIGN KEY (a"), F.col("p_size").cast("string"), F.lit(") REFERENCES parent(id)\n);"))
    return I.parse_ddl(p.select(F.concat(F.lit("db"), F.col("p_partkey").cast("string")).alias("db_id"), text.alias("ddl")))[1]


@query(f"SELECT db_id, model, CAST(uid AS VARCHAR) AS uid, correct FROM {RECORDS_SQL} WHERE status = 'ok'")
def s17_s18_shards(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "shards")
    r = records(spark, sf)
    rows = r.select("db_id", "model", F.col("uid").cast("string").alias("uid"), "strategy", "correct", "status", "latency_s", "row_f1")
    O.evaluation_shards(rows).write.text(f"{folder}/shards")
    raw = spark.read.schema(I.SHARD).json(f"{folder}/shards")
    raw.select(F.to_json(F.struct("*")).alias("value"), "model").write.partitionBy("model").json(f"{folder}/keep")
    out = raw.select("db_id", F.coalesce("model", "tag").alias("model"), F.explode("records").alias("r")).select("db_id", "model", "r.*")
    return out.filter("status = 'ok'").select("db_id", "model", "uid", "correct")


@query(f"SELECT substr(sha256(sql), 1, 16) AS uid, sql FROM {STATEMENTS_SQL}")
def s19_s22_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All statements through pair files without identifiers, which are made again on reading."""
    folder = scratch(spark, "pairs") + "/pairs"
    O.pair_documents(statements(spark, sf).select("db_id", F.lit("q").alias("question"), "sql")).write.option("lineSep", "\n").text(folder)
    lines = spark.read.text(folder)
    items = F.from_json("value", f"struct<qa_pairs:array<{I.PAIR}>>")["qa_pairs"]
    from skemara.functions.scalar import sql_uid

    return lines.select(F.explode(items).alias("p")).select(F.coalesce("p.uid", sql_uid(F.col("p.sql"))).alias("uid"), "p.sql")


@query(f"SELECT 'strategy' AS axis, strategy AS key, count(*) AS n FROM {RECORDS_SQL} GROUP BY strategy UNION ALL SELECT 'tier', tier, count(*) FROM {RECORDS_SQL} GROUP BY tier")
def s20_s21_s24_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions written as JSON, CSV and Markdown, found again by name and read back."""
    folder = scratch(spark, "summary")
    d = O.distributions(records(spark, sf))
    O.write_summary(d, d, folder, "run")
    return spark.read.option("header", True).csv(f"{folder}/run_classes.csv").select("axis", "key", F.col("n").cast("long").alias("n"))


_SYS = "Write the SQL that answers the question."


@query(f"""SELECT '{{"instruction":"{_SYS}","input":"q' || sql_id || '","output":"' || replace(sql, '"', '\\"') || '"}}' AS value FROM {STATEMENTS_SQL} WHERE sql_id % 3 > 0""")
def s23_tuning_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).select("sql", F.concat(F.lit("q"), F.col("sql_id").cast("string")).alias("question"), (F.col("sql_id") % 3 > 0).alias("is_valid"))
    return O.tuning_rows(s, "alpaca")


def _turns(a: str, b: str, system: str, user: str, reply: str) -> str:
    part = lambda who, what: f'{{"{a}":"{who}","{b}":"\' || {what} || \'"}}'
    return ",".join(part(w, x) for w, x in ((system, f"'{_SYS}'"), (user, "q"), (reply, "s")))


@query(f"""WITH p AS (SELECT 'q' || sql_id AS q, replace(sql, '"', '\\"') AS s FROM {STATEMENTS_SQL} WHERE sql_id % 3 > 0)
SELECT '{{"conversations":[{_turns('from', 'value', 'system', 'human', 'gpt')}]}}' AS value FROM p UNION ALL SELECT '{{"messages":[{_turns('role', 'content', 'system', 'user', 'assistant')}]}}' FROM p
UNION ALL SELECT '{{"contents":[{{"role":"user","parts":[{{"text":"{_SYS}\\n' || q || '"}}]}},{{"role":"model","parts":[{{"text":"' || s || '"}}]}}]}}' FROM p""")
def s23_tuning_forms(spark: SparkSession, sf: str) -> DataFrame:
    s = statements(spark, sf).select("sql", F.concat(F.lit("q"), F.col("sql_id").cast("string")).alias("question"), (F.col("sql_id") % 3 > 0).alias("is_valid"))
    return O.tuning_rows(s, "sharegpt").unionByName(O.tuning_rows(s, "openai")).unionByName(O.tuning_rows(s, "gemini"))


@query("SELECT r_regionkey, r_name FROM region")
def s7_connectors(spark: SparkSession, sf: str) -> DataFrame:
    """A connector that a user has registered."""
    I.register("regions")(lambda spark, folder: {"region": spark.read.parquet(f"{folder}/region.parquet")})
    return I.connect("regions", spark, folder=sf)["region"].select("r_regionkey", "r_name")


@query("SELECT 'region' AS target, count(*) AS n FROM region UNION ALL SELECT 'lost', NULL")
def s8_target_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a target table that is there, and null for one that loading refuses."""
    out = I.connect("parquet", spark, folder=sf, names=["region", "nation"], target="region")["region"].agg(F.lit("region").alias("target"), F.count(F.lit(1)).alias("n"))
    try:
        I.connect("parquet", spark, folder=sf, names=["region", "nation"], target="lost")
    except ValueError:
        return out.unionByName(spark.createDataFrame([("lost", None)], "target string, n long"))
    return out


@query("SELECT 'customer' AS \"table\", c_custkey, c_name FROM customer")
def s9_lower_names(spark: SparkSession, sf: str) -> DataFrame:
    """A table whose names are in upper case, after loading."""
    c = table(spark, sf, "customer")
    name, df = next(iter(lower_names({"CUSTOMER": c.toDF(*[x.upper() for x in c.columns])}).items()))
    return df.select(F.lit(name).alias("table"), *(x for x in df.columns if x in ("c_custkey", "c_name")))


@query(f"SELECT model, db_id, count(*) AS n, avg(latency_s) AS latency FROM {RECORDS_SQL} GROUP BY ALL")
def s25_s27_resumable(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the shards are written, the rest found and added."""
    path = scratch(spark, "run") + "/records"
    r = O.with_provenance(records(spark, sf).withColumn("half", F.crc32("db_id") % 2), tool="skemara", seed="5")
    O.write_resumable(r.filter("half = 0"), path, ["model", "db_id"])
    rest = O.todo(r.filter("half = 1 OR model = 'ash'"), spark.read.parquet(path).select("model", "db_id"), ["model", "db_id"])
    O.write_resumable(rest, path, ["model", "db_id"])
    return spark.read.parquet(path).groupBy("model", "db_id").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_s").alias("latency"))


@query("SELECT source AS db_id, CASE WHEN lang = 'en' THEN text || ' Hint: ' || lang ELSE text END AS question, CAST(doc_id AS VARCHAR) AS sql FROM documents")
def s28_gold_questions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    raw = d.select(F.col("source").alias("db_id"), F.col("text").alias("question"), F.col("doc_id").cast("string").alias("query"), F.when(F.col("lang") == "en", F.col("lang")).alias("evidence"))
    return I.gold_questions(raw, hint="evidence")


@query(f"SELECT model AS mode, db_id, count(*) AS n, min(uid) AS first_uid FROM {RECORDS_SQL} GROUP BY ALL")
def s30_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records written as JSON, read back, and summed over their parts."""
    path = scratch(spark, "evaluation") + "/run"
    d = O.evaluation_document(records(spark, sf).select(F.col("model").alias("mode"), "db_id", "uid", "correct", "latency_s"), 20)
    d.write.json(path)
    back = spark.read.schema(d.schema).json(path)
    return back.groupBy("mode", "db_id").agg(F.sum("n").alias("n"), F.min(F.get("results", F.lit(0))["uid"]).alias("first_uid"))


@query("SELECT 'orders' AS name UNION ALL SELECT 'region'")
def s6_s26_readable(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = I.readable(spark, {n: (lambda n=n: table(spark, sf, n)) for n in ("region", "no_such_table", "orders")})
    assert bad.count() == 1
    return spark.createDataFrame([(n,) for n in sorted(good)], "name string")


