"""Record search queries: documents by text, embeddings by vector, orders by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import camel_words, highlight, phrases, stem_aliases, tokens
from skemara.operators import postings as X
from skemara.operators import retrieval as R
from skemara.registry import oracle_of, query, table

_STOP = ", ".join(f"'{w}'" for w in R.STOP)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions: the benchmark's items."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_POST = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / greatest(1, (SELECT count(*) FROM documents)) AS a)"
_Q = f"q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), t AS (SELECT * FROM q WHERE term NOT IN ({_STOP}))"


@query(f"""WITH {_POST}, {_Q}, d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY term),
s AS (SELECT query_id, p.doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM p JOIN d USING (term) JOIN t USING (term) JOIN l ON l.doc_id = p.doc_id, n GROUP BY query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def r2_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(table(spark, sf, "documents"), texts(spark, sf)).withColumn("score", F.round("score", 6))


@query("SELECT 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS text FROM customer")
def r1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.documents(table(spark, sf, "customer"), "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], "customer")


@query(f"WITH {_Q} SELECT query_id, count(*) AS n FROM t GROUP BY query_id")
def r3_search_terms(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("query_id", F.explode(R.search_terms(F.col("text")))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_POST}, {_Q}, d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY term),
s AS (SELECT query_id, p.doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) * CASE WHEN length(term) >= 5 THEN 3.0 ELSE 1.0 END), 9) AS score FROM p JOIN d USING (term) JOIN t USING (term) JOIN l ON l.doc_id = p.doc_id, n GROUP BY query_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def r4_weighted_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of five letters and more count three times."""
    q = texts(spark, sf).select("query_id", F.explode(R.search_terms(F.col("text"))).alias("term")).withColumn("weight", F.when(F.char_length("term") >= 5, 3.0).otherwise(1.0))
    return R.bm25(table(spark, sf, "documents"), q, 5).withColumn("score", F.round("score", 6))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return R.documents(table(spark, sf, "customer"), "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], "customer")


@query("""WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(c_custkey || ' | ' || c_name || ' | ' || c_mktsegment) AS t FROM customer), q AS (SELECT s_suppkey AS query_id, unnest(['building', CAST(s_suppkey AS VARCHAR)]) AS term FROM supplier),
s AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN d ON contains(d.t, q.term) GROUP BY query_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def r5_containment(spark: SparkSession, sf: str) -> DataFrame:
    """A question per supplier, answered from customers."""
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("the building "), F.col("s_suppkey").cast("string")).alias("text"))
    return R.containment(customers(spark, sf), q)


@query("SELECT CAST(item_id AS INT) AS query_id, o_orderkey, ((o_orderkey = item_id * 10)::INT + (o_custkey = item_id * 10)::INT)::DOUBLE AS score FROM orders JOIN benchmark ON o_orderkey = item_id * 10 OR o_custkey = item_id * 10")
def r6_exact_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A question per item of the benchmark, answered from all orders."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), F.concat(F.lit("order "), (F.col("item_id") * 10).cast("string"), F.lit("?")).alias("text"))
    return R.exact_numbers(table(spark, sf, "orders"), q, ["o_orderkey", "o_custkey"], "o_orderkey")


@query("""WITH q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 > 0 THEN 1992 + s_suppkey % 7 END AS y, 1 + s_suppkey % 12 AS m, CASE WHEN s_suppkey % 3 = 1 THEN 1 + s_suppkey % 28 END AS d FROM supplier)
SELECT query_id, o_orderkey, CASE WHEN d IS NOT NULL THEN 3.0 WHEN y IS NOT NULL THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM q JOIN orders ON month(o_orderdate) = m AND (y IS NULL OR year(o_orderdate) = y) AND (d IS NULL OR day(o_orderdate) = d)""")
def r7_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """A day, month or month of any year per supplier, answered from all orders."""
    k = F.col("s_suppkey")
    dates = table(spark, sf, "supplier").select(k.alias("query_id"), F.when(k % 3 > 0, 1992 + k % 7).cast("int").alias("year"), (1 + k % 12).cast("int").alias("month"), F.when(k % 3 == 1, 1 + k % 28).cast("int").alias("day"))
    return R.by_date(table(spark, sf, "orders"), dates, "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS ids, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM orders")
def r8_constraints(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Which order with id "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise("closed"), F.lit("?")).alias("text"))
    c = R.constraints(F.col("text"))
    return q.select("o_orderkey", F.array_join(F.try_element_at(c, F.lit("id")), ",").alias("ids"), F.array_join(F.try_element_at(c, F.lit("status")), ",").alias("status"))


@query("SELECT c_custkey, 76.0::DOUBLE AS score FROM customer WHERE (contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto')) AND contains(lower(c_name), '1')")
def r9_structured(spark: SparkSession, sf: str) -> DataFrame:
    return R.structured(table(spark, sf, "customer"), {"c_mktsegment": ["build", "auto"], "c_name": ["1"]}, "c_custkey")


@query("""WITH p AS (SELECT 'p_type' AS "column", p_type AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part), c AS (SELECT "column", array_to_string(regexp_extract_all(lower(v), '[a-z0-9_]+'), ' ') AS phrase, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, phrase) AS k FROM c) SELECT "column", phrase, n FROM r WHERE k <= 20""")
def r10_entities(spark: SparkSession, sf: str) -> DataFrame:
    return R.entities(table(spark, sf, "part"), ["p_type", "p_brand"], 20)


@query("SELECT p_partkey AS query_id, lower(array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), ' ')) AS phrase, 'p_name' AS \"column\" FROM part")
def r11_match_entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("who sells "), "p_name").alias("text"))
    return R.match_entities(q, R.entities(p, ["p_name"], 10_000)).drop("place")


@query("""WITH c AS (SELECT 'c_name' AS "column", c_custkey AS key, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment FROM customer), t AS (SELECT DISTINCT "column", key, unnest(regexp_extract_all(lower(v), '[a-z0-9_]+')) AS token FROM c) SELECT "column", token, count(*) AS n FROM t GROUP BY ALL""")
def r12_inverted(spark: SparkSession, sf: str) -> DataFrame:
    return R.inverted(table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"]).groupBy("column", "token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT 0 AS query_id, 'seg' AS g, c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 0, 'nation', c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 0, 'bal', c_custkey FROM customer WHERE c_acctbal > 5000),
p AS (SELECT query_id, key, count(DISTINCT g) AS groups FROM h GROUP BY ALL) SELECT * FROM p WHERE groups = (SELECT max(groups) FROM p) AND groups >= 2""")
def r13_intersection(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    part = lambda g, cond: c.filter(cond).select(F.lit(0).alias("query_id"), F.lit(g).alias("group"), F.col("c_custkey").alias("key"))
    return R.intersect_groups(part("seg", "c_mktsegment = 'BUILDING'").unionByName(part("nation", "c_nationkey = 3")).unionByName(part("bal", "c_acctbal > 5000")))


@query("WITH s AS (SELECT 0 AS query_id, o_custkey AS parent, round(sum(o_totalprice), 9) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, parent) AS rank FROM s) SELECT query_id, parent, round(score, 3) AS score, rank FROM r WHERE rank <= 10")
def r14_expand(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    hits = o.filter("o_orderstatus = 'F'").select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"))
    return R.expand(hits, o, "o_orderkey", "o_custkey").withColumn("score", F.round("score", 3))


@query("SELECT doc_id, round(2.0 * ((contains(lower(text), 'mit')::INT + contains(lower(text), 'license')::INT) / 2 + contains(lower(text), 'mit license')::INT), 6) AS bonus FROM documents")
def r15_bonus(spark: SparkSession, sf: str) -> DataFrame:
    b = R.bonus(F.col("text"), R.search_terms(F.lit("the MIT license")), F.array(F.lit("mit license")), 2.0)
    return table(spark, sf, "documents").select("doc_id", F.round(b, 6).alias("bonus"))


@query("SELECT event_id, CAST(year(ts) AS VARCHAR) AS years, strftime(ts, '%Y-%m-%d') AS dates FROM events")
def r16_date_features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("what in january of year "), F.date_format("ts", "yyyy"), F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), F.lit("?")).alias("q"))
    f = R.date_features(F.col("q"))
    return e.select("event_id", F.array_join(F.array_distinct(f["years"]), ",").alias("years"), F.array_join(f["dates"], ",").alias("dates"))


_RUNS = " || ".join(f"CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) ELSE [] END" for k in (4, 3, 2))
_ONCE = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(f"""WITH a AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS w, lower(split_part(p_type, ' ', 1)) AS word FROM part),
b AS (SELECT p_partkey, {_RUNS} AS runs, word, CASE WHEN word LIKE '%ies' THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '(ss|us|is)$') THEN word ELSE regexp_replace(word, 's$', '') END AS one FROM a),
c AS (SELECT p_partkey, runs, [word, one, CASE WHEN regexp_matches(one, '[^aeiou]y$') THEN regexp_replace(one, 'y$', 'ies') WHEN regexp_matches(one, '(s|x|ch|sh)$') THEN one || 'es' ELSE one || 's' END] AS forms FROM b)
SELECT p_partkey, array_to_string(({_ONCE.format(x='runs')})[1:8], '|') AS phrases, array_to_string({_ONCE.format(x='forms')}, ',') AS stems, 'p retail price' AS camel FROM c""")
def r17_r18_phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(phrases(tokens(F.col("p_name"))), "|").alias("phrases"), F.array_join(stem_aliases(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))), ",").alias("stems"), F.array_join(camel_words(F.lit("p_retailPrice")), " ").alias("camel"))


@query("WITH s AS (SELECT query_id, \"table\", key, max(score) AS score FROM (SELECT 0 AS query_id, 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS key, round(c_acctbal, 9) AS score FROM customer UNION ALL SELECT 0, 'supplier', CAST(s_suppkey AS VARCHAR), round(s_acctbal, 9) FROM supplier) GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, \"table\", key) AS rank FROM s) SELECT * FROM r WHERE rank <= 15")
def r19_united(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda t, k, s: table(spark, sf, t).select(F.lit(0).alias("query_id"), F.lit(t).alias("table"), F.col(k).cast("string").alias("key"), F.col(s).alias("score"))
    return R.unite([part("customer", "c_custkey", "c_acctbal"), part("supplier", "s_suppkey", "s_acctbal")], 15)


@query("""WITH d AS (SELECT doc_id, text, strpos(lower(text), 'license') AS pos FROM documents) SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN pos > 41 THEN '...' ELSE '' END || substr(text, greatest(1, pos - 40), pos + 47 - greatest(1, pos - 40)) || CASE WHEN pos + 47 <= length(text) THEN '...' ELSE '' END ELSE substr(text, 1, 80) END AS snippet FROM d""")
def r20_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", highlight(F.col("text"), F.lit("license")).alias("snippet"))


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text FROM customer")
def r21_row_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", R.row_text(["c_name", "c_mktsegment"], "c_custkey").alias("text"))


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_NEAR = """s AS (SELECT q.vec_id AS query_id, e.vec_id, round(-list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 9) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_NEAR} SELECT query_id, vec_id, rank FROM r WHERE rank <= 5")
def r22_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return R.nearest(*vectors(spark, sf), k=5).select("query_id", "vec_id", "rank")


@query(f"""WITH {_NEAR}, m AS (SELECT * FROM r WHERE rank <= 20), v AS (SELECT query_id, e.label AS target, count(*) AS votes, max(score) AS score FROM m JOIN embeddings e USING (vec_id) GROUP BY query_id, e.label),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, score DESC, target) AS rank FROM v) SELECT query_id, target, votes, rank FROM k WHERE rank <= 3""")
def r23_votes(spark: SparkSession, sf: str) -> DataFrame:
    e, q = vectors(spark, sf)
    matches = R.nearest(e, q, k=20).select("query_id", F.lit("embeddings").alias("table"), F.col("vec_id").alias("key"), "score")
    return R.vote(matches, e.select(F.lit("embeddings").alias("table"), F.col("vec_id").alias("key"), F.col("label").alias("target")), 3).select("query_id", "target", "votes", "rank")


@query(f"WITH {_NEAR}, m AS (SELECT *, round((vec_id * 31 % 97)::DOUBLE, 9) AS s2 FROM r WHERE rank <= 25), k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, vec_id) AS rank FROM m) SELECT * FROM k WHERE rank <= 5")
def r24_reranked(spark: SparkSession, sf: str) -> DataFrame:
    e, q = vectors(spark, sf)
    scores = e.select("vec_id", (F.col("vec_id") * 31 % 97).cast("double").alias("score"))
    return R.rerank(R.nearest(e, q, k=25), scores, 5, "vec_id").select("query_id", "vec_id", "rank")


@query("SELECT 'documents' AS \"table\", count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def r25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("documents")).unionByName(table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("embeddings")))


def row_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return R.graph({"customer": (c.select("c_custkey", "c_name", "c_nationkey"), "c_custkey"), "nation": (n, "n_nationkey"), "region": (r, "r_regionkey")}, [("customer", "c_nationkey", "nation"), ("nation", "n_regionkey", "region")])


@query("SELECT 'nodes' AS kind, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'edges', 2 * ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation))")
def r26_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = row_graph(spark, sf)
    return nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("nodes")).unionByName(edges.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edges")))


@query("SELECT c_custkey AS query_id, 'customer' || chr(9) || c_custkey AS node, 2.1::DOUBLE AS score FROM customer WHERE c_custkey % 20 = 0")
def r27_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Customers found by the number in their name; those with an id divisible by 20 ask."""
    nodes, _ = row_graph(spark, sf)
    q = table(spark, sf, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("text"))
    return R.seeds(nodes, q, "customer")


@query("""WITH s AS (SELECT r_regionkey AS query_id, r_regionkey, 1.0::DOUBLE AS s FROM region), h AS (SELECT query_id, 'customer' || chr(9) || c_custkey AS node, s * 0.74 * 0.74 AS s FROM s JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
r AS (SELECT query_id, node, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node) AS rank FROM h) SELECT * FROM r WHERE rank <= 5""")
def r28_walk(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = row_graph(spark, sf)
    start = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("region\t"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(1.0).alias("score"))
    return R.walk(start, edges, "customer", 2, 5).select("query_id", "node", F.round("score", 6).alias("score"), "rank")


@query("WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 50.0 ELSE 0.0 END + CASE WHEN c_acctbal > 5000 THEN 30.0 ELSE 0.0 END + CASE WHEN c_nationkey = 3 THEN 20.0 ELSE 0.0 END AS score FROM customer) SELECT c_custkey, score::DOUBLE AS score FROM s WHERE score >= CASE WHEN (SELECT max(score) FROM s) >= 70 THEN 70 ELSE 50 END ORDER BY score DESC, c_custkey LIMIT 50")
def r29_soft_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return R.soft_filter(c, [(F.col("c_mktsegment") == "BUILDING", 50.0), (F.col("c_acctbal") > 5000, 30.0), (F.col("c_nationkey") == 3, 20.0)], "c_custkey", 50)


@query("WITH a AS (SELECT c_nationkey AS query_id, c_custkey AS key, c_acctbal AS score FROM customer WHERE c_acctbal > 9000 AND c_nationkey % 2 = 0), b AS (SELECT c_nationkey AS query_id, c_custkey AS key, c_acctbal AS score FROM customer WHERE c_acctbal > 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM a)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM u) SELECT query_id, key, rank FROM r WHERE rank <= 3")
def r30_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    return R.cascade([c.filter("score > 9000 AND query_id % 2 = 0"), c.filter("score > 0")], 3).select("query_id", "key", "rank")


@query(f"WITH {_NEAR} SELECT query_id, rank, e.vec_id, label FROM r JOIN embeddings e USING (vec_id) WHERE rank <= 5")
def r31_expanded(spark: SparkSession, sf: str) -> DataFrame:
    e, q = vectors(spark, sf)
    return R.nearest(e, q, k=5).join(e.select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "label")


@query("SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) > 0 THEN avg(o_totalprice) END AS mean FROM orders GROUP BY o_orderpriority")
def r32_guarded(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("guarded_orders")
    return R.guarded(spark, "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean FROM guarded_orders GROUP BY o_orderpriority;")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, (q.label = e.label)::INT + (q.vec_id % 3 = e.vec_id % 3)::INT AS tags, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(tags + score, 9) DESC, vec_id) AS rank FROM n WHERE k <= 15) SELECT * FROM r WHERE rank <= 5""")
def r33_examples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("tags", F.array(F.concat(F.lit("l"), F.col("label").cast("string")), (F.col("vec_id") % 3).cast("string")))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "tags")
    return R.similar_examples(e, q, 5).select("query_id", "vec_id", "rank")


@query("WITH m AS (SELECT c_nationkey AS query_id, c_custkey AS key, 1 AS mode FROM customer WHERE c_acctbal > 3000 UNION ALL SELECT c_nationkey, c_custkey, 2 FROM customer WHERE c_acctbal < 6000), p AS (SELECT query_id, key, count(DISTINCT mode) AS m FROM m GROUP BY ALL) SELECT query_id, CAST(sum((m = 2)::INT) AS BIGINT) AS common, CAST(sum((m = 1)::INT) AS BIGINT) AS single, count(*) AS n, avg((m = 2)::INT) AS share FROM p GROUP BY query_id")
def r34_mode_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("key"), "c_acctbal")
    both = c.filter("c_acctbal > 3000").withColumn("mode", F.lit(1)).unionByName(c.filter("c_acctbal < 6000").withColumn("mode", F.lit(2)))
    return R.compare_modes(both, 2)


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def r35_preprocessed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", R.preprocess(F.col("text"), ["identity", "whitespace"]).alias("text"))


# Searches over stored postings: the index is built, a part of the documents changes and a part goes, and questions read postings only.
_NOW = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(text, ' revised and revised ', CAST(doc_id AS VARCHAR)) ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0)"


def stored_index(spark: SparkSession, sf: str) -> X.Index:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    changed = docs.filter("doc_id % 10 = 0 AND doc_id % 17 <> 0").withColumn("text", F.concat("text", F.lit(" revised and revised "), F.col("doc_id").cast("string")))
    return X.update(X.build(docs, "doc_id", X.text_terms()), changed, "doc_id", X.text_terms(), docs.filter("doc_id % 17 = 0").select("doc_id"))


@query(oracle_of("r2_bm25").replace("FROM documents", f"FROM {_NOW} AS documents"))
def r2_stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = X.search(stored_index(spark, sf), texts(spark, sf))
    return hits.select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("""WITH c AS (SELECT c_custkey AS key, 'c_mktsegment' AS g, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer), t AS (SELECT DISTINCT key, g, unnest(regexp_extract_all(lower(v), '[a-z0-9_]+')) AS token FROM c),
q AS (SELECT n_nationkey AS query_id, g, token FROM nation, (VALUES ('c_mktsegment', 'building'), ('c_name', 'customer')) AS w(g, token) UNION ALL SELECT n_nationkey, 'c_name', printf('%09d', n_nationkey) FROM nation),
h AS (SELECT DISTINCT query_id, q.g, key FROM q JOIN t ON t.g = q.g AND t.token = q.token), p AS (SELECT query_id, key, count(*) AS groups FROM h GROUP BY ALL) SELECT * FROM p WHERE groups = 2 AND query_id % 5 = 0""")
def r12_r13_stored_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that match both columns' words, from a stored index per column; every fifth nation is a question."""
    index = X.build(table(spark, sf, "customer"), "c_custkey", X.column_terms(["c_name", "c_mktsegment"]))
    number = F.format_string("c_name=%09d", F.col("n_nationkey"))
    words = F.array(F.struct(F.lit("c_mktsegment").alias("group"), F.lit("c_mktsegment=building").alias("term")), F.struct(F.lit("c_name").alias("group"), F.lit("c_name=customer").alias("term")), F.struct(F.lit("c_name").alias("group"), number.alias("term")))
    asked = table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("query_id"), F.inline(words))
    return R.intersect_groups(X.lookup(index, asked).drop("term"))


@query("""WITH RECURSIVE d AS (SELECT phrase, min("column") AS "column" FROM (SELECT DISTINCT 'p_type' AS "column", array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9_]+'), ' ') AS phrase FROM part UNION ALL SELECT DISTINCT 'p_brand', array_to_string(regexp_extract_all(lower(p_brand), '[a-z0-9_]+'), ' ') FROM part UNION ALL SELECT DISTINCT 'p_name', array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), ' ') FROM part) WHERE phrase <> '' AND len(string_split(phrase, ' ')) <= 5 GROUP BY phrase),
q AS (SELECT p_partkey AS query_id, regexp_extract_all(lower(p_type || ' for ' || p_brand || ' or ' || p_type || ' ' || p_name), '[a-z0-9_]+') AS w FROM part),
g AS (SELECT query_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM q, range(1, 40) AS a(i), range(1, 6) AS b(n) WHERE i + n - 1 <= len(w)),
h AS (SELECT query_id, i, max_by(phrase, n) AS phrase, max_by("column", n) AS "column", max(n) AS n FROM g JOIN d USING (phrase) GROUP BY query_id, i),
s AS (SELECT query_id, 1 AS i, CAST(NULL AS VARCHAR) AS phrase, CAST(NULL AS VARCHAR) AS "column" FROM q UNION ALL SELECT s.query_id, s.i + coalesce(h.n, 1), h.phrase, h."column" FROM s JOIN q USING (query_id) LEFT JOIN h ON h.query_id = s.query_id AND h.i = s.i WHERE s.i <= len(q.w)),
f AS (SELECT query_id, phrase, any_value("column") AS "column", min(i) AS spot FROM s WHERE phrase IS NOT NULL GROUP BY ALL)
SELECT query_id, phrase, "column", CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS INT) AS place FROM f""")
def r11_longest_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Several columns' phrases in one question, one of them twice, in the order of the text."""
    p = table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat("p_type", F.lit(" for "), "p_brand", F.lit(" or "), "p_type", F.lit(" "), "p_name").alias("text"))
    return R.match_entities(q, R.entities(p, ["p_type", "p_brand", "p_name"], 1_000_000))
