"""Generation to quota over the test tables, from two targets and all classes; keys that play roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.operators import catalog as P
from skemara.operators import cejsq as J
from skemara.operators import generate as G
from skemara.plans.catalog import SCHEMA, tables
from skemara.registry import query

CLASSES = [p + t for p in ("0", "1p", "2p", "3p", "2i", "3i", "4i") for t in "EMH"]
#: What predicates may use: columns that are no keys.
FILTERS = {
    "region": [("r_name", "LABEL")], "nation": [("n_name", "LABEL")], "customer": [("c_name", "LABEL"), ("c_acctbal", "NUMERIC"), ("c_mktsegment", "ENUM")], "supplier": [("s_name", "LABEL"), ("s_acctbal", "NUMERIC")],
    "part": [("p_brand", "ENUM"), ("p_type", "ENUM"), ("p_size", "NUMERIC"), ("p_retailprice", "NUMERIC")], "orders": [("o_orderstatus", "ENUM"), ("o_totalprice", "NUMERIC"), ("o_orderdate", "DATE"), ("o_orderpriority", "ENUM")],
    "lineitem": [("l_quantity", "NUMERIC"), ("l_extendedprice", "NUMERIC"), ("l_returnflag", "ENUM"), ("l_shipdate", "DATE")],
}


def inputs(spark: SparkSession, sf: str, target: str) -> tuple[P.Tables, P.Schema, dict]:
    return tables(spark, sf), P.Schema(target, SCHEMA.primary, SCHEMA.foreign), FILTERS


def _generated(spark: SparkSession, sf: str, target: str) -> tuple[DataFrame, DataFrame]:
    t, schema, filters = inputs(spark, sf, target)
    # The join of all lines has a row per line, times what hangs on it.
    return G.generate(t, schema, dict.fromkeys(CLASSES, 3), filters, tries=3, sample=128)


@query()
def q4_generated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of all classes over orders, each with its text and answers."""
    return _generated(spark, sf, "orders")[0].select("number", "strategy", "attempt", "sql", F.size("answers").alias("n"), F.array_join("answers", ",").alias("answers"))


@query()
def v6_generation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas, attempts and reasons of all classes over nations: most answers of a class are too many there."""
    return _generated(spark, sf, "nation")[1]


#: Two keys from orders to customers.
ROLES = P.Schema("orders", SCHEMA.primary, [P.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",), name="buyer"), P.ForeignKey("orders", ("o_orderkey",), "customer", ("c_custkey",), name="twin")])


@query("""SELECT a.c_mktsegment AS buyer, b.c_mktsegment AS twin, count(*) AS n FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON o_orderkey = b.c_custkey GROUP BY ALL""")
def j3_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer who bought and the customer of the order's own number: one table in two roles."""
    frame = J.joined(tables(spark, sf), ROLES, ("orders", "customer", "customer"), True, {"customer": ["c_mktsegment"]}, ("buyer", "twin"))
    return frame.groupBy(F.col("c_mktsegment_customer").alias("buyer"), F.col("c_mktsegment_customer__1").alias("twin")).agg(F.count(F.lit(1)).alias("n"))
