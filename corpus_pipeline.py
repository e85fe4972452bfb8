"""A corpus pipeline over documents: quality rules, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before has kept; all but the last return the columns of documents, and further
columns that the table has. Texts are read whole whatever their length. An
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skemara.llm.exact_dedup import drop_exact
from skemara.llm.packing import pack
from skemara.llm.quality_rules import drop_failed
from skemara.llm.shared import stage_table
from skemara.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    Null and empty texts have no words and go. Documents without a source are
    one host's. Repeated rows and rows without an id are judged like any other.
    """
    return drop_failed(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Of rows that repeat id and text one stays; a row without an id stays only
    if no other row has its text and an id.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 on words of five the one with the smallest doc_id stays.

    Rows are told apart by id and text, so an id that two unlike texts share
    loses neither; a row without an id stays only if its group has none with one.
    """
    return drop_near(docs, shingle=5, similarity=(4, 5))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left, a row for each; rows without an id come first."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("packing", packing)]

#: The near stage's components and the buckets' dynamic program have no SQL; a test runs a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage_table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
