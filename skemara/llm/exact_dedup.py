"""Exact duplicates by content sort.

Rows are dealt by sampled splitters over (head of the text, hash, salt), sorted
externally by the whole text within each partition, so that equal texts stand
next to each other, and a window closes a run where two neighbours differ in
full. A text that holds more than a thousandth of the rows is first salted by a
hash of the row, so that its copies lie in many partitions, the more the larger
its share; the salts' winners, a bounded number, are then compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemara.llm.shared import shield, stage_table

#: A text is hot if it has at least this many rows and this share of all rows; so at most 1/HOT_SHARE texts are hot. Each salt has about this share.
HOT_ROWS, HOT_SHARE = 1000, 1 / 1024
HEAD = 32


MADE = ("keep_id", "group_size", "kept", "text_sha256")
#: Names that columns have on the way.
WORK = ("_text", "_hash", "_head", "_salt", "_salts", "_whole", "_rank", "_keep", "_size", "_first", "_n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "min", keep_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept and text_sha256, beside `docs`' other columns (the text if `keep_text`).

    `normalise` maps the text column before comparison (None: no change).
    `keep` says whether the smallest or the largest identifier of a group stays.
    A null text counts as empty; texts of any length are compared whole. A null
    identifier stays only if its group has no other; of rows that repeat text
    and identifier exactly one stays. An empty table gives an empty result.
    Other columns pass through; columns named like the results are replaced.
    """
    docs, back = shield(docs, WORK)
    others = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in MADE]
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    more = []
    if keep_text:
        more = ["_whole"]
        # Without a normalisation the compared text is the text, unless it was null.
        docs = docs.withColumn("_whole", F.col(text_col) if normalise else F.when(F.col(text_col).isNull(), False))
    rows = docs.select(id_col, *others, *more, (normalise(text) if normalise else text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))

    total = docs.count()
    # At most 1/HOT_SHARE rows.
    hot = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(HOT_ROWS, total * HOT_SHARE))
    hot = stage_table(hot.select("_hash", F.ceil(F.col("_n") / max(1.0, total * HOT_SHARE)).alias("_salts")), "hot-texts")
    rows = rows.withColumn("_head", F.substring("_text", 1, HEAD))
    salts = []
    if hot.count():
        salts = ["_salt"]
        rows = rows.join(F.broadcast(hot), "_hash", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.col("_salts")), F.lit(-1)).cast("int")).drop("_salts")

    best = F.max if keep == "max" else F.min
    first = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    run = Window.partitionBy("_head", "_hash", *salts, "_text")
    found = rows.repartitionByRange("_head", "_hash", *salts).select(
        id_col, *others, *more, "_hash", *salts, "_text",
        F.row_number().over(run.orderBy(first)).alias("_rank"),
        best(id_col).over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
    )
    found = found.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    if salts:
        winners = found.filter("_rank = 1 AND _salt >= 0").select("text_sha256", "_salt", "keep_id", "group_size")
        # Of salts that share the best identifier the first one's row stays.
        per = winners.groupBy("text_sha256").agg(best("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
        which = winners.join(F.broadcast(per), "text_sha256").filter(F.col("keep_id").eqNullSafe(F.col("_keep"))).groupBy("text_sha256").agg(F.min("_salt").alias("_first"), F.first("_keep").alias("_keep"), F.first("_size").alias("_size"))
        # A row per hot text: at most 1/HOT_SHARE.
        found = found.join(F.broadcast(which), "text_sha256", "left").withColumns({
            "_rank": F.when(F.col("_size").isNull() | ((F.col("_salt") == F.col("_first")) & F.col("keep_id").eqNullSafe(F.col("_keep"))), F.col("_rank")),
            "keep_id": F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")),
            "group_size": F.coalesce("_size", "group_size"),
        })
    kept = F.coalesce((F.col("_rank") == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")), F.lit(False))
    whole = [(F.col("_whole") if normalise else F.when(F.col("_whole").isNull(), F.col("_text"))).alias(text_col)] if keep_text else []
    return found.select(id_col, *others, *whole, "keep_id", "group_size", kept.alias("kept"), "text_sha256").withColumnsRenamed(back)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "min") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see exact_groups."""
    own, back = shield(docs, MADE)
    found = exact_groups(own, id_col, text_col, normalise, keep, keep_text=True).filter("kept")
    return found.select(*own.columns).withColumnsRenamed(back)
