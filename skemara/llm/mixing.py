"""Mixing sources to target weights: each document is repeated as its source's rate asks.

Words are summed by source, the sources share a budget by weight, and a source
that would be repeated more than `most` times is held there, its excess shared
among the others by weight until none is above. A document is taken
floor(rate) times, and once more if a number drawn from a hash of the seed, its
id and its text is below the rate's fraction.

Everything is DataFrame functions: documents are read once for their sizes;
only sums by source are shuffled, after partial sums in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemara.llm.shared import join_counted, shield, stage_table

WEIGHTS, PERCENT, MOST, SEED = (5, 2, 1), 100, 3, 13
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a draw, so that it is an exact double below one.
DIGITS = 13
MADE = ("size", "source_size", "target", "copies")
WORK = ("_source", "_draw", "_part", "_at", "_n", "_base", "_weight", "_rate")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) of the seed, the id (null: empty) and the whole text (null: empty)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long").cast("double") / float(16**DIGITS)


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, ...) with `_weight`: weights repeat along the sources by code point, null last.

    Ranks come from range partitions and counts per partition, so no task holds all sources.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order)
    held = stage_table(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-sources")
    # A row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = (F.col("_base") + F.col("_at")) % len(weights)
    return held.join(bases, "_part").withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long")).drop("_part", "_at", "_base")


def with_targets(sources: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Add `target` to sources of `source_size` and `_weight`: `percent` % of all sizes by weight, none above `most` times its own.

    Each turn is one aggregate over the sources in whole numbers; the set of
    those held at their bound only grows, so the turns end.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    total, weight = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    budget = (total or 0) * percent // 100
    left, weight, held = budget, weight or 0, -1
    while True:
        share = exact(F.col("_weight")) * exact(F.lit(left)) > exact(F.col("source_size") * most) * exact(F.lit(weight)) if weight else F.lit(True)
        n, sizes, weights = sources.agg(F.count_if(share), F.sum(F.when(share, F.col("source_size"))), F.sum(F.when(~share, F.col("_weight")))).first()
        if n == held or not weight:
            break
        held, left, weight = n, budget - most * (sizes or 0), weights or 0
    free = (F.col("_weight") * F.lit(left)).cast("double") / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(share, (F.col("source_size") * most).cast("double")).otherwise(free))


def mix_counts(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True
) -> DataFrame:
    """`docs` with size (words), source_size, target (words its source should give) and copies (how often the mix takes it), all rows.

    Null and empty texts have size 0 and are taken like others of their source;
    a source without words has target 0 and none of its documents is taken. A
    null source is a source, the last. Rows with one id draw apart if their
    texts differ, rows without an id by their texts; rows that repeat both draw
    alike. Texts of any length count whole; an empty table stays empty. Columns
    named like one of the results are renamed while this runs and dropped for
    it. With keep_text=False sizes are stored without the texts, so that these
    are read once; the result lacks them.
    """
    held, back = shield(docs, MADE + WORK)
    own = lambda name: F.col(f"`{next((k for k, v in back.items() if v == name), name)}`")
    text = own(text_col)
    key = F.coalesce(F.concat(F.lit("="), own(source_col).cast("string")), F.lit(""))
    sized = held.withColumns({"_source": key, "size": word_count(text), "_draw": draw(own(id_col), text, seed)})
    if not keep_text:
        sized = stage_table(sized.drop(text), "mix-sizes")
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    named = sums.withColumn("source", F.when(F.col("_source") != "", F.expr("substring(_source, 2)")))
    rates = with_targets(stage_table(weighted(named, weights), "mix-weights"), percent, most)
    rates = stage_table(rates.select("_source", "source_size", "target", "_n"), "mix-rates")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    joined = join_counted(sized, rates, "_source", "_n").withColumn("_rate", rate)
    copies = F.floor("_rate") + F.when(F.col("_draw") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    names = [c for c in sized.columns if c not in MADE + WORK and (c not in back or back[c].lower() not in MADE)]
    return joined.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in names), "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, **parts) -> DataFrame:
    """The mix itself: every document as often as mix_counts says, numbered from 1 in `copy` (a column of that name is replaced)."""
    taken = mix_counts(docs, **parts).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted) of each row."""
    found = mix_counts(docs.select("doc_id", "source", "text"), keep_text=False)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
