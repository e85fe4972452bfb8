"""Quotas over structure classes, sampling, splits and reports. Random choices follow an integer hash, ties the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemara.functions.scalar import PRIME, key_number, mix, normal_question, sql_uid
from skemara.sources.scratch import small, stored


def class_weights(classes: DataFrame, explicit: DataFrame | None = None, tier_weights: DataFrame | None = None) -> DataFrame:
    """(strategy, tier, ordinal, weight), weights summing to 1 over the feasible classes: explicit ones, tier weights spread evenly, or uniform."""
    out = classes.filter("feasible")
    if explicit is not None:
        out = out.join(explicit.select("strategy", F.col("weight").alias("w")), "strategy")
    elif tier_weights is not None:
        out = out.join(tier_weights.select("tier", F.col("weight").alias("w")), "tier").withColumn("w", F.col("w") / F.count(F.lit(1)).over(Window.partitionBy("tier")))
    else:
        out = out.withColumn("w", F.lit(1.0))
    return out.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).drop("w")


def largest_remainder(weights: DataFrame, total: int) -> DataFrame:
    """`weights` with quota: floors of total * weight, what is left going to the largest fractions, earliest first. Quotas sum to `total`."""
    every = Window.partitionBy(F.lit(1))
    raw = F.bround(F.col("weight") * total, 9)
    out = weights.withColumns({"_base": F.floor(raw).cast("long"), "_frac": F.bround(raw - F.floor(raw), 9)})
    out = out.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("_frac"), "ordinal"))).withColumn("_left", F.lit(total) - F.sum("_base").over(every))
    return out.withColumn("quota", (F.col("_base") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_base", "_frac", "_n", "_left")


def draw_classes(weights: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(draw, strategy): `count` classes drawn by weight; the cumulative weights are few rows, joined by range."""
    upto = F.sum("weight").over(Window.orderBy("ordinal"))
    bands = weights.select("strategy", (upto - F.col("weight")).alias("low"), upto.alias("high"), F.row_number().over(Window.orderBy(F.desc("ordinal"))).alias("_r"))
    u = weights.sparkSession.range(count).select(F.col("id").alias("draw"), (mix("id", seed) / 2147483647.0).alias("u"))
    return u.join(F.broadcast(bands), (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | (F.col("_r") == 1))).select("draw", "strategy")


def accept(candidates: DataFrame, quotas: DataFrame) -> DataFrame:
    """The accepted candidates of each class, earliest attempts first, up to its quota."""
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy("attempt"))
    return candidates.filter("outcome = 'ok'").withColumn("_n", rank).join(quotas.select("strategy", "quota"), "strategy").filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def distinct_pairs(pairs: DataFrame, order: str, sql: str = "sql", question: str = "question") -> DataFrame:
    """The first pair of each statement, then the first of each question after normalisation."""
    one = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(sql).orderBy(order))).filter("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(normal_question(F.col(question))).orderBy(order))).filter("_n = 1").drop("_n")


def shortfall(candidates: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per class: quota, accepted, shortfall, fulfilment, attempts, and the most frequent reason of failure."""
    ok = F.col("outcome") == "ok"
    per = candidates.groupBy("strategy").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("_ok"), F.count(F.lit(1)).alias("attempts"))
    why = candidates.filter(~ok).groupBy("strategy", "outcome").agg(F.count(F.lit(1)).alias("c"))
    why = why.groupBy("strategy").agg(F.min_by("outcome", F.struct(-F.col("c"), F.col("outcome"))).alias("reason"))
    out = quotas.select("strategy", "quota").join(per, "strategy", "left").join(why, "strategy", "left").fillna(0, ["_ok", "attempts"])
    out = out.withColumn("accepted", F.least("_ok", "quota").cast("long")).withColumn("shortfall", F.col("quota") - F.col("accepted"))
    return out.withColumn("fulfilment", F.when(F.col("quota") > 0, F.col("accepted") / F.col("quota")).otherwise(1.0)).withColumn("reason", F.when(F.col("shortfall") > 0, F.col("reason"))).drop("_ok")


def aggregate_reports(reports: DataFrame, by: str | None = None) -> DataFrame:
    """Sums of per-class report rows (db_id, strategy, quota, accepted, shortfall, reason), by a column or over all."""
    keys = [by] if by else []
    sums = reports.groupBy(*keys).agg(F.sum("quota").alias("quota"), F.sum("accepted").alias("accepted"), F.sum("shortfall").alias("shortfall"), (F.sum("accepted") / F.sum("quota")).alias("fulfilment"))
    why = reports.filter("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.sum("shortfall").alias("c"))
    why = why.groupBy(*keys).agg(F.min_by("reason", F.struct(-F.col("c"), F.col("reason"))).alias("top_reason"))
    return sums.join(why, keys, "left") if keys else sums.withColumn("_k", F.lit(1)).join(why.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def entropy_by(rows: DataFrame, group: str, cls: str, classes: int) -> DataFrame:
    """Normalised Shannon entropy of class counts per group: 1.0 for one class at most."""
    counts = rows.groupBy(group, cls).agg(F.count(F.lit(1)).alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(group)))
    bits = F.sum(-F.col("p") * F.log("p")) / F.log(F.lit(float(classes)))
    return counts.groupBy(group).agg((bits if classes > 1 else F.lit(1.0)).alias("entropy"), F.count(F.lit(1)).cast("long").alias("populated"))


def counter_text(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Counts of a key per group as "k:v; ..." by count descending, then key; and the top key."""
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("c"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), F.col(key).alias("k"))))
    return counts.groupBy(group).agg(parts.alias("_p")).select(group, F.array_join(F.transform("_p", lambda x: F.concat(x["k"], F.lit(":"), (-x["n"]).cast("string"))), "; ").alias("text"), F.get("_p", F.lit(0))["k"].alias("top"))


#: Stretches of the hash's range in which a class is ranked.
STRETCHES = 1024


def hash_ranked(rows: DataFrame, by: list[str], key: str, seed: int = 0, rep: Column | int = 0) -> DataFrame:
    """`rows` with _r, the rank by (hash of key, key) within the columns `by`, and _n, the rows of that class. Keys are integers or texts.

    A class is ranked in stretches of the hash's range, each a task of its own
    at most, and a stretch starts after all that the stretches before it hold;
    so a class with a large share of all rows is no one task's.
    """
    h = mix(key_number(rows, key), seed, rep)
    marked = rows.withColumns({"_h": h, "_s": F.floor(h * STRETCHES / PRIME).cast("int")})
    counts = marked.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(*by, "_s", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n")), "offsets")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    out = marked.alias("x").join(small(offsets).alias("o"), reduce(lambda p, q: p & q, same, F.col("x._s") == F.col("o._s")))
    rank = F.row_number().over(Window.partitionBy(*(f"x.{c}" for c in by), "x._s").orderBy("_h", key))
    return out.select("x.*", "_n", (F.col("_before") + rank).alias("_r")).drop("_h", "_s")


def stratified_split(rows: DataFrame, by: str, key: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """`rows` with split: of each class floor(n * test) to test, floor(n * val) to val, the rest to train."""
    out = hash_ranked(rows, [by], key, seed)
    t, v = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    return out.withColumn("split", F.when(F.col("_r") <= t, "test").when(F.col("_r") <= t + v, "val").otherwise("train")).drop("_n", "_r")


def group_split(rows: DataFrame, group: str, ratio: float, seed: int = 0) -> DataFrame:
    """`rows` with split: whole groups (databases) go to val, the share `ratio` of them, one at least. Groups are ranked by MD5 of seed and name; they are few (one per database)."""
    groups = rows.select(group).distinct()
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")).cast("binary")), group)
    ranked = groups.withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    marked = ranked.select(group, F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)), "val").otherwise("train").alias("split"))
    return rows.join(marked, group)


def round_robin(rows: DataFrame, by: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """A stratified sample: one row of each class in turn, classes in order, until `limit`.

    A row's place follows from its rank and from how many rows the classes
    have (few, one array), so no task orders all classes' rows.
    """
    ranked = hash_ranked(rows, [by], key, seed).filter(F.col("_r") <= limit)
    classes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct(F.col(by).alias("c"), "n")).alias("_all"))
    met = ranked.join(F.broadcast(classes))
    turns = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], F.col("_r") - 1))
    same = F.size(F.filter("_all", lambda x: (x["n"] >= F.col("_r")) & F.coalesce(x["c"] <= F.col(by), x["c"].isNull())))
    return met.withColumn("place", (turns + same).cast("int")).filter(F.col("place") <= limit).drop("_r", "_n", "_all")


def even_cap(rows: DataFrame, by: str, key: str, total: int, classes: int, seed: int = 0) -> DataFrame:
    """floor(total / classes) rows of each class at most."""
    return hash_ranked(rows, [by], key, seed).filter(F.col("_r") <= total // classes).drop("_r", "_n")


def matched_control(rows: DataFrame, pool: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Of `pool` as many rows per group as `rows` has, or all if it has fewer, with an identifier made from the row's own."""
    want = rows.groupBy(group).agg(F.count(F.lit(1)).alias("want"))
    ranked = hash_ranked(pool.join(want, group), [group], key, seed).drop("_n").filter(F.col("_r") <= F.col("want"))
    return ranked.withColumn("uid", F.substring(F.sha1(F.concat_ws(":", F.lit("control"), F.col(group).cast("string"), F.col(key).cast("string"))), 1, 16)).drop("_r", "want")


def quota_matched(pool: DataFrame, demand: DataFrame, by: str, key: str, reps: int, seed: int = 0) -> DataFrame:
    """(rep, key, class): replicates of the largest sample whose class shares follow `demand` (class, share) within what `pool` has."""
    have = pool.groupBy(by).agg(F.count(F.lit(1)).alias("have"))
    size = demand.filter("share > 0").join(have, by, "left").fillna(0, ["have"]).agg(F.floor(F.min(F.col("have") / F.col("share"))).alias("n"))
    # One row; its value is a size, so it goes by way of the driver.
    n = size.first()["n"] or 0
    take = demand.withColumn("take", F.floor(F.bround(F.col("share") * n, 6)).cast("long"))
    each = pool.select(by, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    ranked = hash_ranked(each, ["rep", by], key, seed, F.col("rep"))
    return ranked.join(take.select(by, "take"), by).filter(F.col("_r") <= F.col("take")).select("rep", key, by)


def pair_errors(question: Column, answers: Column, sql: Column, most: int = 15) -> Column:
    """What is wrong with a pair, as an array of codes in a fixed order."""
    words = F.size(F.array_remove(F.split(F.trim(F.coalesce(question, F.lit(""))), r"\s+"), ""))
    tests = [
        ("empty_question", F.trim(F.coalesce(question, F.lit(""))) == ""), ("empty_answers", F.coalesce(answers, F.lit(0)) == 0), ("too_many_answers", answers > most),
        ("short_question", words < 5), ("no_select", ~F.coalesce(F.upper(sql).contains("SELECT"), F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests)))


def merge_pairs(sets: list[DataFrame]) -> DataFrame:
    """Pairs of several sets: the first of each uid (made from the statement where it is missing), then of each statement."""
    each = [s.withColumn("_f", F.lit(k)) for k, s in enumerate(sets)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each).withColumn("uid", F.coalesce("uid", sql_uid(F.col("sql"))))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy("uid").orderBy("_f", "sql"))).filter("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy("sql").orderBy("_f", "uid"))).filter("_n = 1").drop("_n", "_f")


def with_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs with is_valid from external verdicts; a missing verdict counts against the pair."""
    return pairs.join(verdicts.select("uid", "faithful", "coherent"), "uid", "left").withColumn("is_valid", F.coalesce(F.col("faithful") & F.col("coherent"), F.lit(False)))


def literals(sql: Column) -> Column:
    """Numeric literals of a statement, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(sql, "'[^']*'", ""), F.lit(r"(?<![A-Za-z0-9_.])(\d+(?:\.\d+)?)"), F.lit(1)))


def faithful(question: Column, sql: Column) -> Column:
    """Every numeric literal is in the question verbatim (thousands separators aside), and no word softens it."""
    plain = F.regexp_replace(question, r"(?<=\d),(?=\d)", "")
    return F.forall(literals(sql), lambda x: plain.contains(x)) & ~F.lower(question).rlike(r"\b(about|around|approximately|roughly|nearly|almost)\b")


def silent_branches(joined: Column, tested: Column, question: Column) -> Column:
    """Joined tables that have no predicate and that the question does not mention."""
    return F.filter(F.array_except(joined, tested), lambda t: ~F.lower(question).contains(F.regexp_replace(F.lower(t), "_", " ")))


def statistics(pairs: DataFrame) -> DataFrame:
    """Counts by class, tier, both and none (nulls say over all)."""
    return pairs.cube("strategy", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_valid").cast("int")).alias("valid"))
