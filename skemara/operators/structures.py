"""Join structures that a schema's key graph supports from a target table: chains, stars, and the classes they make feasible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skemara.functions.scalar import mix

#: Predicates of a tier, least and most.
TIER_RANGE = {"E": (1, 2), "M": (3, 5), "H": (6, 8)}
SELF_DEPTH = 3


def named_keys(fks: DataFrame) -> DataFrame:
    """(key, child_table, parent_table): one row per key.

    Column pairs of a composite key share a `name`; a key without one is called
    by its table and column. Two keys between the same tables stay two.
    """
    name = F.concat_ws(".", "child_table", "child_column") if "child_column" in fks.columns else F.concat_ws(".", "child_table", "parent_table")
    if "name" in fks.columns:
        name = F.coalesce("name", name)
    return fks.select(name.alias("key"), "child_table", "parent_table").distinct()


def steps(fks: DataFrame) -> DataFrame:
    """(a, b, key): moves along a key, from child to parent and, where a table has no parent, from parent to its children."""
    keys = named_keys(fks)
    out = keys.select(F.col("child_table").alias("a"), F.col("parent_table").alias("b"), "key")
    back = keys.filter("child_table <> parent_table").select(F.col("parent_table").alias("a"), F.col("child_table").alias("b"), "key")
    return out.unionByName(back.join(out.filter("a <> b").select("a").distinct(), "a", "left_anti"))


def chains(fks: DataFrame, target: str, hops: int = 3, most: int = 50) -> DataFrame:
    """(pattern, tables, keys): chains of 1..hops moves from the target, no table twice but for a self reference; `most` per length, in order of names.

    A move is an edge of the graph of keys, so two keys to one table are two
    chains. Works on the catalog, a row per key: its paths stay few.
    """
    moves = steps(fks)
    level = fks.sparkSession.createDataFrame([([target], [])], "tables array<string>, keys array<string>")
    out = None
    for n in range(1, hops + 1):
        met = level.join(moves, F.element_at("tables", -1) == F.col("a"))
        seen = F.size(F.filter("tables", lambda t: t == F.col("b")))
        ok = met.filter((seen == 0) | ((F.col("a") == F.col("b")) & (seen < SELF_DEPTH)))
        level = ok.select(F.concat("tables", F.array("b")).alias("tables"), F.concat("keys", F.array("key")).alias("keys"))
        ranked = level.withColumn("_n", F.row_number().over(Window.orderBy(F.array_join("tables", "/"), F.array_join("keys", "/")))).filter(F.col("_n") <= most)
        part = ranked.select(F.lit(f"{n}p").alias("pattern"), "tables", "keys")
        out = part if out is None else out.unionByName(part)
    return out


def stars(fks: DataFrame, target: str, arms: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(pattern, tables, keys): the target with every combination of 2..4 keys that it shares with other tables, by table and key ascending.

    Two keys to one table are two arms, so a table may be in a star twice.
    """
    a, b = F.col("child_table"), F.col("parent_table")
    dims = named_keys(fks).filter((a != b) & ((a == target) | (b == target))).select(F.struct(F.when(a == target, b).otherwise(a).alias("d"), "key").alias("arm"))
    level, out = dims.select(F.array("arm").alias("arms")), None
    for n in range(2, max(arms) + 1):
        level = level.join(dims, F.col("arm") > F.element_at("arms", -1)).select(F.concat("arms", F.array("arm")).alias("arms"))
        if n in arms:
            part = level.select(F.lit(f"{n}i").alias("pattern"), F.concat(F.array(F.lit(target)), F.col("arms.d")).alias("tables"), F.col("arms.key").alias("keys"))
            out = part if out is None else out.unionByName(part)
    return out


def structures(fks: DataFrame, target: str) -> DataFrame:
    """(pattern, tables, keys) of all structures, the target alone included."""
    alone = fks.sparkSession.createDataFrame([("0", [target], [])], "pattern string, tables array<string>, keys array<string>")
    return alone.unionByName(chains(fks, target)).unionByName(stars(fks, target))


def feasible(found: DataFrame, filterable: DataFrame) -> DataFrame:
    """(strategy, pattern, tier, columns): classes whose structures have as many filterable columns as the tier needs."""
    per = filterable.groupBy("table").agg(F.count(F.lit(1)).alias("c"))
    rows = found.withColumn("sid", F.concat_ws("|", F.array_join("tables", "/"), F.array_join("keys", "/"))).select("pattern", "sid", F.explode("tables").alias("table"))
    sums = rows.join(per, "table", "left").groupBy("pattern", "sid").agg(F.sum(F.coalesce("c", F.lit(0))).alias("c"))
    best = sums.groupBy("pattern").agg(F.max("c").alias("columns"))
    tiers = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(low).alias("least")) for t, (low, _) in TIER_RANGE.items())))
    return best.withColumn("t", tiers).filter(F.col("columns") >= F.col("t.least")).select(F.concat("pattern", "t.tier").alias("strategy"), "pattern", "t.tier", "columns")


def capabilities(fks: DataFrame, columns: DataFrame, target: str) -> DataFrame:
    """(strategy, supported, reason) by a coarser rule: keys in any direction, all columns that are no primary key."""
    deg = stars(fks, target, (2, 3, 4)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    keys = named_keys(fks).withColumnRenamed("key", "name")
    both = keys.unionByName(keys.select("name", F.col("parent_table").alias("child_table"), F.col("child_table").alias("parent_table")))
    paths = chains(both.distinct(), target).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    n = columns.count()
    codes = fks.sparkSession.range(1).select(F.explode(F.array(*(F.lit(p) for p in ("0", "1p", "2p", "3p", "2i", "3i", "4i")))).alias("pattern"))
    tiers = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(low).alias("least")) for t, (low, _) in TIER_RANGE.items())))
    out = codes.join(deg.unionByName(paths), "pattern", "left").withColumn("t", tiers)
    shape = (F.col("pattern") == "0") | F.col("n").isNotNull()
    reason = F.when(~shape, F.when(F.col("pattern").endswith("i"), "too few related tables").otherwise("no chain of this length")).when(F.lit(n) < F.col("t.least"), "too few columns")
    return out.select(F.concat("pattern", "t.tier").alias("strategy"), reason.isNull().alias("supported"), reason.alias("reason"))


def check_wanted(wanted: DataFrame, able: DataFrame) -> DataFrame:
    """Wanted classes (strategy) with supported and reason; unknown ones are not supported."""
    return wanted.join(able, "strategy", "left").select("strategy", F.coalesce("supported", F.lit(False)).alias("supported"), F.when(F.col("supported").isNull(), "unknown class").otherwise(F.col("reason")).alias("reason"))


def pick(found: DataFrame, attempts: int, seed: int = 0, round_robin: bool = False) -> DataFrame:
    """(pattern, attempt, tables, keys): a structure of each pattern per attempt, by hash or in turn."""
    numbered = found.withColumns({"k": F.row_number().over(Window.partitionBy("pattern").orderBy(F.array_join("tables", "/"), F.array_join("keys", "/"))) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("pattern"))})
    tries = numbered.select("pattern", "n").distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    which = F.col("attempt") if round_robin else mix(F.col("attempt"), seed)
    return tries.withColumn("k", F.pmod(which, F.col("n")).cast("int")).drop("n").join(numbered.drop("n"), ["pattern", "k"]).select("pattern", "attempt", "tables", "keys")
