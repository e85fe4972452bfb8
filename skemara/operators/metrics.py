"""Scores of predicted against gold results: sets, multisets, texts of statements, and their summaries.

Result rows come as tables (uid, side, row), side "gold" or "pred", row a text
of the row's normalised cells. Every score is an aggregate per uid, so no
result has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skemara.functions.scalar import flat_sql, normal_sql, ordered_terms, tokens
from skemara.operators import retrieval
from skemara.sources.scratch import is_small, small, stored

CLAUSES = ("select", "from", "where", "group by", "order by")
VES_WEIGHT = 2410.01066
#: What is taken of one side's statement, by name.
Taken = Callable[[str], Column]


def _sides(rows: DataFrame, key: str = "uid") -> DataFrame:
    """(uid, row, g, p): how often each row is in gold and in the prediction."""
    is_gold = F.col("side") == "gold"
    return rows.groupBy(key, "row").agg(F.sum(F.when(is_gold, 1).otherwise(0)).alias("g"), F.sum(F.when(~is_gold, 1).otherwise(0)).alias("p"))


def set_match(rows: DataFrame, key: str = "uid") -> DataFrame:
    """(uid, correct): the sets of rows are equal."""
    return _sides(rows, key).groupBy(key).agg((F.max(F.when((F.col("g") > 0) == (F.col("p") > 0), 0).otherwise(1)) == 0).alias("correct"))


def multiset_match(rows: DataFrame, key: str = "uid") -> DataFrame:
    """(uid, correct): each row is there as often on both sides."""
    return _sides(rows, key).groupBy(key).agg((F.max(F.when(F.col("g") == F.col("p"), 0).otherwise(1)) == 0).alias("correct"))


def ordered_match(rows: DataFrame, key: str = "uid", place: str = "place") -> DataFrame:
    """(uid, correct): the same rows at the same places."""
    return multiset_match(rows.withColumn("row", F.concat_ws("\x1f", F.col(place), "row")), key)


def _f1(hit: Column, gold: Column, pred: Column, both_empty: float) -> Column:
    p, r = F.when(pred > 0, hit / pred).otherwise(0.0), F.when(gold > 0, hit / gold).otherwise(0.0)
    return F.when((gold == 0) & (pred == 0), F.lit(both_empty)).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def row_f1(rows: DataFrame, key: str = "uid", multiset: bool = True, both_empty: float = 1.0, keys: DataFrame | None = None) -> DataFrame:
    """(uid, n_gold, n_pred, n_hit, precision, recall, f1) over multisets or sets of rows; `keys` lists uids that may have no row at all."""
    sides = _sides(rows, key)
    if not multiset:
        sides = sides.withColumns({c: F.when(F.col(c) > 0, 1).otherwise(0) for c in ("g", "p")})
    out = sides.groupBy(key).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.least("g", "p")).alias("n_hit"))
    if keys is not None:
        out = keys.select(key).distinct().join(out, key, "left").fillna(0, ["n_gold", "n_pred", "n_hit"])
    hit, gold, pred = F.col("n_hit"), F.col("n_gold"), F.col("n_pred")
    return out.withColumns({
        "precision": F.when(pred > 0, hit / pred).otherwise(F.when(gold == 0, F.lit(both_empty)).otherwise(0.0)),
        "recall": F.when(gold > 0, hit / gold).otherwise(F.when(pred == 0, F.lit(both_empty)).otherwise(0.0)),
        "f1": _f1(hit, gold, pred, both_empty),
    })


def array_scores(gold: Column, pred: Column, both_empty: float = 0.0) -> Column:
    """precision, recall, f1 and intersection of two arrays as sets."""
    hit, n, m = F.size(F.array_intersect(gold, pred)), F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    return F.struct(F.when(m > 0, hit / m).otherwise(0.0).alias("precision"), F.when(n > 0, hit / n).otherwise(0.0).alias("recall"), _f1(hit, n, m, both_empty).alias("f1"), hit.cast("long").alias("n_hit"))


def efficiency(correct: Column, ms: Column) -> Column:
    """Valid-efficiency score: 0 if wrong, else falling with the time taken."""
    return F.when(correct, F.lit(VES_WEIGHT) / (F.lit(VES_WEIGHT) + ms)).otherwise(0.0)


def clause(sql: Column, name: str) -> Column:
    """The text of one clause, lower-case, empty if it is not there."""
    return _clause(normal_sql(sql), name)


def _clause(normal: Column, name: str) -> Column:
    later = {"select": "from", "from": "where|group by|order by|limit", "where": "group by|order by|limit", "group by": "having|order by|limit", "order by": "limit"}[name]
    return F.trim(F.regexp_extract(normal, rf"\b{name}\b (.*?)(?= (?:{later})\b|$)", 1))


def components(sql: Column) -> dict[str, Column]:
    """Parts of each clause as arrays: terms of the condition, items elsewhere."""
    return {c: _parts(clause(sql, c), c) for c in CLAUSES}


def _parts(text: Column, name: str) -> Column:
    parts = F.split(text, r"\s+and\s+" if name == "where" else r"\s*,\s*")
    return F.array_remove(F.array_distinct(F.transform(parts, lambda x: F.trim(x))), "")


def component_f1(x: Taken, y: Taken) -> Column:
    """Mean F1 of the five clauses' parts; a clause that is on neither side counts 1."""
    each = [_f1(F.size(F.array_intersect(x(c), y(c))), F.size(x(c)), F.size(y(c)), 1.0) for c in CLAUSES]
    return reduce(lambda s, v: s + v, each) / len(CLAUSES)


def soft_f1(x: Taken, y: Taken) -> Column:
    """F1 over the sets of tokens."""
    return _f1(F.size(F.array_intersect(x("tokens"), y("tokens"))), F.size(x("tokens")), F.size(y("tokens")), 1.0)


def set_distance(x: Taken, y: Taken) -> Column:
    """Tokens that are on one side only."""
    return (F.size(F.array_except(x("tokens"), y("tokens"))) + F.size(F.array_except(y("tokens"), x("tokens")))).cast("long")


def clause_jaccard(x: Taken, y: Taken) -> Column:
    """Mean over the clauses of intersection over union, 1 where both are empty."""
    each = [F.when(F.size(F.array_union(x(c), y(c))) == 0, 1.0).otherwise(F.size(F.array_intersect(x(c), y(c))) / F.size(F.array_union(x(c), y(c)))) for c in CLAUSES]
    return reduce(lambda s, v: s + v, each) / len(CLAUSES)


TEXT_METRICS = {
    "exact_match": lambda x, y: (x("normal") == y("normal")).cast("int"), "component_f1": component_f1, "soft_f1": soft_f1,
    "set_distance": set_distance, "clause_jaccard": clause_jaccard,
}


def text_metrics(pairs: DataFrame, gold: str, pred: str, enabled: list[str] | None = None) -> DataFrame:
    """`pairs` with the enabled metrics of two statements.

    What the metrics read of a statement (its normal form, the parts of its
    clauses, its tokens) is taken once, column after column, and not again by
    each metric; unused columns are not made.
    """
    sides = (gold, pred)
    name = lambda side, part: f"_{sides.index(side)}_{part}"
    out = pairs.withColumns({name(s, "flat"): flat_sql(F.col(s)) for s in sides})
    out = out.withColumns({name(s, "normal"): ordered_terms(F.col(name(s, "flat"))) for s in sides})
    out = out.withColumns({name(s, c): _parts(_clause(F.col(name(s, "normal")), c), c) for s in sides for c in CLAUSES} | {name(s, "tokens"): F.array_distinct(tokens(F.col(s))) for s in sides})
    x, y = (lambda part, s=s: F.col(name(s, part)) for s in sides)
    return out.select(*(F.col(f"`{c}`") for c in pairs.columns), *(f(x, y).alias(k) for k, f in TEXT_METRICS.items() if enabled is None or k in enabled))


def token_f1(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, f1) over multisets of tokens, a row per pair; pairs without a token on either side have 0.

    Tokens are counted within the rows of a batch, so nothing is shuffled.
    """
    texts = pairs.select(*key, tokens(F.col(a)).alias("_a"), tokens(F.col(b)).alias("_b"))
    shape = T.StructType([*(texts.schema[c] for c in key), *(T.StructField(c, T.LongType()) for c in ("g", "p", "h"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = [batch.column(c) for c in ("_a", "_b")]
            sizes = [np.asarray(pc.list_value_length(x)).astype(np.int64) for x in lists]
            row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
            words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode() if len(row) else None
            hit = np.zeros(n, np.int64)
            if words is not None:
                # A number per row and word; how often each is on either side.
                cell, at = np.unique(row * len(words.dictionary) + np.asarray(words.indices).astype(np.int64), return_inverse=True)
                left, right = (np.bincount(x, minlength=len(cell)) for x in (at[: sizes[0].sum()], at[sizes[0].sum() :]))
                hit = np.bincount(cell // len(words.dictionary), np.minimum(left, right), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *(pa.array(x) for x in (*sizes, hit))], [*key, "g", "p", "h"])

    return texts.mapInArrow(count, shape).select(*key, _f1(F.col("h"), F.col("g"), F.col("p"), 0.0).alias("f1"))


def split_at(text: Column, percent: int = 60) -> tuple[Column, Column]:
    """The first `percent` of a text's words, and the rest."""
    words = F.array_remove(F.split(F.trim(text), r"\s+"), "")
    n = F.floor(F.size(words) * percent / 100).cast("int")
    return F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, n + 1, F.size(words)), " ")


def best_cosines(generated: DataFrame, gold: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(id, group, best): as best_matches with the cosine of `vector` and another id as score, by matrix products within tasks (see retrieval.pairs)."""
    asked = generated.filter(F.col(group).isNotNull()).select(F.col("id").alias("query_id"), group, F.col(vector).alias("vector"))
    rows = gold.filter(F.col(group).isNotNull()).select("id", group, F.col(vector).alias("embedding"))
    # Rows with the query's own id stand in the way of as many others.
    own = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    best = retrieval.pairs(rows, asked, own + 1, "cosine", "id", group).filter(F.col("id") != F.col("query_id")).groupBy("query_id", group).agg(F.max("score").alias("best"))
    every = asked.join(rows.select(group).distinct(), group, "left_semi").select("query_id", group).distinct()
    return every.join(best, ["query_id", group], "left").select(F.col("query_id").alias("id"), group, "best")


def best_matches(generated: DataFrame, gold: DataFrame, group: str, score: Column, block: int = 256) -> DataFrame:
    """(id, group, best): each generated row's best score among the gold rows of its group; `score` names their columns a.* and b.*.

    A group's generated rows, the queries, come in blocks of about `block`. Few
    blocks are broadcast, so gold rows stay where they are and each task keeps
    the best per query; else gold rows are dealt by (group, block, part), so
    that a large group is no one task's.
    """
    # Groups are counted by an aggregate, which adds up within tasks first; rows meet their group's count in a join.
    counts = generated.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_many"))
    q = generated.select(F.struct("*").alias("a"), F.col(group).alias("_g")).join(small(stored(counts, "group-sizes")), "_g").select("a", "_g", F.pmod(F.xxhash64("a.id"), F.col("_many")).alias("_b"))
    blocks = stored(q.groupBy("_g", "_b").agg(F.collect_list("a").alias("_a")), "blocks")
    rows = gold.select(F.struct("*").alias("b"), F.col(group).alias("_g"))
    if is_small(blocks):
        met = rows.join(F.broadcast(blocks), "_g")
    else:
        parts = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = blocks.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = rows.withColumn("_p", F.pmod(F.xxhash64("b.id"), F.lit(parts)).cast("int")).join(small(blocks.select("_g", "_b")), "_g")
        met = dealt.join(copies, ["_g", "_b", "_p"])
    return met.select("b", F.explode("_a").alias("a")).groupBy("a.id", F.col(f"a.{group}").alias(group)).agg(F.max(score).alias("best"))


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Hit rate, exact rate, micro and macro precision, recall and F1 of rows with n_gold, n_pred, n_hit, precision, recall, f1."""
    h, g, p = (F.sum(c) for c in ("n_hit", "n_gold", "n_pred"))
    mp, mr = F.when(p > 0, h / p).otherwise(0.0), F.when(g > 0, h / g).otherwise(0.0)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(F.col("f1") == 1, 1.0).otherwise(0.0)).alias("exact_rate"),
        mp.alias("micro_p"), mr.alias("micro_r"), F.when(mp + mr > 0, 2 * mp * mr / (mp + mr)).otherwise(0.0).alias("micro_f1"),
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1"),
    )


def mean_f1_summary(scores: DataFrame, *by: str) -> DataFrame:
    """F1 of mean precision and mean recall, with hit rate: the harmonic mean of two averages."""
    p, r = F.avg("precision"), F.avg("recall")
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1_of_means"))


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, extremes, and exclusive 95th and 99th percentiles (the largest value under 20 and 100 rows).

    Ranks are counted per distinct value, so that no group's values are gathered in one row; nulls are left out.
    """
    v = F.col(value).cast("double")
    per = rows.filter(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    run = per.withColumns({"_upto": F.sum("_c").over(group.orderBy("_v")), "_n": F.sum("_c").over(group)})
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    spot = {p: (F.col("_n") + 1) * p for p in (50, 95, 99)}
    low = {p: F.greatest(F.lit(1), F.least(F.floor(x / 100).cast("long"), F.col("_n") - 1)) for p, x in spot.items()}
    held = run.groupBy(*by).agg(
        F.max("_n").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        at(F.floor((F.col("_n") + 1) / 2)).alias("_m1"), at(F.floor((F.col("_n") + 2) / 2)).alias("_m2"), *(at(low[p] + i).alias(f"_{p}_{i}") for p in (95, 99) for i in (0, 1)),
    )

    def exclusive(p: int, least: int) -> Column:
        part = spot[p] - low[p] * 100
        return F.when(F.col("_n") >= least, (F.col(f"_{p}_0") * (100 - part) + F.col(f"_{p}_1") * part) / 100).otherwise(F.col("most"))

    out = held.withColumns({"median": (F.col("_m1") + F.col("_m2")) / 2, "p95": exclusive(95, 20), "p99": exclusive(99, 100)})
    return out.select(*by, "mean", "median", "least", "most", "p95", "p99")


def breakdown(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and count of `value` by each of the columns alone and over all rows: (axis, key, n, mean)."""
    sets = reduce(lambda a, b: a.unionByName(b), (rows.select(F.lit(c).alias("axis"), F.col(c).cast("string").alias("key"), value) for c in by))
    both = sets.unionByName(rows.select(F.lit("all").alias("axis"), F.lit("").alias("key"), value))
    return both.groupBy("axis", "key").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def merge_runs(runs: DataFrame, modes: int | None = None) -> DataFrame:
    """Of each (mode, uid) the row evaluated last, of equals that of the later file; then the uids that all modes have."""
    order = Window.partitionBy("mode", "uid").orderBy(F.desc("evaluated_at"), F.desc("file"))
    latest = runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    modes = latest.select("mode").distinct().count() if modes is None else modes
    common = latest.groupBy("uid").agg(F.countDistinct("mode").alias("_m")).filter(F.col("_m") == modes).select("uid")
    return latest.join(common, "uid", "left_semi")


def reward(runnable: Column, correct: Column, same_pattern: Column) -> Column:
    """-0.5 if it does not run, 0.3 if it runs, 1.0 if right, and 0.2 more for the right pattern."""
    return F.when(~runnable, -0.5).otherwise(F.when(correct, 1.0).otherwise(0.3) + F.when(same_pattern, 0.2).otherwise(0.0))


def surface(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean and count on the grid of two columns."""
    return rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))


def fill_surface(grid: DataFrame, x: str, y: str, weight: float = 10.0) -> DataFrame:
    """Every cell of an integer grid: its mean shrunk to the count-weighted mean of its 3 x 3 neighbourhood by `weight` rows; empty cells get that mean."""
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = grid.filter("n > 0").withColumn("_i", around).withColumn("_j", around)
    local = near.groupBy((F.col(x) + F.col("_i")).alias(x), (F.col(y) + F.col("_j")).alias(y)).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("local"))
    box = grid.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    cells = box.select(F.explode(F.sequence("a", "b")).alias(x), "c", "d").select(x, F.explode(F.sequence("c", "d")).alias(y))
    out = cells.join(local, [x, y], "left").join(grid, [x, y], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(x, y, n.alias("n"), F.when(n == 0, F.col("local")).otherwise((n * F.col("mean") + weight * F.col("local")) / (n + weight)).alias("filled"))


def result_id(rows: DataFrame) -> Column:
    """The identifier of a result row: `id`, then *_id, then a number, then the only column; the first that is not null."""
    names = rows.columns
    order = [c for c in names if c.lower() == "id"] + [c for c in names if c.lower().endswith("_id")] + [c for c in names if "number" in c.lower()]
    order = order or (names if len(names) == 1 else [])
    return F.coalesce(*(F.col(c).cast("string") for c in dict.fromkeys(order))) if order else F.lit(None).cast("string")
