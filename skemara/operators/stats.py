"""Significance, ranking stability and coverage statistics over evaluation records.

Random draws come from an integer hash of (replicate, draw), so a result does
not depend on how rows are partitioned. The bootstrap works on sums per
cluster: B replicates of k draws are B * k small rows, whatever the records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemara.functions.scalar import PRIME, key_number, mix
from skemara.operators.quota import hash_ranked
from skemara.sources.scratch import dealt, stored

#: Replicates of a bootstrap.
REPS = 10_000
#: Distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def aligned(records: DataFrame, key: str = "uid", model: str = "model") -> DataFrame:
    """The records of questions that every model has evaluated ok.

    They are made once and stored, before and after the questions are chosen,
    so what reads them several times neither makes them again nor holds the
    buffers of all its joins in one task.
    """
    ok = stored(records.filter("status = 'ok'"), "records")
    models = ok.select(model).distinct().count()
    met = dealt(ok, key)
    common = met.groupBy(key).agg(F.countDistinct(model).alias("_m")).filter(F.col("_m") == models).select(key)
    return stored(met.join(common, key, "left_semi"), "aligned")


def accuracy(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def spread(records: DataFrame, ceiling: float = 0.9) -> DataFrame:
    """Over the models' accuracies: population deviation, and the share at or over the ceiling."""
    return accuracy(records, "model").agg(F.count(F.lit(1)).alias("models"), F.stddev_pop("accuracy").alias("spread"), F.avg((F.col("accuracy") >= ceiling).cast("double")).alias("ceiling_rate"))


def paired(records: DataFrame, value: str = "correct", key: str = "uid", cluster: str = "db_id") -> DataFrame:
    """(a, b, uid, cluster, d) for each pair of models a < b: the difference of their values on each question."""
    records = dealt(records, key)
    side = lambda n: records.select(F.col("model").alias(n), key, F.col(cluster).alias(f"_{n}"), F.col(value).cast("double").alias(f"v{n}"))
    # Read by sizes and by the bootstrap; hence stored.
    return stored(side("a").join(side("b"), key).filter("a < b").select("a", "b", key, F.col("_a").alias("cluster"), (F.col("va") - F.col("vb")).alias("d")), "differences")


def cohen_d(diffs: DataFrame) -> DataFrame:
    """Paired Cohen's d of each pair; infinite where the differences do not vary but are not zero, 0 where they are."""
    mean, sd = F.avg("d"), F.stddev_samp("d")
    return diffs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_d"), F.when(sd > 0, mean / sd).when(mean == 0, 0.0).otherwise(F.lit(float("inf")) * F.signum(mean)).alias("cohen_d"))


def draws(df: DataFrame, units: int, reps: int, seed: int = 0) -> DataFrame:
    """(rep, unit) for reps * units draws of 0..units-1 with replacement."""
    grid = df.sparkSession.range(reps * units)
    return grid.select(F.floor(F.col("id") / units).cast("long").alias("rep"), (mix("id", seed) % units).alias("unit"))


def poisson_times(key: Column, seed: int, rep: Column) -> Column:
    """How often a unit is drawn in a replicate: Poisson(1) by an integer hash of (unit, replicate), which needs no numbering of units."""
    u = mix(key, seed, rep) / F.lit(2147483647.0)
    return sum((F.when(u >= e, 1).otherwise(0) for e in POISSON), F.lit(0))


def bootstrap(diffs: DataFrame, reps: int = REPS, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(a, b, rep, mean): each pair's mean difference when its clusters are drawn anew; questions are the clusters if there is one only.

    Clusters are few (one per database); their sums per pair are the only
    thing that meets the draws. Questions are many, so they are not numbered:
    each has a Poisson weight per replicate, summed with a partial aggregate.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sums = stored(diffs.groupBy("a", "b", F.col("cluster").alias("c")).agg(F.sum(F.col("d") * w).alias("s"), F.sum(w).alias("n")), "bootstrap")
    units = sums.select("c").distinct()
    count = units.count()
    if count < 2:
        each = diffs.select("a", "b", "uid", (F.col("d") * w).alias("s"), w.alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
        met = each.withColumn("times", poisson_times(F.xxhash64("uid").bitwiseAND(F.lit(0x7FFFFFFF)), seed, F.col("rep"))).filter("times > 0")
    else:
        # One window over the distinct clusters numbers them; the draws need dense numbers.
        numbered = units.withColumn("unit", (F.row_number().over(Window.orderBy("c")) - 1).cast("long"))
        drawn = draws(diffs, count, reps, seed).groupBy("rep", "unit").agg(F.count(F.lit(1)).alias("times"))
        met = drawn.join(numbered, "unit").join(sums, "c")
    return met.groupBy("a", "b", "rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))


def p_values(replicates: DataFrame, point: DataFrame | None = None) -> DataFrame:
    """(a, b, p): two-sided share of replicates on the other side of zero; 1 for pairs whose mean difference in `point` (a, b, mean_d) is 0."""
    low, high = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (F.col("mean") <= 0, F.col("mean") >= 0))
    tests = replicates.groupBy("a", "b").agg(F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
    if point is None:
        return tests
    return tests.join(point.select("a", "b", "mean_d"), ["a", "b"]).select("a", "b", F.when(F.col("mean_d") == 0, 1.0).otherwise(F.col("p")).alias("p"))


def intervals(replicates: DataFrame, *by: str, value: str = "mean", level: float = 0.95) -> DataFrame:
    """Percentile interval of the replicates."""
    tail = (1 - level) / 2
    return replicates.groupBy(*by).agg(F.avg(value).alias("centre"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05, order: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """`tests` with rank and rejected, by the step-up rule. Tests are as few as pairs of models."""
    ranked = tests.withColumn("rank", F.row_number().over(Window.orderBy(p, *order))).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    last = F.max(F.when(F.col(p) <= alpha * F.col("rank") / F.col("_m"), F.col("rank"))).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("rejected", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_m")


def separable(records: DataFrame, reps: int = REPS, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Each pair of models: effect size, bootstrap p and whether it is told apart."""
    diffs = paired(aligned(records))
    sizes = cohen_d(diffs)
    tests = p_values(bootstrap(diffs, reps, seed), sizes).join(sizes, ["a", "b"])
    return benjamini_hochberg(tests, alpha=alpha)


def class_matrix(records: DataFrame, models: list[str], least: int = 5) -> DataFrame:
    """Accuracy of each model in each class with at least `least` questions."""
    n = records.groupBy("strategy").agg(F.countDistinct("uid").alias("n")).filter(F.col("n") >= least)
    return records.groupBy("strategy").pivot("model", models).agg(F.avg(F.col("correct").cast("double"))).join(n, "strategy")


def reweighted(records: DataFrame, target: DataFrame, alphas: list[float]) -> DataFrame:
    """Weighted accuracy per (alpha, model): class shares go from those of the records (0) to `target`'s (strategy, share) (1)."""
    n = records.groupBy("strategy").agg(F.countDistinct("uid").alias("n"))
    shares = n.join(target, "strategy", "left").fillna(0.0, ["share"]).withColumn("real", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    grid = shares.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))).withColumn("pi", (1 - F.col("alpha")) * F.col("real") + F.col("alpha") * F.col("share"))
    grid = grid.withColumn("w", F.col("pi") / F.sum("pi").over(Window.partitionBy("alpha")) / F.col("n")).select("strategy", "alpha", "w")
    return records.join(grid, "strategy").groupBy("alpha", "model").agg((F.sum(F.col("w") * F.col("correct").cast("double")) / F.sum("w")).alias("accuracy"))


def poisson_steps(mean: int) -> np.ndarray:
    """Distribution function of Poisson(mean) at 0, 1, 2, ..., up to where it is 1 to all digits of a draw."""
    k = range(mean + int(12 * math.sqrt(mean)) + 30)
    return np.cumsum(np.exp([i * math.log(mean) - mean - math.lgamma(i + 1) for i in k]))


def cell_times(unit: np.ndarray, size: np.ndarray, seed: int, reps: np.ndarray) -> np.ndarray:
    """How often each cell (rows) is drawn in each replicate (columns): Poisson(size) at a hash of (unit, seed, replicate)."""
    h1 = ((unit.astype(np.int64) * 48271 + seed * 16807 + 1) % PRIME)[:, None]
    h2 = (h1 * h1 + reps.astype(np.int64)[None, :] * 69621) % PRIME
    u = ((h2 * h2 + h1) % PRIME) / 2147483647.0
    times = np.empty(u.shape, np.float64)
    for n in np.unique(size).tolist():
        rows = size == n
        times[rows] = np.searchsorted(poisson_steps(n), u[rows], side="right")
    return times


def rank_replicates(records: DataFrame, values: tuple[str, ...] = ("correct",), reps: int = REPS, seed: int = 0, models: list[str] | None = None, key: str = "uid", pooled: bool = True) -> DataFrame:
    """(regime, rep, model, mean, rank) under a bootstrap of questions; each of `values` is a regime, and all regimes and models share a replicate's draws.

    Questions with the same values in all regimes of all models (models are few)
    are one cell, which a replicate draws Poisson(size) times: the sum of as
    many Poisson(1) draws. The draw is by inverse distribution at a hash of the
    cell's least key number, so the work is cells x replicates, in numpy blocks
    within the tasks; a task sends on its sums per replicate. Means are taken to
    nine places, so that ties go by model. Keys are integers or texts. Records
    must be aligned; a missing value counts 0. With pooled=False each question
    is a cell of its own.
    """
    spark = records.sparkSession
    models = models or sorted(r[0] for r in records.select("model").distinct().collect())
    cells = [(v, m) for v in values for m in models]
    names = [f"v{k}" for k in range(len(cells))]
    wide = records.withColumn("_unit", key_number(records, key)).groupBy(key).agg(F.min("_unit").alias("_unit"), *(F.max(F.when(F.col("model") == m, F.col(v).cast("double"))).alias(n) for n, (v, m) in zip(names, cells, strict=True)))
    sized = wide.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"), F.min("_unit").alias("_unit")) if pooled else wide.withColumn("_size", F.lit(1).cast("long"))
    shape = "rep long, n double, sums array<double>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((reps, len(names) + 1))
        for batch in batches:
            unit, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_unit", "_size"))
            value = np.stack([np.ones(len(unit)), *(np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in names)], 1)
            # About half a million draws at a time.
            rows = 1 + (1 << 19) // max(1, reps)
            for low in range(0, len(unit), rows):
                part = slice(low, low + rows)
                total += cell_times(unit[part], size[part], seed, np.arange(reps)).T @ value[part]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(total[:, 0]), pa.array(list(total[:, 1:]), pa.list_(pa.float64()))], ["rep", "n", "sums"])

    dealt = sized.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = dealt.select("_unit", "_size", *names).mapInArrow(draw, shape)
    sums = parts.groupBy("rep").agg(F.sum("n").alias("_n"), *(F.sum(F.get("sums", F.lit(k))).alias(n) for k, n in enumerate(names)))
    long = sums.select("rep", F.explode(F.array(*(F.struct(F.lit(v).alias("regime"), F.lit(m).alias("model"), F.round(F.col(n) / F.col("_n"), 9).alias("mean")) for n, (v, m) in zip(names, cells, strict=True)))).alias("x"))
    ranked = long.select("x.regime", "rep", "x.model", "x.mean").withColumn("rank", F.row_number().over(Window.partitionBy("regime", "rep").orderBy(F.desc("mean"), "model")))
    # A row per regime, replicate and model, which is read more than once.
    return stored(ranked, "replicates")


def point_ranks(records: DataFrame, value: str) -> DataFrame:
    """(model, mean, rank) over all records; there are as many rows as models."""
    means = records.groupBy("model").agg(F.round(F.avg(F.col(value).cast("double")), 9).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "model")))


def rank_distribution(replicates: DataFrame, reps: int) -> DataFrame:
    """P(model has rank k), per regime."""
    return replicates.groupBy("regime", "model", "rank").agg((F.count(F.lit(1)) / reps).alias("share"))


def kendall(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Kendall's tau of two rankings (model, rank), per the columns `by`."""
    both = left.select(*by, "model", F.col("rank").alias("r1")).join(right.select(*by, "model", F.col("rank").alias("r2")), [*by, "model"])
    pairs = both.alias("x").join(both.alias("y"), [*by] if by else F.col("x.model") < F.col("y.model")).filter(F.col("x.model") < F.col("y.model"))
    sign = F.signum(F.col("x.r1") - F.col("y.r1")) * F.signum(F.col("x.r2") - F.col("y.r2"))
    return pairs.groupBy(*by).agg(F.avg(sign).alias("tau"))


def tau_summary(taus: DataFrame, point: DataFrame) -> DataFrame:
    """One row: the point estimate of tau, its bootstrap mean and 95 % interval, and how often it is at most 0 and below 1."""
    found = taus.agg(F.avg("tau").alias("centre"), *(F.bround(F.percentile("tau", F.lit(p)), 12).alias(n) for n, p in (("low", 0.025), ("high", 0.975))), *(F.avg(c.cast("double")).alias(n) for n, c in (("p_le_0", F.col("tau") <= 0), ("p_lt_1", F.col("tau") < 1))))
    return found.withColumn("_k", F.lit(1)).join(point.select(F.col("tau").alias("point"), F.lit(1).alias("_k")), "_k").drop("_k")


def claims(replicates: DataFrame, tests: dict[str, tuple[str, Column]]) -> DataFrame:
    """(claim, share): how often a claim holds over the replicates. A claim is a regime and a condition on the columns m_<model> (means) and r_<model> (ranks)."""
    models = sorted(r[0] for r in replicates.select("model").distinct().collect())
    wide = replicates.groupBy("regime", "rep").agg(*(F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c[0]}_{m}") for m in models for c in ("mean", "rank")))
    hits = F.array(*(F.struct(F.lit(k).alias("claim"), ((F.col("regime") == r) & F.coalesce(t, F.lit(False))).cast("int").alias("hit"), (F.col("regime") == r).alias("of")) for k, (r, t) in tests.items()))
    return wide.select(F.explode(hits).alias("x")).filter("x.of").groupBy("x.claim").agg(F.avg("x.hit").alias("share"))


def sign_agreement(replicates: DataFrame, point: DataFrame) -> DataFrame:
    """(a, b, agree, flip, excludes_zero): how often a pair's replicates have the sign of its point difference and the opposite one, and whether the 95 % interval leaves out 0."""
    found = replicates.join(point, ["a", "b"])
    return found.groupBy("a", "b").agg(F.avg((F.signum("mean") == F.signum("mean_d")).cast("double")).alias("agree"), F.avg((F.signum("mean") * F.signum("mean_d") < 0).cast("double")).alias("flip"), ((F.percentile("mean", F.lit(0.025)) > 0) | (F.percentile("mean", F.lit(0.975)) < 0)).alias("excludes_zero"))


def inversions(one: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b): a ranks before b in one and after it in the other."""
    both = one.select("model", F.col("rank").alias("r1")).join(other.select("model", F.col("rank").alias("r2")), "model")
    return both.alias("x").join(both.alias("y"), (F.col("x.r1") < F.col("y.r1")) & (F.col("x.r2") > F.col("y.r2"))).select(F.col("x.model").alias("a"), F.col("y.model").alias("b"))


def compare_forms(tables: dict[str, DataFrame], keys: list[str], by: list[str]) -> DataFrame:
    """Accuracy of each form on the (model, question)s that all forms have: overall per model and per (model, tier)."""
    joined = None
    for name, t in tables.items():
        part = t.select(*keys, F.col("correct").cast("double").alias(name), *(by if joined is None else []))
        joined = part if joined is None else joined.join(part, keys)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(n).alias(n) for n in tables)]
    return joined.groupBy("model", *by).agg(*aggs).unionByName(joined.groupBy("model").agg(*aggs).withColumns({c: F.lit("all") for c in by}))


def certified(records: DataFrame) -> DataFrame:
    """The records of questions that at least one model solves."""
    met = dealt(records, "uid")
    return met.join(met.filter("correct").select("uid").distinct(), "uid", "left_semi")


def unsolved(records: DataFrame) -> DataFrame:
    """Questions that no model solves, with their class."""
    return records.groupBy("uid", "strategy").agg(F.max(F.col("correct").cast("int")).alias("_c")).filter("_c = 0").select("uid", "strategy")


def consensus(failures: DataFrame, key: str = "uid", category: str = "category") -> DataFrame:
    """Per question the number of distinct categories and the most frequent one (first in order among equals)."""
    counts = failures.groupBy(key, category).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(key).agg(F.count(F.lit(1)).alias("categories"), F.min_by(category, F.struct(-F.col("c"), F.col(category))).alias("main"))


def costs(calls: DataFrame, prices: DataFrame, prompt: str, answer: str) -> DataFrame:
    """Per model: calls, tokens (four characters each) and the price; `prices` has dollars per million tokens in and out."""
    used = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), (F.sum(F.char_length(prompt)) / 4).alias("tokens_in"), (F.sum(F.char_length(answer)) / 4).alias("tokens_out"))
    return used.join(prices, "model").withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6)


def shares(rows: DataFrame, corpus: str, cls: str) -> DataFrame:
    """Share of each class in its corpus."""
    counts = rows.groupBy(corpus, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(corpus)))


def rating_table(rows: DataFrame, source: str, rating: str, values: list[int]) -> DataFrame:
    """Counts per source and rating, ratings as columns, with the mean."""
    return rows.groupBy(source).pivot(rating, values).count().na.fill(0).join(rows.groupBy(source).agg(F.avg(rating).alias("mean")), source)


def power_draws(records: DataFrame, size: int, reps: int, seed: int = 0, key: str = "uid") -> DataFrame:
    """(rep, key): `size` questions at random in each replicate, by least hash of the key, an integer or a text.

    Each replicate ranks stretches of the hash's range apart (see quota.hash_ranked), so none is one task's.
    """
    ids = stored(records.select(key).distinct(), "questions").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return hash_ranked(ids, ["rep"], key, seed, F.col("rep")).filter(F.col("_r") <= size).select("rep", key)
