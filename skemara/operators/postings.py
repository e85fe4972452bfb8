"""Stored postings: an index of terms that searches read instead of texts, kept up to date by generations, with bounds that let whole blocks be skipped.

An index is a folder of generations. A generation has

    postings    term, key, version, tf, dl, band; by part, a hash of the term, and sorted by term and band
    blocks      term, band, n, best: how many postings a block has and no posting's weight is over `best`; n below 0 takes postings back
    documents   key, version, dl, sign: 1 for a document that comes, -1 for one that goes
    retired     key, version: postings that no longer count
    done        written last, with the mean length that the bands were made with

An update writes a generation: new postings of changed documents, and the
tombstones of their old ones; searches drop those. compact() makes one
generation of all. A block is the postings of a term whose weight lies in one
band, so a frequent term has many blocks and no task ranks its postings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skemara.functions.scalar import tokens
from skemara.operators.retrieval import K1, B, row_counts, search_terms, top
from skemara.sources.scratch import listing, scratch, small, stored

#: Parts that terms are dealt to, bands of a term's weights, and terms whose parts are named to the scan.
PARTS, BANDS, NAMED = 32, 32, 10_000
SHAPES = {"postings": "key {key}, dl long, term string, tf long, version int, band int, part int", "blocks": "term string, band int, n long, best double, part int"}


def impact(tf: Column, dl: Column, mean: float) -> Column:
    """What a posting counts, without its term's rarity: below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean))))


@dataclass
class Index:
    """Generations of a folder that are complete."""

    spark: SparkSession
    root: str
    generations: list[str]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        """The index in `root`; a generation whose writing was broken off is not part of it."""
        return cls(spark, root, [p.rsplit("/", 2)[0] for p in listing(spark, f"{root}/gen-*/done/_SUCCESS")])

    def table(self, name: str) -> DataFrame:
        # Dealt tables without a row have no file that tells their columns.
        shape = None
        if name in SHAPES:
            key = self.spark.read.parquet(f"{self.generations[0]}/documents").schema["key"].dataType.simpleString()
            shape = SHAPES[name].format(key=key)
        parts = [(self.spark.read.schema(shape) if shape else self.spark.read).parquet(f"{g}/{name}") for g in self.generations]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def size(self) -> tuple[int, float]:
        """Documents and their mean length."""
        n, total = self.table("documents").agg(F.sum("sign"), F.sum(F.col("sign") * F.col("dl"))).first()
        return n or 0, (total or 0) / max(1, n or 0) or 1.0

    def scale(self, mean: float) -> float:
        """How much more a posting may count now than its block's bound says, as the mean length has grown since."""
        return max(1.0, mean / (self.table("done").agg(F.min("mean")).first()[0] or mean))


def _counted(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    words = docs.select(F.col(key).alias("key"), terms.alias("_w")).withColumn("dl", F.size("_w").cast("long"))
    return words


def _write(index: Index, words: DataFrame, gone: DataFrame | None) -> Index:
    """Write one generation: `words` (key, dl, _w), and what `gone` (key, version, dl) takes back."""
    number = len(index.generations)
    folder = f"{index.root}/gen-{number:06d}-{scratch(index.spark, 'generation').rsplit('-', 1)[1]}"
    version = F.lit(number)
    words = stored(words, "words")
    came = words.select("key", version.alias("version"), "dl", F.lit(1).alias("sign"))
    n, total = came.agg(F.count(F.lit(1)), F.sum("dl")).first()
    mean = (index.size()[1] if index.generations else 0) or (total or 0) / max(1, n) or 1.0
    counts = row_counts(words, "key")
    if not words.groupBy("key", "dl").count().filter("count > 1").isEmpty():
        counts = counts.groupBy("key", "dl", "term").agg(F.sum("tf").alias("tf"))
    weight = impact(F.col("tf"), F.col("dl"), mean)
    band = (BANDS - 1 - F.least(F.lit(BANDS - 1), F.floor(weight * BANDS / (K1 + 1)))).cast("int")
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    rows = counts.withColumns({"version": version, "band": band, "part": part})
    # Parts of few postings share a task, and one of very many is split over several.
    rows.hint("rebalance", "part").sortWithinPartitions("part", "term", "band").write.partitionBy("part").parquet(f"{folder}/postings")
    made = index.spark.read.schema(rows.schema).parquet(f"{folder}/postings")
    blocks = made.groupBy("term", "band").agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("best"))
    documents = came
    if gone is not None:
        gone = stored(gone, "gone")
        documents = came.unionByName(gone.select("key", "version", "dl", F.lit(-1).alias("sign")))
        lost = index.table("postings").join(small(gone.select("key", "version")), ["key", "version"]).groupBy("term", "band").agg((-F.count(F.lit(1))).alias("n"))
        blocks = blocks.unionByName(lost.withColumn("best", F.lit(0.0)))
        retired = gone.select("key", "version")
    else:
        retired = came.select("key", "version").limit(0)
    blocks.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(f"{folder}/blocks")
    documents.write.parquet(f"{folder}/documents")
    retired.write.parquet(f"{folder}/retired")
    index.spark.createDataFrame([(mean,)], "mean double").write.parquet(f"{folder}/done")
    return Index.open(index.spark, index.root)


def text_terms(text: str = "text") -> Column:
    """The words of a text, repeats kept."""
    return tokens(F.col(text))


def column_terms(columns: list[str]) -> Column:
    """The words of some columns, each with its column's name in front: an inverted index per column."""
    named = lambda c: F.transform(tokens(F.col(c).cast("string")), lambda t: F.concat(F.lit(f"{c}="), t))
    return F.flatten(F.array(*map(named, columns)))


def build(docs: DataFrame, key: str, terms: Column, root: str | None = None) -> Index:
    """An index over `docs`, a row per key; its folder is a new shared one unless `root` names one."""
    spark = docs.sparkSession
    return _write(Index(spark, root or scratch(spark, "index"), []), _counted(docs, key, terms), None)


def update(index: Index, docs: DataFrame, key: str, terms: Column, deleted: DataFrame | None = None) -> Index:
    """The index with `docs` in place of their former versions and without the keys of `deleted`; texts of other documents are not read."""
    keys = docs.select(F.col(key).alias("key"))
    if deleted is not None:
        keys = keys.unionByName(deleted.select(F.col(key).alias("key")))
    mine = index.table("documents").join(small(stored(keys.distinct(), "changed")), "key", "left_semi")
    gone = mine.groupBy("key", "version").agg(F.max("dl").alias("dl"), F.sum("sign").alias("_s")).filter("_s > 0").drop("_s")
    return _write(index, _counted(docs, key, terms), gone)


def compact(index: Index) -> Index:
    """A new index of one generation without what was taken back."""
    postings = live(index, index.table("postings"))
    words = postings.groupBy("key", "dl").agg(F.flatten(F.collect_list(F.expr("array_repeat(term, CAST(tf AS INT))"))).alias("_w"))
    alive = index.table("documents").groupBy("key").agg(F.sum("sign").alias("_s")).filter("_s > 0").select("key")
    empty = alive.join(words, "key", "left_anti").select("key", F.lit(0).cast("long").alias("dl"), F.array().cast("array<string>").alias("_w"))
    return _write(Index(index.spark, scratch(index.spark, "index"), []), words.unionByName(empty), None)


def live(index: Index, postings: DataFrame) -> DataFrame:
    """Postings that still count."""
    if len(index.generations) == 1:
        return postings
    return postings.join(small(index.table("retired").distinct()), ["key", "version"], "left_anti")


def _of_terms(index: Index, name: str, terms: DataFrame) -> DataFrame:
    """Rows of a table of the index for some terms; only the parts that they lie in are read."""
    rows = index.table(name)
    few = [r[0] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        parts = index.spark.createDataFrame([(t,) for t in few], "term string").select(F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).distinct().collect()
        rows = rows.filter(F.col("part").isin(*(p[0] for p in parts)))
    return rows


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries that have a text, or their terms already."""
    wanted = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term")) if "term" not in queries.columns else queries
    return wanted if "weight" in wanted.columns else wanted.withColumn("weight", F.lit(1.0))


def search(index: Index, queries: DataFrame, k: int = 10, skip: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, key, score, rank): the k best documents per query as in retrieval.bm25, and how many postings there were and were scored.

    A first pass scores the best blocks of each term and takes from them, per
    query, a score that k documents have at least, the floor. Terms whose bounds
    together stay below it cannot lift a document on their own: their postings
    are only looked up for documents that the other terms have found and that
    they could still lift to the floor. Of the other terms a block is skipped if
    its bound and the bounds of the query's other terms fall short together. A
    document with a posting that was passed over is below the floor, so the k
    best have all of theirs. With skip=False all postings are scored.
    """
    wanted = stored(wanted_terms(queries), "terms")
    n, mean = index.size()
    if not n:
        return wanted.select("query_id", F.lit(None).alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0), {"postings": 0, "read": 0}
    blocks = _of_terms(index, "blocks", wanted).join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term", "band").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    df = blocks.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = wanted.join(df, "term").withColumn("idf", idf * F.col("weight"))
    # A row per term of a query and band.
    bounds = stored(terms.join(blocks.filter("n > 0"), "term").withColumn("bound", F.col("idf") * F.col("best") * index.scale(mean)), "bounds")
    rows = live(index, _of_terms(index, "postings", wanted))
    total = bounds.agg(F.sum("n")).first()[0] or 0
    value = F.col("idf") * impact(F.col("tf"), F.col("dl"), mean)

    def scored(chosen: DataFrame) -> DataFrame:
        return rows.join(small(chosen.select("query_id", "term", "band", "idf")), ["term", "band"]).select("query_id", "key", value.alias("s"))

    def summed(met: DataFrame) -> DataFrame:
        return met.groupBy("query_id", "key").agg(F.sum("s").alias("score"))

    if not skip:
        return top(summed(scored(bounds)), k, "key"), {"postings": total, "read": total}
    upto = Window.partitionBy("query_id", "term").orderBy("band")
    first = bounds.withColumn("_before", F.sum("n").over(upto) - F.col("n")).filter(F.col("_before") < k)
    floor = top(summed(scored(first)), k, "key").filter(F.col("rank") == k).select("query_id", (F.col("score") - 1e-8).alias("floor"))
    whole = Window.partitionBy("query_id")
    most = bounds.groupBy("query_id", "term", "idf").agg(F.max("bound").alias("best_of")).join(floor, "query_id", "left")
    most = most.withColumns({"rest": F.sum("best_of").over(whole) - F.col("best_of"), "upto": F.sum("best_of").over(whole.orderBy("best_of", "term").rowsBetween(Window.unboundedPreceding, 0))})
    most = stored(most.withColumn("weak", F.coalesce(F.col("upto") < F.col("floor"), F.lit(False))), "term-bounds")
    strong = most.filter("NOT weak").select("query_id", "term", "rest", "floor")
    read = bounds.join(strong, ["query_id", "term"]).filter(F.col("floor").isNull() | (F.col("bound") + F.col("rest") >= F.col("floor")))
    met = stored(scored(read), "scored")
    lift = most.groupBy("query_id").agg(F.max("floor").alias("floor"), F.sum(F.when(F.col("weak"), F.col("best_of")).otherwise(0.0)).alias("lift"))
    able = summed(met).join(small(lift), "query_id").filter("lift > 0 AND score + lift >= floor").select("query_id", "key")
    more = rows.join(small(most.filter("weak").select("query_id", "term", "idf")), "term").join(small(stored(able, "able")), ["query_id", "key"]).select("query_id", "key", value.alias("s"))
    every = stored(met.unionByName(more), "scored")
    return top(summed(every), k, "key"), {"postings": total, "read": every.count()}


def lookup(index: Index, wanted: DataFrame) -> DataFrame:
    """`wanted` (term and what else it has) with the keys that have each term."""
    terms = stored(wanted, "terms")
    return live(index, _of_terms(index, "postings", terms)).select("term", "key").join(small(terms), "term")
