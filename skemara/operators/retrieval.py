"""Record search over linked tables: text scores, vectors, votes along keys, graph walks and cascades.

Everything takes a batch of queries as a table and keys on query_id, so one job
answers all of them. Queries are a stated, bounded set; the rows searched are not.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skemara.functions.scalar import cosine, l2, runs, tokens
from skemara.sources.scratch import apart, meet_blocks, small, stored

#: Words that carry no search meaning, and more that questions are padded with.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
FILLER = (
    "can", "could", "do", "does", "me", "my", "please", "show", "tell", "what", "which", "who", "you", "report", "reports", "record", "records", "number", "numbers", "entry", "entries",
    "details", "including", "about", "regarding", "corresponding", "specifically", "give", "get", "find", "list", "display", "provide",
)
#: Queries, or distinct terms of queries, that meet a row at once.
BLOCK = 256
#: Rows that a token adds over all queries that ask for it, above which it counts as frequent.
FREQUENT = 1_000_000
#: Keys, and queries, of a date that are paired at once; queries of a date that are numbered together; pairs that a task writes.
DATE_KEYS, DATE_QUERIES, DATE_BLOCK, PAIRS_PER_TASK = 2048, 512, 65_536, 32_000_000
#: Postings that a task sums up.
POSTINGS_PER_TASK = 250_000
#: Bytes of query vectors, and of vectors, that meet in one task.
QUERY_BYTES, PART_BYTES = 16 << 20, 64 << 20
#: Queries and vectors of a tile of products, which stays in a core's cache.
ROWS, COLUMNS = 256, 2048
K1, B = 1.2, 0.75


def documents(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """(table, doc_id, text): a row's columns joined by " | ", white space squeezed."""
    text = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("doc_id"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def search_terms(text: Column, filler: tuple[str, ...] = ()) -> Column:
    """Tokens without stop words (and without those of `filler`), distinct, in order."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*(F.lit(w) for w in (*STOP, *filler))))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): counts per term and document, with the document's length."""
    words = docs.select(key, tokens(F.col(text)).alias("_w")).withColumn("dl", F.size("_w").cast("long"))
    return words.select(key, "dl", F.explode("_w").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def row_counts(words: DataFrame, key: str) -> DataFrame:
    """(key, dl, term, tf): how often each word is in a row's `_w`: the runs of its sorted words, so nothing is shuffled."""
    rows = words.filter(F.size("_w") > 0).select(key, "dl", F.sort_array("_w").alias("_s"))
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))))
    runs_of = F.transform("_at", lambda i, at: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_at", at + 1), F.size("_s")) - i).cast("long").alias("tf")))
    return rows.select(key, "dl", F.explode(runs_of).alias("x")).select(key, "dl", "x.term", "x.tf")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): the k best documents per query, ties by key. `queries` has query_id, text and maybe weights per term (term, weight).

    Texts are split once and their words counted where they are read: a row's
    words are sorted, and each run of equal ones is a posting if it is a term of
    a query. Only those are stored. They are dealt by document, about
    POSTINGS_PER_TASK to a task, so what a task sums up does not grow with the texts.
    """
    wanted = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term")) if "term" not in queries.columns else queries
    if "weight" not in wanted.columns:
        wanted = wanted.withColumn("weight", F.lit(1.0))
    wanted = stored(wanted, "terms")
    split = docs.select(key, tokens(F.col(text)).alias("_w"))
    n, words = split.agg(F.count(F.lit(1)), F.sum(F.size("_w"))).first()
    length = (words or 0) / max(1, n) or 1.0
    hit = row_counts(split.withColumn("dl", F.size("_w").cast("long")), key).join(small(wanted.select("term").distinct()), "term", "left_semi")
    # Rows of one key and length count as one document.
    if not docs.groupBy(key).count().filter("count > 1").isEmpty():
        hit = hit.groupBy(key, "dl", "term").agg(F.sum("tf").alias("tf"))
    hit = stored(hit, "postings")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(length)))) * F.col("weight")
    dealt = hit.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hit.count() // POSTINGS_PER_TASK)), key)
    scores = dealt.join(small(stored(wanted.join(df, "term"), "weights")), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    return top(scores, k, key)


def top(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows per query, scores to nine places so that ties go by key."""
    scores = scores.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def containment(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Fallback: documents that contain a query's token as a substring, scored by the number of tokens.

    A token has no other characters than words have, so it lies within one word:
    the distinct words' substrings of the tokens' lengths meet the tokens by
    equality, and documents meet the words that hold a token. Tokens that many
    queries ask for and many documents hold are frequent; a document with none
    of a query's other tokens is among its best only if it is among the best of
    the query's frequent ones, and each set of these is answered once.
    """
    wanted = stored(queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term")).distinct(), "terms")
    lengths = sorted(r[0] for r in wanted.select(F.char_length("term")).distinct().collect())
    words = docs.select(key, "text").withColumn("_r", F.monotonically_increasing_id()).select(key, "_r", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    # A substring of each length at each place, where the word goes on that far.
    cuts = F.flatten(F.array(*(F.when(F.char_length("word") >= n, F.transform(F.sequence(F.lit(1), F.char_length("word") - n + 1), lambda i: F.substring("word", i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in lengths))) if lengths else F.array().cast("array<string>")
    held = words.select("word").distinct().select("word", F.explode(F.array_distinct(cuts)).alias("term")).join(small(wanted.select("term").distinct()), "term")
    hits = stored(words.join(small(stored(held, "words")), "word").select("_r", key, "term").distinct().drop("_r"), "hits")
    each = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted.groupBy("term").agg(F.count(F.lit(1)).alias("asked")), "term")
    often = each.filter((F.col("asked") > 1) & (F.col("df") * F.col("asked") > FREQUENT)).select("term", F.lit(True).alias("_f"))
    terms = stored(wanted.join(small(often), "term", "left").withColumn("_f", F.coalesce("_f", F.lit(False))), "terms")

    def summed(asked: DataFrame) -> DataFrame:
        return hits.join(small(asked), "term").groupBy("query_id", key).agg(F.count(F.lit(1)).cast("double").alias("score"))

    found = stored(summed(terms.filter("NOT _f").select("query_id", "term")), "found")
    # Sets of frequent tokens, and who asks for them.
    sets = stored(terms.filter("_f").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("_s")), "sets")
    alone = top(summed(sets.select(F.col("_s").alias("query_id"), F.explode("_s").alias("term")).distinct()), k, key).drop("rank")
    rest = sets.join(alone.withColumnRenamed("query_id", "_s"), "_s").select("query_id", key, "score")
    more = found.select("query_id", key).join(small(terms.filter("_f").select("query_id", "term")), "query_id").withColumnRenamed(key, "_key").join(hits.withColumnRenamed("term", "_t"), (F.col("term") == F.col("_t")) & F.col("_key").eqNullSafe(F.col(key))).groupBy("query_id", key).agg(F.count(F.lit(1)).cast("double").alias("score"))
    whole = found.unionByName(more).groupBy("query_id", key).agg(F.sum("score").alias("score"))
    return top(whole.unionByName(rest).groupBy("query_id", key).agg(F.max("score").alias("score")), k, key)


def exact_numbers(docs: DataFrame, queries: DataFrame, columns: list[str], key: str, most: int = 3) -> DataFrame:
    """(query_id, key, score): rows in which a number of the query stands alone in an id-like column; `most` numbers per query."""
    numbers = queries.select("query_id", F.explode(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))), 1, most)).alias("number"))
    cells = docs.select(key, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("cell"))
    parts = cells.select(key, F.explode(F.array_distinct(F.regexp_extract_all("cell", F.lit(r"(\d+)"), F.lit(1)))).alias("number"))
    return parts.join(numbers, "number").groupBy("query_id", key).agg(F.count(F.lit(1)).cast("double").alias("score"))


def by_date(docs: DataFrame, dates: DataFrame, key: str, when: str) -> DataFrame:
    """(query_id, key, score): rows of a query's date: 3 for the day, 2 for year and month, 1 for the month alone. `dates` has query_id, year, month, day with nulls.

    A row states its day, its month and its month of any year. The keys that
    make a statement are cut into parts and the queries that ask for it into
    lists, both of bounded size, and each part meets each list in a task. A
    query that asks once meets a key with one date once, so these pairs, as
    many as the result has, are written as they are found; the others are
    summed up. The merge join hands on the keys of a part list by list, so rows
    repeat a key, and keys the same list, and files hold a row in a fraction of
    a byte.
    """
    none, by = F.lit(0), ["score", "y", "m", "d"]
    kind = F.when(F.col("year").isNotNull() & F.col("day").isNotNull(), 3).when(F.col("year").isNotNull(), 2).when(F.col("day").isNull(), 1)
    asked = dates.select("query_id", kind.alias("score"), F.coalesce("year", none).alias("y"), F.col("month").alias("m"), F.coalesce("day", none).alias("d")).filter("score IS NOT NULL AND m IS NOT NULL").distinct()
    asked = stored(asked.join(asked.groupBy("query_id").agg((F.count(F.lit(1)) == 1).alias("_q")).withColumnRenamed("query_id", "_i"), F.col("query_id").eqNullSafe(F.col("_i"))).drop("_i"), "asked")
    every = docs.select(key, F.to_date(when).alias("_d")).filter("_d IS NOT NULL")
    days = every.groupBy(key).agg(F.min("_d").alias("_d"), (F.min("_d") == F.max("_d")).alias("_k"))
    y, m, d = F.year("_d"), F.month("_d"), F.day("_d")
    says = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), a.alias("y"), m.alias("m"), b.alias("d")) for s, a, b in ((3, y, d), (2, y, none), (1, none, none)))))
    # Rows and queries of each statement that has both, and the parts and lists that they make.
    rows = every.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).select("_n", says.alias("x")).select("x.*", "_n").groupBy(*by).agg(F.sum("_n").alias("_n"))
    both = stored(rows.join(asked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by), "statements")
    pairs = both.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_PER_TASK))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = asked.join(both.select(*by, F.ceil(F.col("_n") / DATE_KEYS).cast("int").alias("_parts"), F.ceil(F.col("_m") / DATE_BLOCK).cast("int").alias("_blocks")), by).withColumn("_block", cut("query_id", "_blocks"))
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("query_id")) - 1
    asked = stored(asked.withColumn("_list", F.floor(place / DATE_QUERIES).cast("int") * F.col("_blocks") + F.col("_block")).drop("_block", "_blocks"), "lists")

    def met(rows: DataFrame, part: DataFrame) -> DataFrame:
        at = [*by, "_list", "_part"]
        lists = part.groupBy(*by, "_list", "_parts").agg(F.collect_list(F.struct("query_id")).alias("_l"))
        keys = rows.select(key, says.alias("x")).select(key, "x.*").join(small(lists.drop("_l")), by).withColumn("_part", cut(key, "_parts")).select(key, *at).repartition(tasks, *at)
        lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*at, F.col("_l")["query_id"].alias("_l")).repartition(tasks, *at)
        return keys.hint("merge").join(lists, at).select(F.explode("_l").alias("query_id"), key, F.col("score").cast("double").alias("score"))

    found = met(days.filter("_k").drop("_k"), asked.filter("_q").drop("_q"))
    several = stored(days.filter("NOT _k").select(F.col(key).alias("_key")), "several")
    every = every.distinct()
    rest = []
    if not asked.filter("NOT _q").isEmpty():
        rest.append(met(every, asked.filter("NOT _q").drop("_q")))
    if not several.isEmpty():
        rest.append(met(every.join(small(several), F.col(key).eqNullSafe(F.col("_key")), "left_semi"), asked.filter("_q").drop("_q")))
    return reduce(lambda a, b: a.unionByName(b), [found, *(r.groupBy("query_id", key).agg(F.max("score").alias("score")) for r in rest)])


def date_features(text: Column) -> Column:
    """Years, months by name, ISO dates and epoch milliseconds that a question names."""
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    named = F.array_compact(F.array(*(F.when(F.lower(text).rlike(rf"\b{m}\b"), F.lit(i + 1)) for i, m in enumerate(months))))
    return F.struct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)).alias("years"), named.alias("months"), F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)).alias("dates"), F.regexp_extract_all(text, F.lit(r"\b(\d{13})\b"), F.lit(1)).alias("epochs"))


def constraints(text: Column) -> Column:
    """What a question states: ids after "id" or "number", quoted names, statuses and keywords."""
    lower = F.lower(text)
    pairs = {
        "id": F.regexp_extract_all(lower, F.lit(r"(?:\bid|number|no\.?|#)\s*:?\s*(\d+)"), F.lit(1)), "name": F.regexp_extract_all(text, F.lit(r"\"([^\"]+)\""), F.lit(1)),
        "status": F.regexp_extract_all(lower, F.lit(r"\b(open|closed|active|inactive|pending|granted)\b"), F.lit(1)), "keyword": F.regexp_extract_all(lower, F.lit(r"keywords?\s*:?\s*([a-z0-9_ ]+?)(?:[,.;]|$)"), F.lit(1)),
    }
    return F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: F.size(v) > 0)


def structured(rows: DataFrame, wanted: dict[str, list[str]], key: str) -> DataFrame:
    """(key, score): rows that meet every column's constraint, any of its values; 60 and 8 more per column."""
    test = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c).cast("string")), F.lit(v.lower())) for v in vs)) for c, vs in wanted.items()))
    return rows.filter(test).select(key, F.lit(60.0 + 8 * len(wanted)).alias("score"))


def entities(df: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """(phrase, column, n): frequent values per column, lists split; phrases of one to five tokens."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x"))
    parts = cells.select("x.column", F.explode(F.split("x.v", r"[,|;/]+")).alias("p")).withColumn("phrase", F.array_join(tokens(F.col("p")), " "))
    counts = parts.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) <= 5)).groupBy("column", "phrase").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "phrase")
    return counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def match_entities(queries: DataFrame, dictionary: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, phrase, column, place): dictionary phrases of a question, read from left to right: at each token the longest
    phrase that begins there is taken and its tokens are used up. Each phrase once, in the order of the text, the first `most`.

    Runs of one to five tokens meet the dictionary in one join; what a question matches (a few entries per token) is then
    consumed in its own row.
    """
    w = queries.select("query_id", tokens(F.col("text")).alias("w"))
    grams = [w.filter(F.size("w") >= n).select("query_id", F.lit(n).alias("len"), F.posexplode(runs(F.col("w"), n)).alias("at", "phrase")) for n in range(1, 6)]
    hits = reduce(lambda a, b: a.unionByName(b), grams).join(dictionary.groupBy("phrase").agg(F.min("column").alias("column")), "phrase")
    entry = F.struct("at", (-F.col("len")).alias("short"), "phrase", "column")
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_h"))
    pair = "array<struct<phrase:string,column:string>>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(pair).alias("taken"))

    def consume(state: Column, h: Column) -> Column:
        after = F.struct((h["at"] - h["short"]).alias("next"), F.concat(state["taken"], F.array(F.struct(h["phrase"].alias("phrase"), h["column"].alias("column")))).alias("taken"))
        return F.when(h["at"] >= state["next"], after).otherwise(state)

    taken = F.slice(F.array_distinct(F.aggregate("_h", start, consume)["taken"]), 1, most)
    return found.select("query_id", F.posexplode(taken).alias("place", "x")).select("query_id", "x.phrase", "x.column", "place")


def inverted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, token, key): an inverted index over several columns."""
    cells = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x"))
    return cells.select("x.column", F.explode(F.array_distinct(tokens(F.col("x.v")))).alias("token"), "key")


def intersect_groups(hits: DataFrame) -> DataFrame:
    """(query_id, key, groups): rows that meet all of a query's groups, else those that meet all but one. `hits` has query_id, group, key."""
    want = hits.groupBy("query_id").agg(F.countDistinct("group").alias("want"))
    per = hits.groupBy("query_id", "key").agg(F.countDistinct("group").alias("groups")).join(want, "query_id")
    best = F.max("groups").over(Window.partitionBy("query_id"))
    return per.withColumn("_b", best).filter((F.col("groups") == F.col("_b")) & (F.col("groups") >= F.greatest(F.lit(1), F.col("want") - 1))).select("query_id", "key", "groups")


def expand(hits: DataFrame, link: DataFrame, child: str, parent: str, k: int = 10) -> DataFrame:
    """(query_id, parent, score): children's scores summed at their parents, the k best."""
    scores = hits.join(link.select(F.col(child).alias("key"), F.col(parent).alias("parent")), "key").filter("parent IS NOT NULL").groupBy("query_id", "parent").agg(F.sum("score").alias("score"))
    return top(scores, k, "parent")


def unite(parts: list[DataFrame], k: int) -> DataFrame:
    """The best score of each (query, table, row) over several sources, the k best of each query."""
    both = reduce(lambda a, b: a.unionByName(b), parts).groupBy("query_id", "table", "key").agg(F.max("score").alias("score"))
    return top(both, k, "table", "key")


def bonus(text: Column, terms: Column, phrase: Column, weight: float = 1.0) -> Column:
    """Share of a query's terms in a field by weight, and as much again for a phrase in it."""
    low = F.lower(text)
    share = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.contains(low, t).cast("double")) / F.greatest(F.size(terms), F.lit(1))
    return weight * (share + F.exists(phrase, lambda p: F.contains(low, p)).cast("double"))


def row_text(columns: list[str], key: str, most: int = 300) -> Column:
    """"name: value" lines, the key first, nulls left out, values cut."""
    names = [key, *(c for c in columns if c != key)]
    return F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.substring(F.col(c).cast("string"), 1, most))) for c in names))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, measure: str = "l2", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): exact nearest vectors of `queries` (query_id, vector), a stated set.

    Blocks of queries meet parts of the vectors within tasks, in matrix products
    that only choose candidates; these are scored one by one, in the order of
    their dimensions, and a task sends on the best k of its part. Vectors that
    are null, of another length than the queries' or hold what a product cannot
    rank (nulls, NaN, values near overflow or underflow) meet by expressions.
    """
    return top(pairs(vectors, queries, k, measure, key), k, key)


def pairs(vectors: DataFrame, queries: DataFrame, k: int, measure: str, key: str, *by: str) -> DataFrame:
    """(query_id, by, key, score): the pairs of which `nearest` takes the best; with columns `by` on both sides, those of vectors whose values there are the query's."""
    v, q = vectors.select(*by, key, "embedding"), queries.select("query_id", *by, "vector")
    d = q.agg(F.max(F.when(F.col("vector").isNotNull(), F.size("vector")))).first()[0] or 0
    usual = lambda c: _rankable(c, d, (q if c == "vector" else v).schema[c].dataType)
    (n, odd_n), (m, odd_m) = (df.agg(F.count(F.lit(1)), F.count(F.when(~usual(c), 1))).first() for df, c in ((v, "embedding"), (q, "vector")))
    # Three pairs of block and part to a core, fewer if that were less than 2^30 products in each.
    least = min(3 * v.sparkSession.sparkContext.defaultParallelism, 1 + (n * m * d >> 30))
    blocks, parts = _tiling(n, m, max(1, d), k, least)
    of = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
    # Little data but much work, so the number of tasks is explicit: one for each pair of block and part, or with tasks to spare where hashes of `by` deal them unevenly.
    tasks, cells = (blocks * parts + 4 * least, list(range(blocks * parts))) if by else (blocks * parts, apart(v.sparkSession, blocks * parts))
    cell = lambda places: F.explode(F.transform(places, lambda x: F.element_at(F.lit(cells), x + 1)))
    block, part = of(blocks, "query_id"), of(parts, key, "embedding")
    asked = q.filter(usual("vector")).select(cell(F.sequence(block * parts, block * parts + (parts - 1))).alias("cell"), "query_id", *by, "vector").repartition(tasks, "cell", *by)
    dealt = v.filter(usual("embedding")).select(cell(F.sequence(part, part + (blocks - 1) * parts, F.lit(parts))).alias("cell"), *by, key, "embedding").repartition(tasks, "cell", *by)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        # Rows in order of their keys, so that ties go by place.
        right = right.take(pc.sort_indices(right, sort_keys=[(key, "ascending")], null_placement="at_start"))
        a, b = (t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64) for t, c in ((left, "vector"), (right, "embedding")))
        i, j, score = nearest_rows(a, b, k, measure)
        return pa.table({**{c: left.column(c).take(pa.array(i)) for c in ("query_id", *by)}, key: right.column(key).take(pa.array(j)), "score": score})

    shape = T.StructType([q.schema["query_id"], *(q.schema[c] for c in by), v.schema[key], T.StructField("score", T.DoubleType())])
    found = asked.groupBy("cell", *by).cogroup(dealt.groupBy("cell", *by)).applyInArrow(best, shape)
    if odd_n:
        found = found.unionByName(_scored(v.filter(~usual("embedding")), q, m, measure, key, *by))
    if odd_m:
        found = found.unionByName(_scored(v.filter(usual("embedding")), q.filter(~usual("vector")), odd_m, measure, key, *by))
    return found


def _rankable(c: str, d: int, kind: T.ArrayType) -> Column:
    """Whether a product can rank a vector of d numbers.

    Squares of single precision are far from underflow in double precision, so
    its extremes tell, without a function for each number.
    """
    if isinstance(kind.elementType, T.FloatType):
        # No number is 2e35 here, so looking for it gives null if one is null, else false.
        within = (F.array_max(c) <= 1e35) & (F.array_min(c) >= -1e35) & ~F.array_contains(c, F.lit(2e35).cast("float"))
    else:
        within = F.forall(c, lambda x: F.coalesce((x == 0) | F.abs(x).between(1e-35, 1e35), F.lit(False)))
    return F.coalesce((F.size(c) == d) & within, F.lit(False))


def _tiling(n: int, m: int, d: int, k: int, tasks: int) -> tuple[int, int]:
    """Blocks of m queries and parts of n vectors of d numbers, at least `tasks` pairs of them.

    A part costs each query its k best once more, each about as much as sixteen
    numbers of a vector; a block costs each vector once more.
    """
    parts = max(1, math.isqrt(tasks * n * d // max(1, 16 * k * m)))
    blocks = max(1, -(-m * d * 8 // QUERY_BYTES), -(-tasks // parts))
    return blocks, max(1, -(-n * d * 8 // PART_BYTES), -(-tasks // blocks))


def _scored(vectors: DataFrame, queries: DataFrame, asked: int, measure: str, key: str, *by: str) -> DataFrame:
    """(query_id, by, key, score) of all pairs by expressions, in blocks of about BLOCK queries."""
    count = max(1, -(-asked // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")
    blocks = queries.select(block.alias("block"), F.struct("query_id", *by, F.col("vector").alias("q")).alias("x")).groupBy("block").agg(F.collect_list("x").alias("qs"))
    met = meet_blocks(vectors, blocks, count).select(*by, key, "embedding", F.explode("qs").alias("x"))
    for c in by:
        met = met.filter(F.col(c) == F.col(f"x.{c}"))
    score = -l2(F.col("x.q"), F.col("embedding")) if measure == "l2" else cosine(F.col("x.q"), F.col("embedding"))
    return met.select(F.col("x.query_id").alias("query_id"), *by, key, score.alias("score"))


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): for each row i of `a` the rows j of `b` that may be among its k best by (score to nine places, j).

    All that lie within rounding of the k-th best are kept, but of equal scores
    and of equal rows of `b` the first k only.
    """
    d = a.shape[1]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(a) or not len(b):
        return none
    if d:
        _, same = np.unique(np.ascontiguousarray(b).view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)
        keep = np.flatnonzero(_places(same) < k)
    else:
        keep = np.arange(min(k, len(b)))
    b = b[keep]
    (aa, bb), cos = ((sum((x[:, t] * x[:, t] for t in range(d)), np.zeros(len(x)))) for x in (a, b)), measure != "l2"
    ta, tb = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        for t in range(d):
            x, y = ta[t][i], tb[t][j]
            total += x * y if cos else (x - y) * (x - y)
        if not cos:
            return -total
        size = np.sqrt(aa[i] * bb[j])
        return np.where(size > 0, total / np.where(size > 0, size, 1.0), 0.0)

    # Products of x and y: units, or rows about an origin in their midst, scaled to norms of one at most.
    if cos:
        x, y = (v / np.sqrt(np.where(vv > 0, vv, 1.0))[:, None] for v, vv in ((a, aa), (b, bb)))
    else:
        origin = np.median(b[:: 1 + len(b) // 2048], axis=0)
        x, y = a - origin, b - origin
        scale = math.ldexp(1.0, -math.frexp(math.sqrt(max((v * v).sum(axis=1).max() for v in (x, y))))[1])
        x, y = x * scale, y * scale
    xx, yy = ((v * v).sum(axis=1) for v in (x, y))
    # A product of rows is off by less than slack * (2 * xx + 2 * yy), one of units by less than slack; the part of yy goes with y.
    slack = lambda kind: 2 * (d + 4) * float(np.finfo(kind).eps)
    asking = lambda at, kind: (x[at] if cos else np.c_[2 * x[at], np.ones(len(x[at]))]).astype(kind)
    asked = lambda at, kind: (y[at] if cos else np.c_[y[at], (2 * slack(kind) - 1) * yy[at]]).astype(kind)

    def least(bar: np.ndarray, at: slice, kind: type) -> np.ndarray:
        """What the product of a row in `at` with one that scores `bar` or more comes to at least."""
        low = bar - 2.5e-9 - slack(kind) if cos else (bar - 2.5e-9) * scale * scale + (1 - 2 * slack(kind)) * xx[at] - 1e-30
        with np.errstate(over="ignore"):
            return low.astype(kind)[:, None]

    out, others = [], asked(slice(None), np.float32)
    tile, over = (np.empty(ROWS * COLUMNS, t) for t in (np.float32, bool))
    for low in range(0, len(a), ROWS):
        own = slice(low, low + ROWS)
        left = asking(own, np.float32)
        rows = len(left)
        bar, held, waiting = np.full(rows, -np.inf), none, []
        for at in range(0, len(b), COLUMNS):
            right = others[at : at + COLUMNS].T
            near, hit = (buffer[: rows * right.shape[1]].reshape(rows, -1) for buffer in (tile, over))
            np.matmul(left, right, out=near)
            if not at and near.shape[1] >= k:
                first = np.argpartition(near, -k, axis=1)[:, -k:]
                bar = exact(np.repeat(np.arange(rows), k) + low, first.ravel()).reshape(rows, k).min(axis=1)
            i, j = _spots(np.greater_equal(near, least(bar, own, np.float32), out=hit))
            if len(i) > near.size // 16:
                i, j = _spots(asking(own, np.float64) @ asked(slice(at, at + COLUMNS), np.float64).T >= least(bar, own, np.float64))
            waiting.append((i, j + at))
            if at + COLUMNS < len(b) and sum(len(i) for i, _ in waiting) < 2 * rows * k:
                continue
            i, j = (np.concatenate(v) for v in zip(*waiting, strict=True))
            i, j, score = (np.concatenate(v) for v in zip(held, (i, j, exact(i + low, j)), strict=True))
            waiting = []
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            place = _places(i)
            full = place == k - 1
            bar[i[full]] = np.maximum(bar[i[full]], score[full])
            fresh = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (score[1:] != score[:-1])]) if len(i) else i
            tied = np.arange(len(i)) - np.repeat(fresh, np.diff(np.r_[fresh, len(i)]))
            stay = (score >= bar[i] - 2.5e-9) & (tied < k)
            held = i[stay], j[stay], score[stay]
        out.append((held[0] + low, keep[held[1]], held[2]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _spots(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true elements, looked for by eights."""
    flat = hit.ravel()
    flat = np.r_[flat, np.zeros(-len(flat) % 8, bool)].reshape(-1, 8) if len(flat) % 8 else flat.reshape(-1, 8)
    some = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat[some])
    return np.divmod(some[i] * 8 + j, hit.shape[1])


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each element among the equal ones, in order: 0, 1, ..."""
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else ranked
    places = np.empty(len(group), np.int64)
    places[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return places


def vote(matches: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, target, votes, score, rank): hits in any table vote for the target rows they link to; most votes, then best score.

    `matches` has query_id, table, key, score; `links` table, key, target.
    """
    votes = matches.join(links, ["table", "key"]).groupBy("query_id", "target").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), F.desc("score"), "target")
    return votes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank(results: DataFrame, scores: DataFrame, k: int, key: str) -> DataFrame:
    """The first 5k results in order of a supplied score, k of them. `scores` has (query_id, key, score), or (key, score) for all queries."""
    on = [c for c in ("query_id", key) if c in scores.columns]
    met = results.filter(F.col("rank") <= 5 * k).drop("rank", "score").join(scores, on)
    return top(met, k, key)


def graph(tables: dict[str, tuple[DataFrame, str]], links: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, table, text) and edges (a, b, both ways) of rows linked by keys; `links` are (child, column, parent)."""
    nodes = reduce(lambda a, b: a.unionByName(b), (df.select(F.concat(F.lit(f"{t}\t"), F.col(key).cast("string")).alias("node"), F.lit(t).alias("table"), F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).alias("text")) for t, (df, key) in tables.items()))
    edges = reduce(lambda a, b: a.unionByName(b), (tables[c][0].filter(F.col(col).isNotNull()).select(F.concat(F.lit(f"{c}\t"), F.col(tables[c][1]).cast("string")).alias("a"), F.concat(F.lit(f"{p}\t"), F.col(col).cast("string")).alias("b")) for c, col, p in links))
    return nodes, edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def seeds(nodes: DataFrame, queries: DataFrame, target: str, most: int = 500) -> DataFrame:
    """(query_id, node, score): token hits, 1.5 for numbers of three digits and more, 0.6 more for target rows."""
    q = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("t"))
    words = nodes.select("node", "table", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    w = F.when(F.col("t").rlike(r"^\d{3,}$"), 1.5).otherwise(1.0)
    scores = words.join(q, "t").groupBy("query_id", "node", "table").agg(F.sum(w).alias("s")).withColumn("score", F.col("s") + F.when(F.col("table") == target, 0.6).otherwise(0.0))
    return top(scores.select("query_id", "node", "score"), most, "node").select("query_id", "node", "score")


def walk(start: DataFrame, edges: DataFrame, target: str, hops: int = 3, k: int = 10, decay: float = 0.74) -> DataFrame:
    """(query_id, node, score, paths, rank): target rows that a walk of `hops` edges reaches.

    A node's score at a depth is the best of its arrivals, each `decay` of the
    step before; a target row has the best over depths and 0.1 more for each
    further arrival, five at most. Rounds are joins on the frontier, which is
    stored after each, so a hop is computed once.
    """
    front = start.select("query_id", "node", "score").withColumn("arrivals", F.lit(1).cast("long"))
    found = front
    for _ in range(hops):
        step = front.join(edges, front["node"] == edges["a"]).select("query_id", F.col("b").alias("node"), (F.col("score") * decay).alias("score"))
        front = stored(step.groupBy("query_id", "node").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("arrivals")), "frontier")
        found = found.unionByName(front)
    hit = found.filter(F.startswith("node", F.lit(f"{target}\t"))).groupBy("query_id", "node").agg(F.max("score").alias("best"), F.sum("arrivals").alias("paths"))
    return top(hit.select("query_id", "node", (F.col("best") + 0.1 * F.least(F.col("paths") - 1, F.lit(5))).alias("score"), "paths"), k, "node")


def soft_filter(rows: DataFrame, tests: list[tuple[Column, float]], key: str, k: int, strict: float = 0.7, loose: float = 0.5) -> DataFrame:
    """(key, score): rows with `strict` of all points; with `loose` if there is none."""
    points = reduce(lambda a, b: a + b, (F.when(t, p).otherwise(0.0) for t, p in tests))
    total = sum(p for _, p in tests)
    scored = rows.select(key, F.coalesce(points, F.lit(0.0)).alias("score")).filter(F.col("score") >= loose * total)
    best = scored.agg(F.max("score")).first()[0]
    least = strict if best is not None and best >= strict * total else loose
    return scored.filter(F.col("score") >= least * total).orderBy(F.desc("score"), key).limit(k)


def cascade(stages: list[DataFrame], k: int) -> DataFrame:
    """Of each query the results of the first stage that has any, k of them. Stages have query_id, key, score."""
    both = reduce(lambda a, b: a.unionByName(b), (s.select("query_id", "key", "score").withColumn("stage", F.lit(i)) for i, s in enumerate(stages)))
    first = F.min("stage").over(Window.partitionBy("query_id"))
    return top(both.withColumn("_f", first).filter(F.col("stage") == F.col("_f")).drop("_f"), k, "key")


def compare_modes(results: DataFrame, modes: int) -> DataFrame:
    """Per query: rows that all modes return, that one alone does, all rows, and the share in common. `results` has query_id, mode, key."""
    per = results.groupBy("query_id", "key").agg(F.countDistinct("mode").alias("m"))
    return per.groupBy("query_id").agg(F.sum((F.col("m") == modes).cast("int")).alias("common"), F.sum((F.col("m") == 1).cast("int")).alias("single"), F.count(F.lit(1)).alias("n"), F.avg((F.col("m") == modes).cast("double")).alias("share"))


def similar_examples(examples: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Cosine top 3k, re-ranked by shared tags (arrays `tags` on both sides)."""
    near = nearest(examples, queries, 3 * k, "cosine", key).drop("rank")
    tagged = near.join(examples.select(key, "tags"), key).join(queries.select("query_id", F.col("tags").alias("want")), "query_id")
    return top(tagged.withColumn("score", F.size(F.array_intersect("tags", "want")) + F.col("score")).drop("tags", "want"), k, key)


PREPROCESS = {"identity": lambda c: c, "whitespace": lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))}


def preprocess(text: Column, steps: list[str]) -> Column:
    """Registered steps one after the other."""
    return reduce(lambda c, s: PREPROCESS[s](c), steps, text)


def guarded(spark, sql: str, limit: int | None = None) -> DataFrame:
    """A read-only statement's result, NaN and infinities as nulls; anything but SELECT or WITH is refused."""
    word = sql.strip().split(None, 1)[0].lower() if sql.strip() else ""
    if word not in ("select", "with") or ";" in sql.strip().rstrip(";"):
        raise ValueError("only one SELECT or WITH statement may run")
    out = spark.sql(sql.strip().rstrip(";"))
    clean = {c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)) for c, t in out.dtypes if t in ("double", "float")}
    out = out.withColumns(clean) if clean else out
    return out.limit(limit) if limit else out
