"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import let, stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a rule is a host and a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled rows that the trees are fitted on at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
#: Folds of the suffix statistics, and the labels that the overall rate counts as in each.
FOLDS, WEIGHT = 5, 20.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "query_length", "host_length", "host_labels", "hyphens", "suffix_rate", "suffix_weight")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; equals in length: the later in order of text. `rules` is a list a plan can hold."""
    fits = []
    for verdict, rule in rules:
        at, _, rest = rule.partition("/")
        ok = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*fits)))
    return best["rule"], best["verdict"]


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own character counts."""
    size = F.char_length(text)

    def bits(chars: Column) -> Column:
        shares = F.transform(chars, lambda c: (size - F.char_length(F.replace(text, c))) / size)
        return F.aggregate(F.transform(shares, lambda p: -p * F.log2(p)), F.lit(0.0), lambda a, x: a + x)

    return F.when(size > 0, let(F.array_remove(F.array_distinct(F.split(text, "")), ""), bits)).otherwise(0.0)


def lexical(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, suffix (the host's last label) and the lexical features but the suffix statistics."""
    host, path = url_parts(F.col(url_col))
    out = pages.withColumn("_url", F.coalesce(F.col(url_col), F.lit(""))).withColumns({"host": host, "path": path})
    size = F.char_length("_url")
    query = F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    return out.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "length": size.cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]+")).cast("double"),
        "digit_ratio": F.when(size > 0, F.regexp_count("_url", F.lit("[0-9]")) / size).otherwise(0.0),
        "entropy": _entropy(F.col("_url")),
        "n_params": F.regexp_count(query, F.lit("[^&;]+")).cast("double"),
        "query_length": F.char_length(query).cast("double"),
        "host_length": F.char_length("host").cast("double"),
        "host_labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
    }).drop("_url")


class UrlModel:
    """Fitted trees and suffix statistics; `trees` is None where the labels had one class only, `prior` is then the verdict."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, rate: float):
        self.trees, self.suffixes, self.rate = trees, suffixes, rate

    def score(self, urls: DataFrame) -> DataFrame:
        """`urls` (see lexical) with block_score in 0..1."""
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(float(self.rate > 0.5)))
        # The statistics come from TRAIN_ROWS rows at most, so the table has no more.
        out = with_suffixes(urls, self.suffixes, self.rate)
        out = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out)
        return self.trees.transform(out).withColumn("block_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "suffix_rate", "suffix_weight")


def with_suffixes(urls: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    joined = urls.join(F.broadcast(suffixes), "suffix", "left")
    return joined.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(rate)), "suffix_weight": F.coalesce("suffix_weight", F.lit(0.0))})


def _hash() -> Column:
    return F.xxhash64("host", "path", *(c for c in FEATURES if not c.startswith("suffix")))


def fit(labelled: DataFrame, label_col: str = "label", rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on labelled URLs (see lexical; label 1 blocks): all of them, or the `rows` of least hash.

    A training row's suffix statistics come from the other folds of FOLDS, so
    its own label is not among its features; URLs that are scored meet the
    statistics of all folds.
    """
    own = labelled.select("suffix", F.col(label_col).cast("double").alias("label"), _hash().alias("hash"), *(c for c in FEATURES if not c.startswith("suffix")))
    total = own.count()
    # `rows` bounds what is ordered; rows with the same hash and label are alike.
    keep = own if total <= rows else own.orderBy("hash", "label").limit(rows)
    kept = stage_table(keep.withColumn("fold", F.pmod("hash", F.lit(FOLDS))), "labelled-urls")
    rate = kept.agg(F.avg("label")).first()[0] or 0.0
    if rate in (0.0, 1.0):
        return UrlModel(None, None, rate)
    shrunk = lambda n, s: ((s + WEIGHT * rate) / (n + WEIGHT)).alias("suffix_rate")
    weight = lambda n: F.log1p(n.cast("double")).alias("suffix_weight")
    folds = kept.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("fn"), F.sum("label").alias("fs"))
    each = kept.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"))
    suffixes = stage_table(each.select("suffix", shrunk(F.col("n"), F.col("s")), weight(F.col("n"))), "suffixes")
    other = folds.join(each, "suffix").select("suffix", "fold", shrunk(F.col("n") - F.col("fn"), F.col("s") - F.col("fs")), weight(F.col("n") - F.col("fn")))
    # One order and one partition (TRAIN_ROWS bounds it): the same trees on any cluster.
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(kept.join(F.broadcast(other), ["suffix", "fold"]))
    data = data.select("features", "label").coalesce(1).sortWithinPartitions("label", *(vector_to_array("features")[i] for i in range(len(FEATURES))))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", checkpointInterval=-1).fit(data)
    return UrlModel(trees, suffixes, rate)


def held_out(labelled: DataFrame, label_col: str = "label", rows: int = TRAIN_ROWS, parts: int = 5) -> DataFrame:
    """One row: n, accuracy and majority (the accuracy of always giving the commoner label) on the fifth of hosts, by hash, that the trees are not fitted on."""
    part = F.pmod(F.xxhash64("host"), F.lit(parts))
    held = fit(labelled.filter(part > 0), label_col, rows).score(labelled.filter(part == 0))
    right = ((F.col("block_score") > 0.5) == (F.col(label_col) == 1)).cast("double")
    share = F.avg(F.col(label_col).cast("double"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))


def ruled(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """The URLs that a rule decides (see lexical), with label: what trees are fitted on where no labelled table is given."""
    urls = lexical(pages.select(F.col(url_col).alias("url")))
    return urls.withColumn("label", (best_rule(F.col("host"), F.col("path"), rules)[1] == "block").cast("int")).filter("label IS NOT NULL")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, by_rule and block_score of each row.

    A rule's verdict holds where one fits. The others are judged by trees that
    are trained on `labelled` (url and label), by default on the URLs that the
    rules themselves decide; these say nothing of suffixes that no rule names.
    Null and empty URLs and those without a scheme have empty parts and go to
    the trees, URLs of any length are read whole, rules that fit with equal
    length go by order of text; with labels of one class all get that verdict,
    with none they are allowed. Rows stay as they are repeated, an empty table
    stays empty, other columns are ignored.
    """
    urls = lexical(pages.select(id_col, F.col(url_col).alias("url")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    urls = stage_table(urls.withColumns({"rule": rule, "_ruled": verdict}), "urls")
    known = urls.filter("_ruled IS NOT NULL").withColumn("label", (F.col("_ruled") == "block").cast("int")) if labelled is None else lexical(labelled)
    scored = fit(known).score(urls)
    judged = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), F.col("rule").isNotNull().alias("by_rule"), F.round("block_score", 6).alias("block_score"))
