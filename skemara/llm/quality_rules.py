"""Quality rules per document and per host.

Each text is measured in its own row, without a shuffle. Failures are summed by
host, each host's rate is shrunk with a beta prior fitted to all hosts by the
method of moments, and a document falls if it fails a base rule or if its
host's shrunk rate of some rule is over the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import checked_broadcast, let, shield, stage_table

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host falls over this shrunk share of failing documents.
HOST_LIMIT = 0.5
#: The prior weighs as many documents at most, for hosts that are all alike.
MAX_PRIOR = 1000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(hashes: Column) -> Column:
        same = lambda g, other: F.coalesce(other["h"] == g["h"], F.lit(False))

        def places(grams: Column) -> Column:
            twice = F.filter(grams, lambda g, k: same(g, F.get(grams, k + 1)) | same(g, F.get(grams, k - 1)))
            return let(F.sort_array(F.transform(twice, lambda g: g["i"])), covered)

        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        # Most texts repeat no window: a hash set tells so without a sort.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(placed), places))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, let(windows, repeats)).otherwise(0)


MADE = (*MEASURES, "base_failed", "host_failed", "kept")
#: Names that columns have on the way.
WORK = ("_m", "_host", "_fallen")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows of words are compared by a 64-bit hash within their own text. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("_m", found).withColumns({
        "n_words": F.col("_m.n_words").cast("long"),
        "word_chars": F.col("_m.word_chars").cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": F.col("_m.n_repeat_words").cast("long"),
    }).drop("_m")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


#: Rules whose failures are counted for a host, over the measures.
HOST_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
    "symbols": "10 * n_symbols > n_words",
}


def host_verdicts(measured: DataFrame, host_col: str = "source", rules: dict[str, str] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, and for each rule the failures, the shrunk rate, and whether the host falls.

    Mean and variance of the hosts' rates give the prior Beta(a, b): its weight
    a + b is mean * (1 - mean) / variance - 1, held to 0..MAX_PRIOR. A null
    host is a host of its own.
    """
    rules = rules or HOST_RULES
    hosts = stage_table(measured.groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.when(F.expr(r), 1).otherwise(0)).alias(f"failed_{k}") for k, r in rules.items())), "hosts")
    rates = {k: F.col(f"failed_{k}") / F.col("n_docs") for k in rules}
    prior = hosts.agg(*(f(rates[k]).alias(f"{n}_{k}") for k in rules for n, f in (("mean", F.avg), ("var", F.var_samp)))).first()
    shrunk = {}
    for k in rules:
        mean, var = prior[f"mean_{k}"] or 0.0, prior[f"var_{k}"] or 0.0
        weight = min(MAX_PRIOR, max(0.0, mean * (1 - mean) / var - 1)) if var > 0 else MAX_PRIOR
        shrunk[f"rate_{k}"] = (F.col(f"failed_{k}") + mean * weight) / (F.col("n_docs") + weight)
    out = hosts.withColumns(shrunk)
    return out.withColumn("host_failed", F.greatest(*(F.col(f"rate_{k}") > limit for k in rules)))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_text: bool = True, limit: float = HOST_LIMIT) -> DataFrame:
    """`docs` with the measures, base_failed, host_failed and kept, one row for each.

    The measured rows are written once; hosts are summed from them and the
    hosts that fall are joined back, by broadcast if a count shows them few and
    else by a shuffle join that AQE splits where a host is large. Null texts
    have no words and fail, texts of any length are measured whole; null hosts
    form one host; rows stay as they are repeated; columns named like the results
    are replaced; an empty table stays empty.
    """
    docs, back = shield(docs, WORK)
    columns = [c for c in docs.columns if c.lower() not in MADE and (keep_text or c != text_col)]
    measured = stage_table(measure(docs.select(*(c for c in docs.columns if c.lower() not in MADE)), text_col).select(*columns, *MEASURES, "base_failed"), "measured")
    fallen = host_verdicts(measured, host_col, limit=limit).filter("host_failed").select(F.col(host_col).alias("_host"), F.lit(True).alias("_fallen"))
    out = measured.join(checked_broadcast(fallen), F.col(host_col).eqNullSafe(F.col("_host")), "left")
    return out.select(*columns, *MEASURES, "base_failed", F.coalesce("_fallen", F.lit(False)).alias("host_failed")).withColumn("kept", ~(F.col("base_failed") | F.col("host_failed"))).withColumnsRenamed(back)


def drop_failed(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns; see quality_rules."""
    own, back = shield(docs, MADE)
    return quality_rules(own, text_col, host_col, limit=limit).filter("kept").select(*own.columns).withColumnsRenamed(back)
