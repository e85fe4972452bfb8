"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = 2147483647


def mix_sql(key: str, seed: int | str = 0, rep: int | str = 0) -> str:
    """A pseudo-random integer in 0..PRIME-1 of an integer key, as text that Spark SQL and other engines read alike."""
    h1 = f"((CAST({key} AS BIGINT) * 48271 + CAST({seed} AS BIGINT) * 16807 + 1) % {PRIME})"
    h2 = f"(({h1} * {h1} + CAST({rep} AS BIGINT) * 69621) % {PRIME})"
    return f"(({h2} * {h2} + {h1}) % {PRIME})"


def mix(key: Column | str, seed: Column | int = 0, rep: Column | int = 0) -> Column:
    """mix_sql as a column."""
    lift = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    h1 = (key * 48271 + lift(seed) * 16807 + 1) % PRIME
    h2 = (h1 * h1 + lift(rep) * 69621) % PRIME
    return (h2 * h2 + h1) % PRIME


def text_number(key: Column) -> Column:
    """An integer in 0..PRIME-1 of a text: fifteen hex digits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % PRIME


def text_number_sql(key: str) -> str:
    """text_number in DuckDB's SQL."""
    return f"(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % {PRIME})"


def key_number(df: DataFrame, name: str) -> Column:
    """The column `name` of `df` as what mix takes: an integer as it is, everything else by its text (null stays null)."""
    kind = df.schema[name].dataType
    return F.col(f"`{name}`") if isinstance(kind, T.IntegralType) else text_number(F.col(f"`{name}`").cast("string"))


def exclusive_quantile(ordered: Column, percent: int, least: int) -> Column:
    """Quantile at percent of a sorted array by exclusive interpolation; its largest value below `least` values."""
    n = F.size(ordered)
    spot = (n + 1) * F.lit(percent)
    low = F.greatest(F.lit(1), F.least(F.floor(spot / 100).cast("int"), n - 1))
    part = spot - low * 100
    inner = (F.get(ordered, low - 1) * (100 - part) + F.get(ordered, low) * part) / 100
    return F.when(n >= least, inner).otherwise(F.get(ordered, n - 1))


def floor_quantile(ordered: Column, percent: int) -> Column:
    """Value of a sorted array at index floor(n * percent / 100), the last one at most."""
    n = F.size(ordered)
    return F.get(ordered, F.least(F.floor(n * F.lit(percent) / 100).cast("int"), n - 1))


def sql_uid(sql: Column) -> Column:
    """Identifier of a statement: sixteen hex digits of its SHA-256."""
    return F.substring(F.sha2(sql, 256), 1, 16)


def name_seed(seed: int, name: Column) -> Column:
    """Seed of a named part: CRC-32 of "seed:name", in 31 bits."""
    return F.crc32(F.concat(F.lit(f"{seed}:"), name)).bitwiseAND(F.lit(0x7FFFFFFF))


def normal_id(value: Column) -> Column:
    """An identifier as text: an integral number as a long, another number rounded half-even to six places, other text trimmed."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
    shape = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(shape & whole, number.cast("long").cast("string")).when(shape & number.isNotNull(), F.bround(number, 6).cast("string")).otherwise(text)


def epoch_date(value: Column) -> Column:
    """`/Date(ms)/` as yyyy-MM-dd in UTC; other values as they are."""
    ms = F.regexp_extract(value, r"^/Date\((-?\d+)", 1)
    return F.when(ms != "", F.date_format(F.timestamp_millis(ms.try_cast("long")), "yyyy-MM-dd")).otherwise(value)


def tokens(text: Column, pattern: str = "[a-z0-9_]+") -> Column:
    """Lower-case tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def normal_question(text: Column) -> Column:
    """Lower case, single spaces, no question mark at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"\?+$", ""))


def normal_sql(sql: Column) -> Column:
    """Lower case, single spaces, no semicolon at the end, AND terms of the condition in order."""
    return ordered_terms(flat_sql(sql))


def flat_sql(sql: Column) -> Column:
    """Lower case, single spaces, no semicolon at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sql), r"\s+", " "), r"[ ;]+$", ""))


def ordered_terms(flat: Column) -> Column:
    """A flat statement with the AND terms of its condition in order."""
    head, body = F.regexp_extract(flat, r"^(.*?) where (.*)$", 1), F.regexp_extract(flat, r"^(.*?) where (.*)$", 2)
    return F.when(body == "", flat).otherwise(F.concat(head, F.lit(" where "), F.array_join(F.array_sort(F.split(body, " and ")), " and ")))


def highlight(text: Column, term: Column, around: int = 40) -> Column:
    """The text within `around` characters of the first hit, with dots where it is cut; the first 2 * around characters without a hit."""
    at = F.position(F.lower(term), F.lower(text))
    low = F.greatest(F.lit(1), at - around)
    high = at + F.char_length(term) + around
    cut = F.substring(text, low, high - low)
    return F.when(at > 0, F.concat(F.when(low > 1, "...").otherwise(""), cut, F.when(high <= F.char_length(text), "...").otherwise(""))).otherwise(F.substring(text, 1, 2 * around))


def phrases(words: Column, sizes: tuple[int, ...] = (4, 3, 2), most: int = 8) -> Column:
    """Runs of words joined by spaces, longer runs first, `most` of them."""
    return F.slice(F.array_distinct(F.concat(*(runs(words, k) for k in sizes))), 1, most)


def runs(words: Column, size: int) -> Column:
    """All runs of `size` words, joined by spaces, in order."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def stem_aliases(word: Column) -> Column:
    """A word with its plural and singular by plain English rules, distinct."""
    singular = F.when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|us|is)$"), word).when(word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)
    plural = F.when(singular.rlike("[^aeiou]y$"), F.regexp_replace(singular, "y$", "ies")).when(singular.rlike("(s|x|ch|sh)$"), F.concat(singular, F.lit("es"))).otherwise(F.concat(singular, F.lit("s")))
    return F.array_distinct(F.array(word, singular, plural))


def camel_words(name: Column) -> Column:
    """Words of a camel-case or snake-case name, lower-case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\s]+", " ")
    return F.split(F.lower(F.trim(spaced)), " ")


def redact(params: Column) -> Column:
    """A map of parameters with secret values starred out."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).rlike("token|password|secret|authorization"), F.lit("***")).otherwise(v))


def entropy(counts: Column, classes: Column) -> Column:
    """Normalised entropy of an array of counts over `classes` classes: null without counts, 1.0 for one class at most."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(F.transform(F.filter(counts, lambda x: x > 0), lambda x: -(x / total) * F.log(x / total)), F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, F.lit(None)).when(classes <= 1, F.lit(1.0)).otherwise(bits / F.log(classes.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0.0 if one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
