"""Classification of statements as text: a corpus is a table (sql_id, db_id, sql), every test a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base score of a pattern, and what a tier adds.
BASE = {"0": 0.0, "1p": 1.0, "2p": 2.0, "3p": 3.0, "2i": 2.0, "3i": 3.0, "4i": 4.0, "Xm": 5.0}
EXTRA = {"E": 0.0, "M": 0.3, "H": 0.6}
PATTERNS, TIERS = ("0", "1p", "2p", "3p", "2i", "3i", "4i"), ("E", "M", "H")
SUGGEST = 3


def flat(sql: Column) -> Column:
    """One line, single spaces, quoted texts emptied."""
    return F.trim(F.regexp_replace(F.regexp_replace(sql, "'[^']*'", "''"), r"\s+", " "))


def plan_code(paths: Column, stars: Column, filters: Column) -> Column:
    """Class of a plan: `paths` is an array of arrays of tables from the target on, `stars` says that it is a star, `filters` counts predicates."""
    hops = F.array_max(F.transform(paths, lambda p: F.size(p) - 1))
    n = F.size(paths)
    pattern = (
        F.when((n == 0) | (hops == 0), "0").when(stars & (n > 4), "Xm").when(stars & (n >= 2), F.concat(n.cast("string"), F.lit("i")))
        .when((n == 1) & (hops <= 3), F.concat(hops.cast("string"), F.lit("p"))).otherwise("Xm")
    )
    return F.concat(pattern, F.when(filters <= 2, "E").when(filters <= 5, "M").otherwise("H"))


def split_code(code: Column) -> tuple[Column, Column]:
    """Pattern and tier letter of a class."""
    return F.regexp_extract(code, "^(.*)([EMH])$", 1), F.regexp_extract(code, "^(.*)([EMH])$", 2)


def score(code: Column) -> Column:
    """Difficulty of a class, -1 for an unknown one."""
    pattern, tier = split_code(code)
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    return F.coalesce(F.try_element_at(table(BASE), pattern) + F.try_element_at(table(EXTRA), tier), F.lit(-1.0))


def tier_name(value: Column) -> Column:
    return F.when(value < 0, "unknown").when(value < 1, "easy").when(value < 2, "medium").when(value < 3, "hard").otherwise("expert")


def exclusion(sql: Column) -> Column:
    """Why a statement lies outside the conjunctive fragment, null if it does not; the first reason that holds."""
    s = flat(sql)
    has = lambda p: s.rlike("(?i)" + p)
    return (
        F.when(~has(r"^\s*\(*\s*select\b"), "not_select").when(has(r"\b(count|sum|avg|min|max)\s*\("), "aggregate").when(has(r"\bhaving\b"), "having").when(has(r"\bgroup by\b"), "group_by")
        .when(has(r"\b(union|intersect|except)\b"), "set_op").when(has(r"\(\s*select\b"), "subquery").when(has(r"\bcross join\b"), "cross_join").when(has(r"\bor\b"), "or_condition")
    )


def where_body(sql: Column) -> Column:
    return _where(flat(sql))


def _where(flat: Column) -> Column:
    return F.regexp_extract(flat, r"(?i)\bwhere\b (.*?)(?= (?:group by|order by|having|limit|union|intersect|except)\b|;|$)", 1)


def condition_count(sql: Column) -> Column:
    """AND-connected conditions; a BETWEEN's own AND does not count."""
    body = F.regexp_replace(where_body(sql), r"(?i)\bbetween\b (\S+) and ", "between $1 to ")
    return F.when(body == "", 0).otherwise(F.regexp_count(body, F.lit(r"(?i)\band\b")) + 1)


def join_count(sql: Column) -> Column:
    return F.regexp_count(flat(sql), F.lit(r"(?i)\bjoin\b"))


def rough_pattern(joins: Column) -> Column:
    return F.when(joins == 0, "0").when(joins == 1, "1p").when(joins == 2, "2p_or_2i").when(joins == 3, "3p_or_3i").when(joins == 4, "4i_or_more").otherwise("Xm")


def tables_of(sql: Column) -> Column:
    """Tables after FROM and JOIN in order, lower-case, repeats kept."""
    return _tables(flat(sql))


def _tables(flat: Column) -> Column:
    return F.transform(F.regexp_extract_all(flat, F.lit(r"(?i)\b(?:from|join|update|into) ([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower)


def alias_pairs(sql: Column) -> Column:
    """"alias=table" for each FROM and JOIN entry with an alias, lower-case."""
    pattern = F.lit(r"(?i)\b(?:from|join) ([A-Za-z_][A-Za-z0-9_]*) as ([A-Za-z_][A-Za-z0-9_]*)")
    names, aliases = F.regexp_extract_all(flat(sql), pattern, F.lit(1)), F.regexp_extract_all(flat(sql), pattern, F.lit(2))
    return F.zip_with(aliases, names, lambda a, t: F.concat(F.lower(a), F.lit("="), F.lower(t)))


def predicates(sql: Column) -> Column:
    """"column op" of each condition, lower-case, in order; columns keep their alias."""
    return _predicates(where_body(sql))


def _predicates(body: Column) -> Column:
    pattern = F.lit(r"([A-Za-z_][A-Za-z0-9_.]*) ?(>=|<=|<>|!=|=|>|<|(?i:like)) ?")
    return F.zip_with(F.regexp_extract_all(body, pattern, F.lit(1)), F.regexp_extract_all(body, pattern, F.lit(2)), lambda c, o: F.concat(F.lower(c), F.lit(" "), F.lower(o)))


def select_columns(sql: Column) -> Column:
    body = F.regexp_extract(flat(sql), r"(?i)\bselect (?:distinct )?(.*?) from\b", 1)
    return F.array_remove(F.transform(F.split(F.lower(body), ","), lambda x: F.trim(x)), "")


def describe(statements: DataFrame) -> DataFrame:
    """`statements` with reason, in_scope, joins, conditions, pattern and tables."""
    s = F.col("sql")
    out = statements.withColumns({"reason": exclusion(s), "joins": join_count(s).cast("long"), "conditions": condition_count(s).cast("long"), "tables": tables_of(s)})
    return out.withColumns({"in_scope": F.col("reason").isNull(), "pattern": rough_pattern(F.col("joins"))})


def coverage(described: DataFrame, by: str | None = None) -> DataFrame:
    """Statements, those in the fragment and their share, by a column or over all."""
    return described.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_scope").cast("int")).alias("in_scope"), F.avg(F.col("in_scope").cast("double")).alias("share"))


def join_shape(described: DataFrame, edges: DataFrame, key: str = "sql_id") -> DataFrame:
    """(key, shape): class of the foreign-key subgraph that a statement's tables induce.

    With two or more children of one table it is a star of as many arms (over
    four: Xm); else a chain as long as its joins (over three: Xm). `edges` has child and parent tables.
    """
    used = described.select(key, "joins", F.explode(F.array_distinct("tables")).alias("t"))
    pair = used.withColumnRenamed("t", "child").join(edges, "child").join(used.select(key, F.col("t").alias("parent")), [key, "parent"])
    degree = pair.groupBy(key, "parent").agg(F.countDistinct("child").alias("d")).groupBy(key).agg(F.max("d").alias("d"))
    out = described.select(key, "joins").join(degree, key, "left")
    d, j = F.coalesce("d", F.lit(0)), F.col("joins")
    shape = F.when(j == 0, "0").when(d > 4, "Xm").when(d >= 2, F.concat(d.cast("string"), F.lit("i"))).when(F.col("d").isNull(), "unknown").when(j > 3, "Xm").otherwise(F.concat(j.cast("string"), F.lit("p")))
    return out.select(key, shape.alias("shape"))


def resolution(shapes: DataFrame) -> DataFrame:
    """How many shapes are known and how many not."""
    return shapes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("shape") == "unknown", 0).otherwise(1)).alias("precise"), F.sum(F.when(F.col("shape") == "unknown", 1).otherwise(0)).alias("unknown"))


def reasoning(pattern: Column, tables: Column, conditions: Column, columns: Column) -> Column:
    """A plan in words: topology, pattern, joins, predicates, columns."""
    return F.concat_ws(" | ", F.concat(F.lit("pattern "), pattern), F.concat(F.lit("tables "), F.array_join(tables, " -> ")), F.concat(F.lit("predicates "), conditions.cast("string")), F.concat(F.lit("select "), F.array_join(columns, ", ")))


def failure_category(gold: Column, pred: Column) -> Column:
    """First of: join_path, missing_predicate, extra_predicate, operator, value, other."""
    x, y = ({"tables": F.array_sort(tables_of(s)), "predicates": predicates(s), "values": flat_values(s)} for s in (gold, pred))
    return _category(*((lambda k, d=d: d[k] if k in d else _OF_PREDICATES[k](d["predicates"])) for d in (x, y)))


#: Sorted columns of predicates, and predicates without their aliases, sorted.
_OF_PREDICATES = {
    "columns": lambda x: F.array_sort(F.transform(x, lambda p: F.regexp_extract(p, r"^(?:\w+\.)?(\w+) ", 1))),
    "bare": lambda x: F.array_sort(F.transform(x, lambda p: F.regexp_replace(p, r"^\w+\.", ""))),
}


def _category(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """failure_category from what is taken of the gold and the predicted statement, by name."""
    gt, pt, gp, pp = x("tables"), y("tables"), x("predicates"), y("predicates")
    return (
        F.when((F.size(pt) == 0) | (F.size(gt) == 0), "other").when(gt != pt, "join_path").when(F.size(pp) < F.size(gp), "missing_predicate").when(F.size(pp) > F.size(gp), "extra_predicate")
        .when(x("columns") != y("columns"), "other").when(x("bare") != y("bare"), "operator").when(x("values") != y("values"), "value").otherwise("other")
    )


def failures(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """`pairs` with category, as failure_category; what it reads of a statement is taken once, column after column."""
    sides = (gold, pred)
    name = lambda side, part: f"_{sides.index(side)}_{part}"
    out = pairs.withColumns({name(s, "flat"): flat(F.col(s)) for s in sides} | {name(s, "values"): flat_values(F.col(s)) for s in sides})
    out = out.withColumns({name(s, "tables"): F.array_sort(_tables(F.col(name(s, "flat")))) for s in sides} | {name(s, "body"): _where(F.col(name(s, "flat"))) for s in sides})
    out = out.withColumns({name(s, "predicates"): _predicates(F.col(name(s, "body"))) for s in sides})
    out = out.withColumns({name(s, k): f(F.col(name(s, "predicates"))) for s in sides for k, f in _OF_PREDICATES.items()})
    x, y = (lambda part, s=s: F.col(name(s, part)) for s in sides)
    return out.select(*(F.col(f"`{c}`") for c in pairs.columns), _category(x, y).alias("category"))


def flat_values(sql: Column) -> Column:
    """Literals of the condition in order of text."""
    return F.array_sort(F.regexp_extract_all(F.regexp_replace(sql, r"\s+", " "), F.lit(r"(?:>=|<=|<>|!=|=|>|<) ?('[^']*'|\d+(?:\.\d+)?)"), F.lit(1)))


def complexity(sql: Column) -> Column:
    n = F.size(F.array_distinct(tables_of(sql)))
    rich = flat(sql).rlike(r"(?i)\b(group by|having|union|intersect|except)\b|\(\s*select\b|\b(count|sum|avg|min|max)\s*\(")
    return F.when((n >= 3) | (rich & (n >= 2)), "complex").when((n == 2) | rich, "medium").otherwise("simple")


def decompose(sql: Column, depth: int = 5) -> Column:
    """Flags and counts of an aggregate statement with its parentheses emptied level by level."""
    out = flat(sql)
    for _ in range(depth):
        out = F.regexp_replace(out, r"\([^()]*\)", "")
    return F.struct(
        F.regexp_count(out, F.lit(r"(?i)\bjoin\b|,(?= ?[a-z_]+ as )")).cast("long").alias("joins"), flat(sql).rlike(r"(?i)\(\s*select\b").alias("subquery"),
        out.rlike(r"(?i)\bor\b").alias("has_or"), flat(sql).rlike(r"(?i)\b(count|sum|avg|min|max)\s*\(").alias("aggregate"),
        out.rlike(r"(?i)\bgroup by\b").alias("group_by"), condition_count(out).cast("long").alias("conditions"),
    )


def unknown_identifiers(statements: DataFrame, columns: DataFrame, key: str = "sql_id") -> DataFrame:
    """(key, name, suggestion): tables that the catalog lacks, with a known table that begins alike."""
    names = statements.select(key, F.explode(F.array_distinct(tables_of(F.col("sql")))).alias("name"))
    known = columns.select(F.lower("table").alias("t")).distinct()
    lost = names.join(known, names["name"] == known["t"], "left_anti")
    near = lost.join(known, F.substring("name", 1, SUGGEST) == F.substring("t", 1, SUGGEST), "left")
    return near.groupBy(key, "name").agg(F.min("t").alias("suggestion"))


def clean_reply(text: Column) -> Column:
    """The statement in a model's reply: fenced block, else from SELECT or WITH on; trailing semicolons gone, parentheses closed."""
    fenced = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?is)\b((?:select|with)\b.*)$", 1)
    body = F.trim(F.regexp_replace(F.when(fenced != "", fenced).otherwise(bare), r"[;\s]+$", ""))
    missing = F.regexp_count(body, F.lit(r"\(")) - F.regexp_count(body, F.lit(r"\)"))
    return F.concat(body, F.repeat(F.lit(")"), F.greatest(F.lit(0), missing)))


def ensure_id(sql: Column, id_col: str) -> Column:
    """The statement with the id column in front of its SELECT list, if it is not in it."""
    there = F.exists(select_columns(sql), lambda c: (c == id_col) | c.endswith(f".{id_col}") | (c == "*"))
    return F.when(there, sql).otherwise(F.regexp_replace(sql, r"(?i)^\s*select (distinct )?", f"SELECT $1{id_col}, "))


def lower_identifiers(sql: Column) -> Column:
    """Lower case outside quoted texts."""
    parts = F.split(sql, "'")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(x)), "'")
