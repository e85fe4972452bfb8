"""Schema profiling and key discovery over named tables.

A table set is a dict of DataFrames. Profiles come from one aggregate per
table over all its columns, and exact counts of the columns that this leaves
open; what goes to the driver is one row per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skemara.sources.scratch import stored

Tables = dict[str, DataFrame]
PROFILE = "table string, column string, ordinal int, dtype string, n long, n_set long, n_distinct long, mean_len double, newline boolean, date_share double, comma_share double, token_len double, low double, high double, boolean_like boolean, samples array<string>"
BOOLEANS = ("t", "f", "true", "false", "y", "n", "yes", "no", "0", "1")
FILTERABLE = ("NUMERIC", "YEAR", "DATE", "ENUM", "BOOLEAN", "COMMA_SEPARATED", "LABEL")
#: A declared key's coverage by its parent's values, for a rule to hold.
COVERAGE = 0.9


@dataclass
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    coverage: float = 1.0
    #: A composite key's or a role's name; a key without one is called by its table and first column.
    name: str | None = None

    @property
    def key(self) -> str:
        return self.name or f"{self.child}.{self.columns[0]}"


@dataclass
class Schema:
    """Keys of a table set, and its target table."""

    target: str
    primary: dict[str, str | None] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)


def pinned(catalog: DataFrame) -> DataFrame:
    """A catalog table (a row per column or key, never per data row) held on the driver, so that what reads it does not profile again."""
    return catalog.sparkSession.createDataFrame(catalog.collect(), catalog.schema)


def lower_names(tables: Tables) -> Tables:
    """All table and column names in lower case."""
    return {name.lower(): df.toDF(*[c.lower() for c in df.columns]) for name, df in tables.items()}


def _plain(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


#: Columns of texts with up to FEW values by the sketch, and columns that have NEAR as many as rows, are counted exactly.
FEW, NEAR, ERROR = 64, 0.85, 0.02

_DAY = "^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
#: What the pass over a table keeps of each column, by kind of column: {c} is the column, {v} its text.
_OF_ALL = {"n": "count(1)", "n_set": "count({c})"}
_OF_PLAIN = {"n_distinct": f"approx_count_distinct({{c}}, {ERROR})"}
_OF_TEXTS = {
    "newline": "coalesce(bool_or(contains({v}, chr(10))), false)",
    "date_share": f"coalesce(avg(CAST({{v}} RLIKE '{_DAY}' AS DOUBLE)), 0D)", "comma_share": "coalesce(avg(CAST(contains({v}, ',') AS DOUBLE)), 0D)",
    "token_len": "avg(CASE WHEN contains({v}, ',') THEN char_length(replace({v}, ',', '')) / size(split({v}, ',')) END)",
    "boolean_like": f"coalesce(bool_and(lower({{v}}) IN ({', '.join(map(repr, BOOLEANS))})), false)",
}
_OF_REST = {"mean_len": "avg(char_length({v}))", "least": "min({v})", "most": "max({v})"}
_OF_NUMBERS = {"low": "min(CAST({c} AS DOUBLE))", "high": "max(CAST({c} AS DOUBLE))"}
_OF_WHOLE = {"least": "CAST(CAST(min({c}) AS BIGINT) AS STRING)", "most": "CAST(CAST(max({c}) AS BIGINT) AS STRING)"}
_BY_KIND = {0: _OF_PLAIN | _OF_TEXTS | _OF_REST, 1: _OF_PLAIN | _OF_NUMBERS | _OF_WHOLE, 2: _OF_PLAIN | _OF_NUMBERS, 3: _OF_PLAIN | _OF_REST, 4: {}}
_NONE = {"n": "0L", "n_set": "0L", "n_distinct": "0L", "mean_len": "CAST(NULL AS DOUBLE)", "newline": "false", "date_share": "0D", "comma_share": "0D", "token_len": "CAST(NULL AS DOUBLE)", "boolean_like": "false", "low": "CAST(NULL AS DOUBLE)", "high": "CAST(NULL AS DOUBLE)", "least": "CAST(NULL AS STRING)", "most": "CAST(NULL AS STRING)"}
_LONG = {"n", "n_set", "n_distinct"}
#: Columns of one aggregate; wider tables take several, each of which reads its own columns.
WIDE = 16


def _kind(t: T.DataType) -> int:
    """0 for texts, 1 for whole numbers, 2 for other numbers, 3 for the rest, 4 for nested values, of which only null or not is told."""
    return 4 if not _plain(t) else 0 if isinstance(t, T.StringType) else 1 if isinstance(t, T.IntegralType) else 2 if isinstance(t, T.NumericType) else 3


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(name: str, kind: int) -> str:
    return _quoted(name) if kind == 0 else f"CAST({_quoted(name)} AS STRING)"


def _measured(frames: list[DataFrame]) -> list:
    """A row per column of all tables with what _BY_KIND keeps: aggregates without grouping, so that a row per task is shuffled."""
    parts = []
    for number, df in enumerate(frames):
        fields = list(enumerate(df.schema.fields))
        for low in range(0, len(fields), WIDE):
            rows = []
            for i, f in fields[low : low + WIDE]:
                kind = _kind(f.dataType)
                made = {k: x.format(c=_quoted(f.name), v=_text(f.name, kind)) for k, x in (_OF_ALL | _BY_KIND[kind]).items()}
                cells = ", ".join(f"'{k}', " + (f"CAST({made[k]} AS BIGINT)" if k in made and k in _LONG else made.get(k, none)) for k, none in _NONE.items())
                rows.append(f"named_struct('t', {number}, 'ordinal', {i}, {cells})")
            if rows:
                parts.append(df.agg(F.expr(f"array({', '.join(rows)})").alias("x")).select(F.inline("x")))
    return reduce(lambda a, b: a.unionByName(b), parts).collect() if parts else []


def _per_column(frames: list[DataFrame], chosen: list[tuple[int, int]], value) -> dict[tuple[int, int], object]:
    """`value(name, kind, (t, ordinal))`, an aggregate cast to text, of each chosen column: one job for all."""
    by: dict[int, list[int]] = {}
    for t, i in chosen:
        by.setdefault(t, []).append(i)
    parts = []
    for t, columns in by.items():
        for low in range(0, len(columns), WIDE):
            part = columns[low : low + WIDE]
            rows = [f"named_struct('t', {t}, 'ordinal', {i}, 'x', {value(frames[t].schema.fields[i].name, _kind(frames[t].schema.fields[i].dataType), (t, i))})" for i in part]
            parts.append(frames[t].agg(F.expr(f"array({', '.join(rows)})").alias("x")).select(F.inline("x")))
    return {(r.t, r.ordinal): r.x for r in reduce(lambda a, b: a.unionByName(b), parts).collect()} if parts else {}


def _distinct(frames: list[DataFrame], chosen: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Exact numbers of distinct values of the chosen columns, values of their own type shuffled, column by column in one job."""
    parts = []
    for t, i in chosen:
        name = _quoted(frames[t].schema.fields[i].name)
        values = frames[t].select(F.expr(name).alias("v")).filter("v IS NOT NULL").distinct()
        parts.append(values.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), F.lit(i).alias("ordinal"), "n"))
    return {(r.t, r.ordinal): r.n for r in reduce(lambda a, b: a.unionByName(b), parts).collect()} if parts else {}


def _over(name: str, kind: int, least: str) -> str:
    """The least value of a column above `least`, both as text."""
    c, v = _quoted(name), _text(name, kind)
    literal = "'" + least.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if kind == 1:
        return f"CAST(CAST(min(CASE WHEN {c} > {least}L THEN {c} END) AS BIGINT) AS STRING)"
    if kind == 2:
        return f"CAST(min(CASE WHEN CAST({c} AS DOUBLE) > CAST({literal} AS DOUBLE) THEN CAST({c} AS DOUBLE) END) AS STRING)"
    return f"min(CASE WHEN {v} > {literal} THEN {v} END)"


def profile(spark: SparkSession, tables: Tables, samples: bool = False) -> DataFrame:
    """One row per column: type, counts, what the typing rules need, and up to three distinct samples (with `samples` the three least, else the ends).

    Each table is read once by an aggregate over all its columns that shuffles a
    row per task. Its sketches tell which texts have few values and which
    columns may be keys; the values of those alone are then counted exactly.
    For other columns n_distinct is the sketch's estimate (within about ERROR),
    which no rule depends on. The second and third sample are a further
    aggregate each. What is returned is a catalog, a row per column.
    """
    names, frames = list(tables), list(tables.values())
    found = {(i, j): {"table": names[i], "column": f.name, "ordinal": j, "dtype": f.dataType.simpleString(), "kind": _kind(f.dataType)} for i, df in enumerate(frames) for j, f in enumerate(df.schema.fields)}
    for r in _measured(frames):
        found[r.t, r.ordinal] |= {k: r[k] for k in _NONE}
    exact = []
    for at, r in found.items():
        r["n_distinct"] = min(r["n_distinct"], r["n_set"])
        if r["kind"] == 2:
            r["least"], r["most"] = (None if x is None else str(x) for x in (r["low"], r["high"]))
        key = r["n_set"] == r["n"] and r["n_distinct"] >= NEAR * r["n"] and r["kind"] != 2
        if r["least"] is not None and (key or r["kind"] == 0 and r["n_distinct"] <= FEW):
            exact.append(at)
    for at, n in _distinct(frames, exact).items():
        found[at]["n_distinct"] = n
    shown = {at: [r["least"]] for at, r in found.items() if r["least"] is not None}
    for _ in range(2 if samples else 0):
        more = [at for at, seen in shown.items() if seen[-1] != found[at]["most"]]
        for at, x in _per_column(frames, more, lambda name, kind, at: _over(name, kind, shown[at][-1])).items():
            if x is not None:
                shown[at].append(x)
    for at, r in found.items():
        r["samples"] = list(dict.fromkeys(shown.get(at, []) + ([] if samples or r["most"] is None else [r["most"]])))
    columns = T._parse_datatype_string(PROFILE).fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in columns) for r in found.values()], PROFILE)


def semantic_type(year_names: str = "year|yr|date") -> Column:
    """Semantic type of a profile row; the first rule that holds."""
    dtype, c = F.col("dtype"), F.col
    number = dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    whole = dtype.rlike("^(tinyint|smallint|int|bigint)")
    return (
        F.when(dtype == "boolean", "BOOLEAN").when(whole & (c("low") >= 1800) & (c("high") <= 2100) & F.lower("column").rlike(year_names), "YEAR").when(number, "NUMERIC")
        .when(dtype.rlike("^(date|timestamp)"), "DATE").when(dtype != "string", "TEXT").when(c("n_set") == 0, "TEXT")
        .when(c("boolean_like") & (c("n_distinct") <= 2), "BOOLEAN").when(c("date_share") >= 0.9, "DATE")
        .when((c("comma_share") >= 0.5) & (c("token_len") <= 60) & ~c("newline") & (c("mean_len") <= 200), "COMMA_SEPARATED")
        .when((c("n_distinct") <= 20) & (c("mean_len") <= 50), "ENUM").when((c("mean_len") <= 50) & ~c("newline"), "LABEL").otherwise("TEXT")
    )


def typed(profiles: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """`profiles` with semantic; valid overrides (table, column, semantic) win."""
    out = profiles.withColumn("semantic", semantic_type())
    if overrides is None:
        return out
    valid = overrides.filter(F.col("semantic").isin(*FILTERABLE, "TEXT", "IDENTIFIER")).select("table", "column", F.col("semantic").alias("_o"))
    return out.join(valid, ["table", "column"], "left").withColumn("semantic", F.coalesce("_o", "semantic")).drop("_o")


def primary_keys(types: DataFrame) -> DataFrame:
    """(table, primary_key): a unique column without nulls, first `id`, then one named like a key of the table, then another; no free text, null if there is none."""
    name, table = F.lower("column"), F.lower("table")
    unique = (F.col("n") > 0) & (F.col("n_set") == F.col("n")) & (F.col("n_distinct") == F.col("n"))
    keyish = name.rlike("(^|_)id$|key$")
    order = F.struct(F.when(name == "id", 0).when(keyish & unique, 1).otherwise(2), F.when(name.contains(F.substring(table, 1, 3)), 0).otherwise(1), "ordinal")
    good = unique & ~F.col("semantic").isin("TEXT", "DATE") & ~((F.col("semantic") == "NUMERIC") & ~F.col("dtype").rlike("int$"))
    return types.groupBy("table").agg(F.min_by(F.when(good, F.col("column")), F.when(good, order)).alias("primary_key"))


def stems(column: Column) -> Column:
    """What a key's name may stand for: it without its ending, and without the table's own prefix of one or two letters too. l_orderkey gives l_order and order, ad_id gives ad."""
    bare = F.regexp_replace(F.lower(column), "_?(id|key|fk)$", "")
    return F.filter(F.array_distinct(F.array(bare, F.regexp_replace(bare, "^[a-z]{1,2}_", ""))), lambda s: s != "")


Pair = tuple[str, str, str, str]
#: Values of a column's sketch, about, and how many standard errors below COVERAGE a sketch must be for a pair to be ruled out: fewer than one in a million keys is lost.
SKETCH, SIGMAS = 2048, 5.0


def _whole(tables: Tables, pairs: list[Pair]) -> bool:
    return all(isinstance(tables[t].schema[c].dataType, T.IntegralType) for a, b, c_, d in pairs for t, c in ((a, b), (c_, d)))


def sketches(tables: Tables, columns: list[tuple[str, str]], size: int = SKETCH, counts: dict[tuple[str, str], int] | None = None) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """(table, column, h): hashes of a column's distinct values below a bound, and the bounds as shares of the hash's range.

    The bound keeps about `size` values by an estimate of the column's distinct
    values; hashes agree over all columns, so what two columns keep below the
    lower of their bounds is the same sample of their values. Only what is kept
    is shuffled. `counts` has estimates that are known.
    """
    frames = {t: tables[t] for t, _ in columns}
    at = {t: k for k, t in enumerate(frames)}
    known = dict(counts or {})
    more = {c: (at[c[0]], frames[c[0]].schema.fieldNames().index(c[1])) for c in columns if c not in known}
    found = _per_column(list(frames.values()), list(more.values()), lambda name, kind, _: f"approx_count_distinct({_quoted(name)}, 0.05)")
    known |= {c: found[w] for c, w in more.items()}
    share = {c: min(1.0, size / max(1, known[c])) for c in columns}
    # Whole numbers are hashed as such if all columns are.
    kind = "bigint" if all(isinstance(frames[t].schema[c].dataType, T.IntegralType) for t, c in columns) else "string"
    # An unsigned share of the hash's upper 31 bits.
    h = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(f"`{c}`").cast(kind)), 33)
    parts = [frames[t].filter(F.col(f"`{c}`").isNotNull()).select(F.lit(t).alias("table"), F.lit(c).alias("column"), h(c).alias("h")).filter(F.col("h") < int(share[t, c] * (1 << 31))) for t, c in columns]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct(), share


def plausible(tables: Tables, pairs: list[Pair], least: float = COVERAGE, size: int = SKETCH, counts: dict[tuple[str, str], int] | None = None) -> list[Pair]:
    """The pairs that their sketches do not rule out: with m sampled child values of which a share p is among the parent's, p must reach
    `least` less SIGMAS standard errors. Pairs with no sampled value stay."""
    if not pairs:
        return []
    columns = sorted({(a, b) for a, b, _, _ in pairs} | {(c, d) for _, _, c, d in pairs})
    found, share = sketches(tables, columns, size, counts)
    spark = found.sparkSession
    held = stored(found, "sketches")
    rows = [(k, a, b, c, d, int(min(share[a, b], share[c, d]) * (1 << 31))) for k, (a, b, c, d) in enumerate(pairs)]
    catalog = spark.createDataFrame(rows, "pair int, a string, b string, c string, d string, upto long")
    # The catalog of pairs has a row per pair of columns, sketches a bounded number per column.
    child = held.join(F.broadcast(catalog), (F.col("table") == F.col("a")) & (F.col("column") == F.col("b")) & (F.col("h") < F.col("upto"))).select("pair", F.col("c").alias("pt"), F.col("d").alias("pc"), "h")
    parent = held.select(F.col("table").alias("pt"), F.col("column").alias("pc"), "h", F.lit(1).alias("hit"))
    seen = child.join(parent, ["pt", "pc", "h"], "left").groupBy("pair").agg(F.count(F.lit(1)).alias("m"), F.count("hit").alias("hits")).collect()
    out = {r.pair for r in seen if r.hits / r.m < least - SIGMAS * (least * (1 - least) / r.m) ** 0.5}
    return [p for k, p in enumerate(pairs) if k not in out]


#: Columns whose values meet in one pass, a bit each.
BITS = 62


def _packed(pairs: list[Pair]) -> list[list[Pair]]:
    """The pairs in lots of at most BITS columns."""
    lots: list[tuple[set, list[Pair]]] = []
    for p in pairs:
        ends = {p[:2], p[2:]}
        for columns, held in lots:
            if len(columns | ends) <= BITS:
                columns |= ends
                held.append(p)
                break
        else:
            lots.append((ends, [p]))
    return [held for _, held in lots]


def overlap_pairs(tables: Tables, pairs: list[Pair]) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, coverage, child_distinct, parent_distinct) for the given pairs with a value in common.

    Each column has a bit, and each value the bits of the columns that have it:
    one aggregate by value over all columns, whose distinct sets of bits, with
    how many values have them, tell all counts. Whole numbers meet as such, the
    others as text.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for whole in (True, False):
        for some in _packed([p for p in pairs if _whole(tables, [p]) == whole]):
            columns = sorted({p[:2] for p in some} | {p[2:] for p in some})
            bit = {c: 1 << k for k, c in enumerate(columns)}
            kind = "bigint" if whole else "string"
            each = [tables[t].select(F.col(f"`{c}`").cast(kind).alias("value"), F.lit(bit[t, c]).cast("long").alias("bits")).filter("value IS NOT NULL") for t, c in columns]
            values = reduce(lambda a, b: a.unionByName(b), each).groupBy("value").agg(F.bit_or("bits").alias("bits"))
            held = values.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
            catalog = spark.createDataFrame([(*p, bit[p[:2]], bit[p[2:]]) for p in some], "child_table string, child_column string, parent_table string, parent_column string, _c long, _p long")
            has = lambda b: F.col("bits").bitwiseAND(F.col(b)) != 0
            count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
            sums = held.crossJoin(F.broadcast(catalog)).groupBy("child_table", "child_column", "parent_table", "parent_column").agg(count(has("_c") & has("_p")).alias("h"), count(has("_c")).alias("child_distinct"), count(has("_p")).alias("parent_distinct"))
            parts.append(sums.filter("h > 0").select("child_table", "child_column", "parent_table", "parent_column", (F.col("h") / F.col("child_distinct")).alias("coverage"), "child_distinct", "parent_distinct"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def overlap(tables: Tables, children: list[tuple[str, str]], parents: list[tuple[str, str]]) -> DataFrame:
    """overlap_pairs of every child column with every other parent column."""
    return overlap_pairs(tables, [(*c, *p) for c in children for p in parents if c != p])


def coverage(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: the share of a child column's distinct values that the parent has; 0.0 without values."""
    c = child.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
    p = parent.select(F.col(parent_column).alias("v")).distinct().withColumn("hit", F.lit(1))
    return c.join(p, "v", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("coverage"))


def candidate_parents(types: DataFrame, keys: DataFrame) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, priority): key columns that a stem of a primary key or the name of its table agrees with, in singular, plural or prefix.

    Names that agree begin with the same letter, so the catalog is joined by equality; stems of any length count.
    """
    col = types.filter(F.lower("column").rlike("(id|key|fk)$")).select(F.col("table").alias("child_table"), F.col("column").alias("child_column"), F.explode(stems(F.col("column"))).alias("s"))
    pk = keys.filter("primary_key IS NOT NULL").select(F.col("table").alias("parent_table"), F.col("primary_key").alias("parent_column"))
    pk = pk.withColumn("name", F.explode(F.array_distinct(F.concat(stems(F.col("parent_column")), F.array(F.lower("parent_table"))))))
    met = col.join(pk, F.substring("s", 1, 1) == F.substring("name", 1, 1)).filter((F.col("child_table") != F.col("parent_table")) | (F.col("child_column") != F.col("parent_column")))
    s, n = F.col("s"), F.col("name")
    priority = F.when(s == n, 0).when(F.concat(s, F.lit("s")) == n, 1).when(n.startswith(s) | (s.startswith(n) & (F.char_length(n) >= 3)), 2)
    return met.withColumn("priority", priority).filter("priority IS NOT NULL").groupBy("child_table", "child_column", "parent_table", "parent_column").agg(F.min("priority").alias("priority"))


def resolve(found: DataFrame, target: str) -> DataFrame:
    """One parent per child column: the target first, then coverage, then name."""
    order = Window.partitionBy("child_table", "child_column").orderBy(F.when(F.col("parent_table") == target, 0).otherwise(1), F.col("priority"), F.desc("coverage"), "parent_table")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def discover(tables: Tables, types: DataFrame, keys: DataFrame, target: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Foreign keys: external verdicts if there are any, else name rules confirmed by coverage, one parent per column."""
    if verdicts is not None and verdicts.limit(1).count():
        return verdicts
    named = candidate_parents(types, keys).collect()  # a row per key column of the catalog and candidate
    if not named:
        return overlap_empty(types.sparkSession)
    # Sketches rule out most of what names alone suggest; only the rest is counted exactly.
    pairs = sorted((r.child_table, r.child_column, r.parent_table, r.parent_column) for r in named)
    profiled = {(r.table, r.column): r.n_distinct for r in types.select("table", "column", "n_distinct").collect()} if "n_distinct" in types.columns else {}
    pairs = plausible(tables, pairs, counts=profiled)
    if not pairs:
        return overlap_empty(types.sparkSession)
    found = overlap_pairs(tables, pairs)
    rules = types.sparkSession.createDataFrame([tuple(r) for r in named], "child_table string, child_column string, parent_table string, parent_column string, priority int")
    keyed = found.join(F.broadcast(rules), ["child_table", "child_column", "parent_table", "parent_column"]).filter(F.col("coverage") >= COVERAGE)
    own = keys.select(F.col("table").alias("child_table"), F.col("primary_key").alias("child_column"))
    # A table's own key is a child only where the names agree with another table's.
    keyed = keyed.join(own.withColumn("_pk", F.lit(True)), ["child_table", "child_column"], "left").filter("_pk IS NULL OR priority = 0").filter("_pk IS NULL OR child_distinct < parent_distinct").drop("_pk")
    return resolve(keyed, target).select("child_table", "child_column", "parent_table", "parent_column", "coverage")


def overlap_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, coverage double")


def issues(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(severity, message): missing tables and columns, weak coverage, isolated tables."""
    known = columns.select(F.col("table"), F.col("column")).distinct()
    ends = fks.select(F.col("child_table").alias("table"), F.col("child_column").alias("column")).unionByName(fks.select(F.col("parent_table").alias("table"), F.col("parent_column").alias("column"))).distinct()
    missing = ends.join(known, ["table", "column"], "left_anti").select(F.lit("error").alias("severity"), F.concat_ws(" ", F.lit("missing column"), F.concat_ws(".", "table", "column")).alias("message"))
    weak = fks.filter("coverage < 0.9").select(F.when(F.col("coverage") < 0.5, "error").otherwise("warning").alias("severity"), F.concat_ws(" ", F.lit("low coverage of"), F.concat_ws(".", "child_table", "child_column")).alias("message"))
    tables = known.select("table").distinct()
    alone = tables.join(ends.select("table").distinct(), "table", "left_anti")
    count = alone.agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.lit("warning").alias("severity"), F.concat_ws(" ", F.col("c").cast("string"), F.lit("isolated tables")).alias("message"))
    return missing.unionByName(weak).unionByName(count)


def related(fks: DataFrame, table: str) -> DataFrame:
    """(table, direction) of the tables that share a key with one."""
    out = fks.filter(F.col("child_table") == table).select(F.col("parent_table").alias("table"), F.lit("outgoing").alias("direction"))
    back = fks.filter(F.col("parent_table") == table).select(F.col("child_table").alias("table"), F.lit("incoming").alias("direction"))
    return out.unionByName(back).distinct()


def filterable(types: DataFrame, keys: DataFrame, fks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Columns that predicates may use: of a filterable type, no key, not named id or *_id, not excluded."""
    out = types.filter(F.col("semantic").isin(*FILTERABLE) & ~F.lower("column").rlike("(^|_)id$"))
    banned = keys.select("table", F.col("primary_key").alias("column")).unionByName(fks.select(F.col("child_table").alias("table"), F.col("child_column").alias("column")))
    banned = banned.unionByName(excluded.select("table", "column")) if excluded is not None else banned
    return out.join(banned.filter("column IS NOT NULL").distinct(), ["table", "column"], "left_anti")


def roles(types: DataFrame) -> DataFrame:
    """(table, column, role) for search: id, name, keyword, date, status or other, by name."""
    n = F.lower("column")
    role = F.when(n.rlike("(^|_)id$|key$|number$"), "id").when(n.rlike("name|title"), "name").when(n.rlike("keyword|tag|topic"), "keyword").when((F.col("semantic") == "DATE") | n.rlike("date|time"), "date").when(n.rlike("status|state|flag"), "status").otherwise("other")
    return types.select("table", "column", role.alias("role"))


def enum_samples(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """Up to `most` distinct values, least first, empty ones left out."""
    c = F.col(column)
    return df.filter(c.isNotNull() & (F.trim(c) != "")).select(c.alias("value")).distinct().orderBy("value").limit(most)


def topology(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Per database (db_id): hub, its in- and out-degree, longest path, schema type, archetype, patterns that it supports.

    `fks` has db_id, child_table, parent_table; `tables` db_id and table. Self references do not count.
    """
    e = fks.filter("child_table <> parent_table").select("db_id", "child_table", "parent_table").distinct()
    indeg = e.groupBy("db_id", F.col("parent_table").alias("table")).agg(F.countDistinct("child_table").alias("d"))
    hub = indeg.groupBy("db_id").agg(F.max_by("table", F.struct("d", "table")).alias("hub"), F.max("d").alias("hub_in"))
    outdeg = e.groupBy("db_id", F.col("child_table").alias("hub")).agg(F.countDistinct("parent_table").alias("hub_out"))
    depth = path_depth(e)
    out = tables.select("db_id").distinct().join(hub, "db_id", "left").join(outdeg, ["db_id", "hub"], "left").join(depth, "db_id", "left").fillna(0, ["hub_in", "hub_out", "depth"])
    kind = F.when(F.col("depth") == 0, "no_fk").when(F.col("hub_in") >= 2, "intersection").otherwise("path_only")
    shape = F.when(F.col("depth") == 0, "flat").when((F.col("hub_in") >= 2) & (F.col("depth") >= 2), "snowflake").when(F.col("hub_in") >= 2, "star").otherwise("chain")
    chain = F.when(F.col("depth") >= 1, F.transform(F.sequence(F.lit(1), F.least("depth", F.lit(3))), lambda i: F.concat(i.cast("string"), F.lit("p")))).otherwise(F.array().cast("array<string>"))
    star = F.when(F.col("hub_in") >= 2, F.transform(F.sequence(F.lit(2), F.least(F.col("hub_in").cast("int"), F.lit(4))), lambda i: F.concat(i.cast("string"), F.lit("i")))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"schema_type": kind, "archetype": shape, "pure_endpoint": F.col("hub_out") == 0, "patterns": F.concat(F.array(F.lit("0")), chain, star)})


def longest_path(edges: list[tuple[str, str]]) -> int:
    """Moves of the longest path along the keys of one catalog, of any length.

    Tables that reach each other are one component. A component of k tables is
    passed in k - 1 moves and, where the path ends in it, left by the move that
    closes its circle; then levels are relaxed over the components.
    """
    if not edges:
        return 0
    at = {t: k for k, t in enumerate(sorted({t for e in edges for t in e}))}
    reach = np.zeros((len(at), len(at)), bool)
    for a, b in edges:
        reach[at[a], at[b]] = True
    direct = reach.copy()
    while True:
        more = reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)
        if (more == reach).all():
            break
        reach = more
    label = np.argmax((reach & reach.T) | np.eye(len(at), dtype=bool), 1)
    size = np.bincount(label, minlength=len(at))
    moves = {(label[i], label[j]) for i, j in zip(*np.nonzero(direct), strict=True) if label[i] != label[j]}
    ends = np.where(size > 1, size, 0)
    depth = ends.copy()
    while True:
        new = depth.copy()
        for a, b in moves:
            new[a] = max(new[a], size[a] + depth[b])
        if (new == depth).all():
            return int(depth.max())
        depth = new


def path_depth(edges: DataFrame) -> DataFrame:
    """(db_id, depth): the longest path of each catalog (see longest_path); a group is one database's keys."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"db_id": [key[0]], "depth": [longest_path(list(zip(rows["child_table"], rows["parent_table"], strict=True)))]})

    kind = edges.schema["db_id"].dataType.simpleString()
    return edges.groupBy("db_id").applyInPandas(one, f"db_id {kind}, depth int")


def corpus_report(topologies: DataFrame) -> DataFrame:
    """Counts of schema types, hubs, archetypes and patterns over a corpus: (measure, key, n)."""
    t = topologies
    measures = [
        t.groupBy(F.lit("schema_type").alias("measure"), F.col("schema_type").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        t.groupBy(F.lit("archetype").alias("measure"), F.col("archetype").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        t.groupBy(F.lit("depth").alias("measure"), F.col("depth").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        t.groupBy(F.lit("hub_in").alias("measure"), F.col("hub_in").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        t.select(F.explode("patterns").alias("key")).groupBy(F.lit("pattern").alias("measure"), "key").agg(F.count(F.lit(1)).alias("n")),
        t.filter("pure_endpoint AND hub IS NOT NULL").agg(F.lit("pure_endpoint").alias("measure"), F.lit("hub").alias("key"), F.count(F.lit(1)).alias("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), measures)


def fallback_target(profiles: DataFrame) -> DataFrame:
    """The table with most rows x columns, of those with two columns at least; equals by name."""
    sizes = profiles.groupBy("table").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("c >= 2")
    return sizes.agg(F.max_by("table", F.struct(F.col("n") * F.col("c"), "table")).alias("target"))


def schema_text(columns: DataFrame, most: int = 8000) -> DataFrame:
    """(table, text): "table(column type, ...)" in order, cut to `most` characters."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(" ", "column", "dtype").alias("t"))))
    return columns.groupBy("table").agg(parts.alias("p")).select("table", F.substring(F.concat("table", F.lit("("), F.array_join(F.transform("p", lambda x: x["t"]), ", "), F.lit(")")), 1, most).alias("text"))


def infer_database(prompts: DataFrame, tables: DataFrame, key: str, text: str) -> DataFrame:
    """(key, db_id): the database whose table names a text has most of; equals by name."""
    words = prompts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1)))).alias("table"))
    hits = words.join(tables.select("db_id", F.lower("table").alias("table")).distinct(), "table").groupBy(key, "db_id").agg(F.count(F.lit(1)).alias("c"))
    return hits.groupBy(key).agg(F.min_by("db_id", F.struct(-F.col("c"), "db_id")).alias("db_id"))


def id_columns(profiles: DataFrame, keys: DataFrame, common: tuple[str, ...] = ("id", "uid", "uuid", "key", "code")) -> DataFrame:
    """(table, id_column): the primary key, else the first column with a common name or ending, else the first column."""
    name = F.lower("column")
    rank = F.when(name.isin(*common), 0).when(name.rlike("_id$|key$"), 1).otherwise(2)
    picked = profiles.groupBy("table").agg(F.min_by("column", F.struct(rank, "ordinal")).alias("_c"))
    return picked.join(keys, "table", "left").select("table", F.coalesce("primary_key", "_c").alias("id_column"))


def loose_keys(profiles: DataFrame) -> DataFrame:
    """(table, primary_key) by the looser rule: `id`, else a unique *_id or *key, else the first column."""
    name = F.lower("column")
    unique = (F.col("n_distinct") == F.col("n")) & (F.col("n_set") == F.col("n"))
    rank = F.when(name == "id", 0).when(name.rlike("_id$|key$") & unique, 1).otherwise(2)
    return profiles.groupBy("table").agg(F.min_by("column", F.struct(rank, "ordinal")).alias("primary_key"))
