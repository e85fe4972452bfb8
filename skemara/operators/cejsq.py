"""Conjunctive equi-join selection queries: joined frames, anchored predicates, batch evaluation and gates.

Many queries of one structure are answered in one pass over its joined frame:
each row is tested against all of them and contributes the numbers of those
that it satisfies. Anchors are a bounded number of rows, one per query.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.functions.scalar import PRIME, mix
from skemara.operators.catalog import ForeignKey, Schema, Tables
from skemara.operators.statements import by_source, counts, hits
from skemara.operators.structures import TIER_RANGE

#: Rows of a join that is still made (fixed value; a parameter wherever it is used), and queries evaluated in one pass: beyond about a hundred, code generation gives up.
MAX_ROWS, PASS = 1_000_000, 100
OPERATORS = {"NUMERIC": ("=", ">=", "<="), "YEAR": ("=", ">=", "<="), "DATE": ("=", ">=", "<="), "ENUM": ("=",), "BOOLEAN": ("=",), "LABEL": ("=",), "COMMA_SEPARATED": ("LIKE",)}


@dataclass(frozen=True)
class Predicate:
    alias: str
    column: str
    op: str
    value: object
    kind: str


@dataclass(frozen=True)
class Spec:
    number: int
    strategy: str
    tables: tuple[str, ...]
    star: bool
    predicates: tuple[Predicate, ...]
    #: The key of each join, in order; empty where the tables tell it.
    keys: tuple[str, ...] = ()


def links(schema: Schema, a: str, b: str, key: str | None = None) -> list[tuple[str, str]]:
    """Column pairs of the key between two tables, all columns of a composite one; of several keys the one named, and without a name none is chosen."""
    found = {}
    for fk in schema.foreign:
        if key is None or fk.key == key:
            if (fk.child, fk.parent) == (a, b):
                found[fk.key] = list(zip(fk.columns, fk.parent_columns, strict=True))
            elif (fk.child, fk.parent) == (b, a):
                found[fk.key] = list(zip(fk.parent_columns, fk.columns, strict=True))
    if not found:
        raise ValueError(f"no key between {a} and {b}" + (f" named {key}" if key else ""))
    if len(found) > 1:
        raise ValueError(f"several keys between {a} and {b}: {', '.join(sorted(found))}; name one")
    return next(iter(found.values()))


def aliases(tables: tuple[str, ...]) -> list[str]:
    """A table's name, and name__k for its k-th repetition."""
    seen: dict[str, int] = {}
    out = []
    for t in tables:
        out.append(t if t not in seen else f"{t}__{seen[t]}")
        seen[t] = seen.get(t, 0) + 1
    return out


def joined(tables: Tables, schema: Schema, names: tuple[str, ...], star: bool, columns: dict[str, list[str]] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The join of a chain (each table to the one before) or star (each to the target), along `keys` if given; columns are named column_alias, the target's key keeps its name."""
    key = schema.primary[schema.target]
    marks = aliases(names)

    def part(table: str, alias: str) -> DataFrame:
        df = tables[table]
        need = {c for fk in schema.foreign for t, cs in ((fk.child, fk.columns), (fk.parent, fk.parent_columns)) if t == table for c in cs}
        keep = [c for c in df.columns if columns is None or c in columns.get(table, ()) or c in need or (table == schema.target and c == key)]
        return df.select(*(F.col(f"`{c}`").alias(f"{c}_{alias}") for c in keep))

    out = part(names[0], marks[0]).withColumn(key, F.col(f"{key}_{marks[0]}"))
    for i in range(1, len(names)):
        on = 0 if star else i - 1
        pairs = links(schema, names[on], names[i], keys[i - 1] if keys else None)
        cond = reduce(lambda x, y: x & y, (F.col(f"{a}_{marks[on]}") == F.col(f"{b}_{marks[i]}") for a, b in pairs))
        out = out.join(part(names[i], marks[i]), cond)
    return out


def _weighed(tables: Tables, schema: Schema, names: tuple[str, ...], star: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the first table with _w, how many rows of the join each stands for, by passing counts from the leaves to it; the join is never made."""
    def weigh(i: int, weight: DataFrame, on: str) -> DataFrame:
        """Rows of table `on` with the product of weights of what hangs below."""
        pairs = links(schema, on, names[i], keys[i - 1] if keys else None)
        sums = weight.groupBy(*(F.col(b).alias(f"_k{k}") for k, (_, b) in enumerate(pairs))).agg(F.sum("_w").alias("_s"))
        return pairs, sums

    one = lambda t: tables[t].withColumn("_w", F.lit(1).cast("decimal(38,0)"))
    if star:
        out = one(names[0])
        for i in range(1, len(names)):
            pairs, sums = weigh(i, one(names[i]), names[0])
            out = out.join(sums, reduce(lambda x, y: x & y, (F.col(a) == F.col(f"_k{k}") for k, (a, _) in enumerate(pairs))))
            out = out.withColumn("_w", (F.col("_w") * F.col("_s")).cast("decimal(38,0)")).drop("_s", *(f"_k{k}" for k in range(len(pairs))))
    else:
        out = one(names[-1])
        for i in range(len(names) - 1, 0, -1):
            pairs, sums = weigh(i, out, names[i - 1])
            out = tables[names[i - 1]].join(sums, reduce(lambda x, y: x & y, (F.col(a) == F.col(f"_k{k}") for k, (a, _) in enumerate(pairs)))).withColumn("_w", F.col("_s").cast("decimal(38,0)"))
            out = out.drop("_s", *(f"_k{k}" for k in range(len(pairs))))
    return out


def join_size(tables: Tables, schema: Schema, names: tuple[str, ...], star: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row: the exact number of rows of the join, which is never made."""
    return _weighed(tables, schema, names, star, keys).agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("long").alias("rows"))


def join_sizes(tables: Tables, schema: Schema, names: tuple[str, ...], star: bool, by: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(by, n): the exact number of rows of the join per value of columns of its first table; the join is never made."""
    return _weighed(tables, schema, names, star, keys).groupBy(*by).agg(F.sum("_w").cast("long").alias("n"))


def small_enough(tables: Tables, schema: Schema, structures: list[tuple[tuple[str, ...], bool]], most: int = MAX_ROWS) -> list[tuple[tuple[str, ...], bool]]:
    """The structures whose join has `most` rows at most, told from counts before any join is made."""
    return [(names, star) for names, star in structures if join_size(tables, schema, names, star).first()["rows"] <= most]


def involved(spec: Spec) -> tuple[list[str], list[str]]:
    """Tables and columns that a query touches, each once, in order."""
    return list(dict.fromkeys(spec.tables)), list(dict.fromkeys(f"{p.alias}.{p.column}" for p in spec.predicates))


def primary_reason(tried: DataFrame) -> DataFrame:
    """(strategy, attempts, reason): the most frequent failure of each class, first in name among equals."""
    counts = tried.groupBy("strategy", "outcome").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("strategy").agg(F.sum("c").alias("attempts"), F.min_by(F.when(F.col("outcome") != "ok", F.col("outcome")), F.when(F.col("outcome") != "ok", F.struct(-F.col("c"), F.col("outcome")))).alias("reason"))


def test(p: Predicate) -> Column:
    """A predicate over a joined frame. LIKE is a literal, case-insensitive containment."""
    c = F.col(f"`{p.column}_{p.alias}`")
    if p.op == "LIKE":
        return F.contains(F.lower(c), F.lit(str(p.value).lower()))
    v = F.lit(p.value)
    return {"=": c == v, ">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[p.op]


def all_of(predicates: tuple[Predicate, ...]) -> Column:
    return reduce(lambda a, b: a & b, map(test, predicates), F.lit(True))


def answers(frame: DataFrame, specs: list[Spec], key: str) -> DataFrame:
    """(spec, answer): distinct target keys of each query, PASS queries in a pass."""
    parts = []
    for i in range(0, len(specs), PASS):
        hits = F.explode(F.array_compact(F.array(*(F.when(all_of(s.predicates), F.lit(s.number)) for s in specs[i : i + PASS]))))
        parts.append(frame.filter(F.col(key).isNotNull()).select(hits.alias("spec"), F.col(key).alias("answer")).distinct())
    return reduce(lambda a, b: a.unionByName(b), parts)


def within(found: DataFrame, most: int) -> DataFrame:
    """(spec, n): queries with 1..most answers."""
    return found.groupBy("spec").agg(F.countDistinct("answer").alias("n")).filter(F.col("n").between(1, most))


def _rand(*keys: int) -> int:
    h = 1
    for k in keys:
        h = (h * 48271 + k * 16807 + 1) % PRIME
        h = (h * h + k * 69621) % PRIME
    return h


def anchors(frame: DataFrame, key: str, count: int, seed: int = 0) -> list:
    """`count` rows of the frame, of the target keys with least hash, the least row of each by hash: a bounded sample.

    Only keys are compared over the whole frame; the rows of those that are taken are then fetched.
    """
    cols = [c for c in frame.columns if c != key]
    order = mix(F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit(0x7FFFFFFF)), seed)
    keys = frame.select(key).distinct().orderBy(order, key).limit(count)
    # `count` rows at most.
    mine = frame.join(F.broadcast(keys), key, "left_semi")
    one = mine.groupBy(key).agg(F.min_by(F.struct(*cols), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in cols))).alias("row"))
    return one.orderBy(order, key).collect()


def anchored_specs(frame: DataFrame, schema: Schema, strategy: str, names: tuple[str, ...], star: bool, filterable: dict[str, list[tuple[str, str]]], count: int, first: int = 0, seed: int = 0) -> list[Spec]:
    """Queries of a class whose predicates are read from anchor rows, so that each has its anchor as an answer."""
    specs = []
    for k, row in enumerate(anchors(frame, schema.primary[schema.target], count, seed)):
        preds = anchored_predicates(row["row"], strategy[-1], predicate_pool(names, filterable), seed, k)
        if preds:
            specs.append(Spec(first + k, strategy, names, star, preds))
    return specs


def predicate_pool(names: tuple[str, ...], filterable: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str]]:
    """(alias, column, kind) of what predicates over these tables may use."""
    return [(a, c, kind) for a, t in zip(aliases(names), names, strict=True) for c, kind in filterable.get(t, [])]


def anchored_predicates(row, tier: str, pool: list[tuple[str, str, str]], seed: int, k: int) -> tuple[Predicate, ...]:
    """As many predicates as the tier asks for, that `row` satisfies, chosen by hash of (seed, k); none if it has too few usable values."""
    low, high = TIER_RANGE[tier]
    cells = [(a, c, kind, row[f"{c}_{a}"]) for a, c, kind in pool]
    cells = [x for x in cells if x[3] is not None and not (isinstance(x[3], str) and x[3].strip() != x[3] or x[3] == "")]
    cells.sort(key=lambda x: _rand(seed, k, sum(map(ord, x[0] + x[1]))))
    want = low + _rand(seed, k, 7) % (high - low + 1)
    picked = cells[:want]
    if len(picked) < low:
        return ()
    preds = []
    for i, (a, c, kind, v) in enumerate(picked):
        ops = OPERATORS[kind]
        op = ops[_rand(seed, k, i, 3) % len(ops)]
        if op == "LIKE":
            parts = [x.strip() for x in v.split(",") if x.strip()]
            v = parts[_rand(seed, k, i, 5) % len(parts)] if parts else v
        preds.append(Predicate(a, c, op, v, kind))
    return tuple(preds)


def literal(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"TIMESTAMP '{v}'" if isinstance(v, datetime.datetime) else f"DATE '{v}'"
    return "'" + str(v).replace("'", "''") + "'"


def render(spec: Spec, schema: Schema) -> str:
    """SQL text of a query; LIKE patterns escape their wildcards."""
    marks, key = aliases(spec.tables), schema.primary[schema.target]
    sql = f"SELECT DISTINCT {marks[0]}.{key} FROM {spec.tables[0]} AS {marks[0]}"
    for i in range(1, len(marks)):
        on = 0 if spec.star else i - 1
        cond = " AND ".join(f"{marks[on]}.{a} = {marks[i]}.{b}" for a, b in links(schema, spec.tables[on], spec.tables[i], spec.keys[i - 1] if spec.keys else None))
        sql += f" JOIN {spec.tables[i]} AS {marks[i]} ON {cond}"

    def term(p: Predicate) -> str:
        if p.op == "LIKE":
            text = str(p.value).lower().replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("'", "''")
            return f"lower({p.alias}.{p.column}) LIKE '%{text}%' ESCAPE '!'"
        return f"{p.alias}.{p.column} {p.op} {literal(p.value)}"

    return sql + " WHERE " + " AND ".join(map(term, spec.predicates)) if spec.predicates else sql


#: Statements of different structures that share a job.
TOGETHER = 16


def gold_gate(spark: SparkSession, tables: Tables, specs: list[Spec], schema: Schema, stored: DataFrame) -> DataFrame:
    """(spec, answer, side) where statements' own results and the stored answers (spec, answer) differ: none for a query that passes.

    Statements over the same join are run by their texts' conditions, PASS in a pass; TOGETHER others run in a job.
    """
    for name in {t for s in specs for t in s.tables}:
        tables[name].createOrReplaceTempView(name)
    texts = [render(s, schema) for s in specs]
    groups, alone = by_source(texts)
    runs = []
    for shared, conditions in groups:
        for i in range(0, len(conditions), PASS):
            part = conditions[i : i + PASS]
            found = hits(spark, shared, [(specs[k].number, c) for k, c in part]).select(F.col("k").alias("spec"), "row.*").toDF("spec", "answer")
            runs.append(([specs[k].number for k, _ in part], found))
    for i in range(0, len(alone), TOGETHER):
        part = alone[i : i + TOGETHER]
        found = [spark.sql(texts[k]).toDF("answer").select(F.lit(specs[k].number).alias("spec"), "answer") for k in part]
        runs.append(([specs[k].number for k in part], reduce(lambda a, b: a.unionByName(b), found)))
    gaps = []
    for numbers, run in runs:
        mine = stored.filter(F.col("spec").isin(*numbers)).select("spec", "answer")
        both = mine.withColumn("_s", F.lit(1)).unionByName(run.filter("answer IS NOT NULL").withColumn("_s", F.lit(-1))).groupBy("spec", "answer").agg(F.sum("_s").alias("_s")).filter("_s <> 0")
        gaps.append(both.select("spec", "answer", F.when(F.col("_s") > 0, "extra").otherwise("missing").alias("side")))
    return reduce(lambda a, b: a.unionByName(b), gaps)


def resolves(spark: SparkSession, sql: str) -> str | None:
    """None if a statement's names and types resolve, else why not; nothing runs."""
    try:
        spark.sql(sql).schema  # noqa: B018
    except Exception as e:
        return str(e).split("\n")[0][:200]
    return None


def code_of(spec: Spec) -> str:
    """Class of a query from its shape and predicate count."""
    hops = len(spec.tables) - 1
    pattern = "0" if hops == 0 else f"{hops}i" if spec.star and hops > 1 else f"{hops}p"
    n = len(spec.predicates)
    return pattern + ("E" if n <= 2 else "M" if n <= 5 else "H")


def outcomes(specs: list[Spec], found: DataFrame, most: int) -> DataFrame:
    """(spec, strategy, n, outcome): ok, no_results, too_many, or validation where the class is not the one asked for."""
    spark = found.sparkSession
    rows = spark.createDataFrame([(s.number, s.strategy, code_of(s) == s.strategy) for s in specs], "spec int, strategy string, same boolean")
    n = found.groupBy("spec").agg(F.countDistinct("answer").alias("n"))
    out = rows.join(n, "spec", "left").fillna(0, ["n"])
    return out.select("spec", "strategy", "n", F.when(~F.col("same"), "validation").when(F.col("n") == 0, "no_results").when(F.col("n") > most, "too_many").otherwise("ok").alias("outcome"))


def random_specs(schema: Schema, filterable: dict[str, list[tuple[str, str, list]]], count: int, first: int = 0, seed: int = 0) -> list[Spec]:
    """Baseline: 0..2 related tables of the target and 1..4 predicates on sampled values, no class asked for."""
    near = sorted({fk.parent if fk.child == schema.target else fk.child for fk in schema.foreign if schema.target in (fk.child, fk.parent) and fk.child != fk.parent})
    specs = []
    for k in range(count):
        arms = sorted(near, key=lambda t: _rand(seed, k, sum(map(ord, t))))[: _rand(seed, k, 11) % 3]
        names = (schema.target, *arms)
        pool = [(t, *x) for t in names for x in filterable.get(t, []) if x[2]]
        pool.sort(key=lambda x: _rand(seed, k, sum(map(ord, x[0] + x[1]))))
        preds = []
        for i, (t, c, kind, sample) in enumerate(pool[: 1 + _rand(seed, k, 13) % 4]):
            ops = (*OPERATORS[kind], ">", "<") if kind == "NUMERIC" else OPERATORS[kind]
            preds.append(Predicate(t, c, ops[_rand(seed, k, i, 3) % len(ops)], sample[_rand(seed, k, i, 5) % len(sample)], kind))
        specs.append(Spec(first + k, "", names, len(arms) > 0, tuple(preds)))
    return specs


def execute_pairs(spark: SparkSession, pairs: list[tuple[str, str]], most: int) -> DataFrame:
    """(uid, status, n) of supplied statements: ok with 1..most distinct rows, empty, too_many, or error if it does not resolve or fails; n stops at `most` + 1.

    Selections that differ in their conditions only are counted PASS in a pass
    over what they read; TOGETHER others run in a job. A pass or job that fails
    is cut down until one bad value costs its own statement only. In a pass,
    conditions are tested on joined rows: a bad value that no such row meets is
    no error there, while a statement run alone may meet it before its join.
    """
    def run(part: list[int]) -> list[tuple[int, int]]:
        each = [spark.sql(pairs[k][1]).distinct().limit(most + 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k in part]
        return [(r["k"], r["n"]) for r in reduce(lambda a, b: a.unionByName(b), each).collect()]

    def alone(k: int) -> int | None:
        if resolves(spark, pairs[k][1]):
            return None
        try:
            return run([k])[0][1]
        except Exception:
            return None

    found: dict[int, int | None] = {}
    groups, others = by_source([sql for _, sql in pairs])
    for shared, conditions in groups:
        for i in range(0, len(conditions), PASS):
            found |= counts(spark, shared, conditions[i : i + PASS], alone)
    good = [k for k in others if resolves(spark, pairs[k][1]) is None]
    for i in range(0, len(good), TOGETHER):
        part = good[i : i + TOGETHER]
        try:
            found |= dict(run(part))
        except Exception:
            found |= {k: alone(k) for k in part}
    rows = []
    for k, (uid, _) in enumerate(pairs):
        n = found.get(k)
        rows.append((uid, "error", 0) if n is None else (uid, "ok" if 1 <= n <= most else "empty" if n == 0 else "too_many", min(n, most + 1)))
    return spark.createDataFrame(rows, "uid string, status string, n long")


__all__ = [n for n in dir() if not n.startswith("_")] + ["ForeignKey"]
