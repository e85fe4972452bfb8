"""Quota-driven generation: attempts of all classes in rounds, one pass per structure and round, until quotas are met or given up.

What an attempt builds is a function of (class, attempt, try), so a round may
draw as many attempts as a class is likely to need and verify them together:
folding their outcomes in order gives what building one after the other would.
Attempts are catalog rows (at most a fixed multiple of the quotas); data rows
are only met by the passes over the joined frames.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.operators import structures as C
from skemara.operators.catalog import Schema, Tables
from skemara.operators.cejsq import MAX_ROWS, Spec, _rand, anchored_predicates, anchors, answers, code_of, join_size, joined, predicate_pool, render
from skemara.sources.scratch import stored

#: An attempt's tries, and the attempts, as multiples of a quota, after which a class is given up without and with accepted queries.
TRIES, GIVE_UP, KEEP_GOING = 10, 12, 80
#: Failures of a try in the order in which the most frequent is looked for, and the reason that each stands for.
FAILURES = {"no_results": "sparse_combinations", "too_many_results": "result_size_out_of_range", "validation_failed": "strategy_validation_failed", "insufficient_filters": "insufficient_filter_columns"}
#: Rows of a structure's frame that anchors are drawn from, and attempts of a class in a round at most.
ANCHORS, ROUND = 256, 400
REPORT = "strategy string, quota long, accepted long, shortfall long, fulfilment double, feasible boolean, attempts long, tries long, reason string"


@dataclass
class Structure:
    """A chain or star with the joined frame over it and rows to anchor queries on."""

    tables: tuple[str, ...]
    keys: tuple[str, ...]
    star: bool
    frame: DataFrame | None = None
    rows: list = field(default_factory=list)


@dataclass
class ClassState:
    """How far a class has come."""

    strategy: str
    ordinal: int
    quota: int
    accepted: list[tuple[int, Spec]] = field(default_factory=list)
    attempts: int = 0
    tries: int = 0
    failures: Counter = field(default_factory=Counter)

    def open(self) -> bool:
        bound = (KEEP_GOING if self.accepted else GIVE_UP) * self.quota
        return len(self.accepted) < self.quota and self.attempts < bound

    def wanted(self) -> int:
        """Attempts to draw: what is missing by the rate so far, and a quarter more, within what is left before the class is given up."""
        missing = self.quota - len(self.accepted)
        rate = (len(self.accepted) + 1) / (self.attempts + 1)
        bound = (KEEP_GOING if self.accepted else GIVE_UP) * self.quota - self.attempts
        return max(1, min(math.ceil(1.25 * missing / min(1.0, rate)), bound, ROUND))


def enumerate_structures(spark: SparkSession, schema: Schema) -> dict[str, list[Structure]]:
    """Structures of each pattern from the schema's target, by tables and keys."""
    fks = spark.createDataFrame([(k.key, k.child, k.columns[0], k.parent) for k in schema.foreign], "name string, child_table string, child_column string, parent_table string")
    found: dict[str, list[Structure]] = {}
    # A row per structure of the catalog.
    for r in sorted(C.structures(fks, schema.target).collect(), key=lambda r: (r["pattern"], r["tables"], r["keys"])):
        found.setdefault(r["pattern"], []).append(Structure(tuple(r["tables"]), tuple(r["keys"]), r["pattern"].endswith("i")))
    return found


def feasible_classes(found: dict[str, list[Structure]], filters: dict[str, list[tuple[str, str]]]) -> list[str]:
    """Classes with a structure that has as many usable columns as the tier needs, a table that is in it twice counted twice."""
    most = {p: max((len(predicate_pool(s.tables, filters)) for s in group), default=0) for p, group in found.items()}
    return [p + t for p, n in most.items() for t, (low, _) in C.TIER_RANGE.items() if n >= low]


def build(state: ClassState, structures: list[Structure], attempt: int, turn: int, filters: dict, seed: int) -> tuple[Structure, Spec | None, str | None]:
    """What try `turn` of an attempt builds: its structure, and a query or why there is none. Structures come in turn, anchors by hash."""
    s = structures[(attempt + turn) % len(structures)]
    if not s.rows:
        return s, None, "no_results"
    unit = _rand(seed, state.ordinal, attempt, turn)
    row = s.rows[unit % len(s.rows)]["row"]
    predicates = anchored_predicates(row, state.strategy[-1], predicate_pool(s.tables, filters), seed, unit)
    if not predicates:
        return s, None, "insufficient_filters"
    spec = Spec(0, state.strategy, s.tables, s.star, predicates, s.keys)
    return s, spec, None if code_of(spec) == state.strategy else "validation_failed"


def reason_of(failed: Counter, pattern: str) -> str:
    """The reason that an attempt's most frequent failure stands for."""
    worst = max(FAILURES, key=lambda k: failed[k])
    return "no_valid_values" if worst == "no_results" and not pattern.endswith(("p", "i")) else FAILURES[worst]


def fold(state: ClassState, attempt: int, outcomes: list[tuple[Spec | None, str]], schema: Schema, seen: set[str]) -> None:
    """Count one attempt whose tries came out so: the first query that is ok is taken unless its text is known."""
    state.attempts += 1
    failed: Counter = Counter()
    for spec, outcome in outcomes:
        state.tries += 1
        if outcome == "ok":
            text = render(spec, schema)
            if text in seen:
                state.failures["duplicate_pair"] += 1
            else:
                seen.add(text)
                state.accepted.append((attempt, spec))
            return
        failed[outcome] += 1
    state.failures[reason_of(failed, state.strategy[:-1])] += 1


def primary(state: ClassState, feasible: bool) -> str | None:
    """Why a class fell short: the most frequent reason, the first to appear among equals."""
    if len(state.accepted) >= state.quota:
        return None
    if not feasible:
        return "pattern_infeasible"
    return state.failures.most_common(1)[0][0] if state.failures else "attempt_budget_exhausted"


def _verified(specs: list[tuple[Structure, Spec]], key: str, most: int) -> dict[int, int]:
    """Answers of each query by number, counted to most + 1; one pass per structure (and hundred queries)."""
    groups: dict[int, tuple[Structure, list[Spec]]] = {}
    for s, spec in specs:
        groups.setdefault(id(s), (s, []))[1].append(spec)
    if not groups:
        return {}
    counts = [answers(s.frame, part, key).groupBy("spec").agg(F.count(F.lit(1)).alias("n")) for s, part in groups.values()]
    # A row per query that has answers.
    return {r["spec"]: r["n"] for r in reduce(lambda a, b: a.unionByName(b), counts).collect()}


def generate(
    tables: Tables, schema: Schema, quotas: dict[str, int], filters: dict[str, list[tuple[str, str]]], most: int = 15, tries: int = TRIES, seed: int = 0, rows: int = MAX_ROWS, sample: int = ANCHORS, spark: SparkSession | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted queries (number, strategy, attempt, sql, answers) and a report row per class (see REPORT), for quotas by class.

    A class that no structure can hold is infeasible. Others get attempts until
    the quota is met, or twelve times the quota has failed, or eighty times with
    some accepted. An attempt tries up to `tries` builds, structures in turn;
    the first with 1..`most` answers is taken. A structure whose join would have
    more than `rows` rows (told from counts) or none is tried without a result.
    `filters` has (column, kind) per table. Queries of one text are taken once.
    """
    spark = spark or next(iter(tables.values())).sparkSession
    key = schema.primary[schema.target]
    found = enumerate_structures(spark, schema)
    able = set(feasible_classes(found, filters))
    states = [ClassState(s, k, q) for k, (s, q) in enumerate(sorted(quotas.items()))]
    wanted = {c: [x for x, _ in cs] for c, cs in filters.items()}
    used = {s.strategy[:-1] for s in states if s.strategy in able and s.quota > 0}
    for pattern in sorted(used):
        for s in found[pattern]:
            if len(s.tables) == 1 or join_size(tables, schema, s.tables, s.star, s.keys).first()["rows"] <= rows:
                s.frame = stored(joined(tables, schema, s.tables, s.star, wanted, s.keys), "frame")
                s.rows = anchors(s.frame, key, sample, seed)
    seen: set[str] = set()
    home: dict[int, Structure] = {}
    while any(s.strategy in able and s.open() for s in states):
        batch, number, plan = [], 0, []
        for s in states:
            if s.strategy not in able or not s.open():
                continue
            for attempt in range(s.attempts, s.attempts + s.wanted()):
                built = []
                for turn in range(tries):
                    structure, spec, failure = build(s, found[s.strategy[:-1]], attempt, turn, filters, seed)
                    if spec is not None and failure is None:
                        spec = Spec(number, *(getattr(spec, f) for f in ("strategy", "tables", "star", "predicates", "keys")))
                        number += 1
                        batch.append((structure, spec))
                        home[id(spec)] = structure
                    built.append((spec, failure))
                plan.append((s, attempt, built))
        counts = _verified(batch, key, most)
        for s, attempt, built in plan:
            if s.open():
                fold(s, attempt, [(spec, failure or ("no_results" if not counts.get(spec.number) else "too_many_results" if counts[spec.number] > most else "ok")) for spec, failure in built], schema, seen)
    number, groups, texts = 0, {}, []
    for s in states:
        for attempt, spec in s.accepted:
            mine = Spec(number, spec.strategy, spec.tables, spec.star, spec.predicates, spec.keys)
            groups.setdefault(id(home[id(spec)]), (home[id(spec)], []))[1].append(mine)
            texts.append((number, s.strategy, attempt, render(mine, schema)))
            number += 1
    queries = spark.createDataFrame(texts, "number int, strategy string, attempt int, sql string")
    parts = [answers(s.frame, part, key).select("spec", F.col("answer").cast("string").alias("answer")) for s, part in groups.values()]
    if parts:
        # Up to `most` answers each.
        lists = reduce(lambda a, b: a.unionByName(b), parts).groupBy("spec").agg(F.array_sort(F.collect_list("answer")).alias("answers"))
        queries = stored(queries.join(lists, F.col("number") == F.col("spec")).drop("spec"), "generated")
    else:
        queries = queries.withColumn("answers", F.array().cast("array<string>"))
    report = [(s.strategy, s.quota, len(s.accepted), s.quota - len(s.accepted), len(s.accepted) / s.quota if s.quota else 1.0, s.strategy in able, s.attempts, s.tries, primary(s, s.strategy in able)) for s in states]
    return queries, spark.createDataFrame(report, REPORT)
