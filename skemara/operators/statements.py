"""Supplied statements that differ only in their conditions, answered in one pass over what they read.

A statement is cut as text into what it selects, what it reads and its WHERE
clause; Spark resolves each part. Statements with the same first two parts are
tested together: a row of the joined frame carries the numbers of those whose
condition it meets. Anything else than a plain selection is left to be run by
itself, and so is whatever does not resolve together with others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = re.compile(r"'(?:[^']|'')*'")
_PLAIN = re.compile(r"\s*select\s+(?:distinct\s+)?(?P<columns>[^()]+?)\s+from\s+(?P<source>[^()]+?)(?:\s+where\s+(?P<condition>.+?))?[\s;]*", re.I | re.S)
#: Words that make a statement more than a selection of joined rows by a condition.
_MORE = re.compile(r"\b(select|from|where|group|having|order|limit|offset|fetch|union|intersect|except|minus|window|over|qualify|cluster|distribute|sort|lateral|pivot|unpivot|tablesample)\b", re.I)


@dataclass(frozen=True)
class Selection:
    """What a statement selects, what it reads and its condition, as text."""

    columns: str
    source: str
    condition: str


def _balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def selection(sql: str | None) -> Selection | None:
    """The parts of a plain selection, with DISTINCT left out; None for null and for any other statement.

    Texts in quotes count as one unknown value, so that words within them do not
    matter. Comments, escapes, other quotes, parameters, and brackets before the
    condition are not looked into: such statements are not plain.
    """
    if sql is None or "\\" in sql:
        return None
    masked = _TEXT.sub(lambda m: "'" + "x" * (len(m[0]) - 2) + "'", sql)
    if re.search(r'--|/\*|["`:?]|\|>|;\s*\S', masked):
        return None
    found = _PLAIN.fullmatch(masked)
    if not found:
        return None
    columns, source, condition = (found[g] or "" for g in ("columns", "source", "condition"))
    if any(map(_MORE.search, (columns, source, condition))) or "'" in columns + source or not _balanced(condition):
        return None
    own = sql[slice(*found.span("condition"))] if condition else "true"
    return Selection(" ".join(columns.split()), " ".join(source.split()), own)


def by_source(statements: list[str | None]) -> tuple[list[tuple[Selection, list[tuple[int, str]]]], list[int]]:
    """Groups of (parts that are shared, [(place, condition)]) with two statements or more, and the places of all others."""
    groups: dict[tuple[str, str], list[tuple[int, str]]] = {}
    shared, alone = {}, []
    for k, sql in enumerate(statements):
        parts = selection(sql)
        if parts is None:
            alone.append(k)
        else:
            shared.setdefault((parts.columns, parts.source), parts)
            groups.setdefault((parts.columns, parts.source), []).append((k, parts.condition))
    alone += [conditions[0][0] for conditions in groups.values() if len(conditions) == 1]
    return [(shared[g], conditions) for g, conditions in groups.items() if len(conditions) > 1], sorted(alone)


def _marked(spark: SparkSession, shared: Selection, conditions: list[tuple[int, str]]) -> DataFrame:
    """Rows of what a group reads: (_marks, with nulls for conditions that are not met; _row, what is selected).

    All columns are named beside the conditions, so that aggregates in these fail
    here as they do in a WHERE clause; they are pruned before anything is read.
    """
    marks = ", ".join(f"CASE WHEN ({c}\n) THEN {k} END" for k, c in conditions)
    return spark.sql(f"SELECT array({marks}) AS _marks, struct({shared.columns}) AS _row, struct(*) AS _all FROM {shared.source}")


def hits(spark: SparkSession, shared: Selection, conditions: list[tuple[int, str]]) -> DataFrame:
    """(k, row): distinct rows of each statement of one group, as a struct of what they select, in one pass."""
    return _marked(spark, shared, conditions).select(F.explode(F.array_compact("_marks")).alias("k"), F.col("_row").alias("row")).distinct()


def counts(spark: SparkSession, shared: Selection, conditions: list[tuple[int, str]], alone: Callable[[int], int | None]) -> dict[int, int | None]:
    """Distinct rows of each statement of one group, by place.

    If a pass fails, conditions that do not resolve are taken out of it, and the
    rest is cut in two until a bad value costs its own statement only. What is
    left by itself is asked of `alone`.
    """
    if len(conditions) == 1:
        return {conditions[0][0]: alone(conditions[0][0])}
    try:
        found = {r["k"]: r["n"] for r in hits(spark, shared, conditions).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    except Exception:
        good = [x for x in conditions if _resolves(spark, shared, x)]
        if len(good) < len(conditions):
            parts = [good] + [[x] for x in conditions if x not in good]
        else:
            parts = [conditions[: len(conditions) // 2], conditions[len(conditions) // 2 :]]
        return {k: n for part in parts if part for k, n in counts(spark, shared, part, alone).items()}
    return {k: found.get(k, 0) for k, _ in conditions}


def _resolves(spark: SparkSession, shared: Selection, condition: tuple[int, str]) -> bool:
    try:
        _marked(spark, shared, [condition])
    except Exception:
        return False
    return True
