"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation's rows, by turn, become one of the role patterns (s?(ua)+)? at
the least cost of edits: Keep, Rerole, Delete, Insert. The search keeps the
best way into each of four states. Ways are a tree of backpointers with counted
references: when all survivors hang below one node, the edits down to it are
settled, are written out, and their rows and nodes are let go, so memory holds
the unsettled rows only. Of equally cheap ways the one with the least string of
edits wins: the survivors' order by their whole unsettled strings is carried
along, so a tie costs one comparison however long the strings are.

Rows lie in range partitions by (conversation, turn), and a conversation may
cross many of them: a partition's first and last conversations give a matrix
(state before, state after) of costs, orders and edits instead, these small
matrices are chained, and the chosen edits are put together. So the search of a
conversation of any length is shared by tasks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import arrow_rows, checked_broadcast, stage_table

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet; s; u wants its a; a whole pair. What a role's initial leads to, and the role that an edit writes.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
WRITES = ["user", "user", "assistant", "user"]
STATES, LEGAL = range(4), {"su", "ua", "au"}
INF = 1 << 60
#: A survivor of state t does whatever one of state s still could for this much more, at most: MORE[t][s].
#: It inserts up to s, and deletes a system row (that only state 0 can keep) for three.
MORE = [[0, 0, 2, 0], [4, 0, 2, 4], [5, 2, 0, 2], [3, 0, 2, 0]]


def _moves(initial: str, forced: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row: (state before, cost, edits), the cheapest and of these the least, inserts before the row included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        for many in range(3):
            at = start
            for _ in range(many):
                at = STEP[at][WRITES[at][0]]
            ways = [(at, DELETE, "D")]
            if not forced:
                extra = TRUNCATED if truncated else 0
                ways.append((STEP[at][WRITES[at][0]], REROLE + extra, "R"))
                if initial in STEP[at]:
                    ways.append((STEP[at][initial], KEEP + extra, "K"))
            for end, cost, op in ways:
                offer = (many * INSERT + cost, "I" * many + op)
                best[start, end] = min(best.get((start, end), offer), offer)
    return [[(s, *best[s, t]) for s in STATES if (s, t) in best] for t in STATES]


MOVES = {(i, f, t): _moves(i, f, t) for i in ("s", "u", "a", "") for f in (False, True) for t in (False, True)}
#: What is inserted after the last row: cost and edits by state.
ENDS = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


class Node:
    """A step of some survivor's way: the edits of one row, after those of the parent."""

    __slots__ = ("parent", "edits", "refs", "kids")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, []


def _release(node: Node) -> None:
    """Let go of a node without references, and of its ancestors that lose their last one."""
    while node.refs == 0 and node.parent is not None:
        parent = node.parent
        parent.kids.remove(node)
        parent.refs -= 1
        node.parent = None
        node = parent


class Search:
    """Survivors from one state before the first row; `settled` is called with the edits of each row, in order."""

    def __init__(self, entry: int, settled):
        self.root = Node(None, "")
        self.settled = settled
        #: By state: cost, order among the survivors' strings, and the way's last node.
        self.live: dict[int, tuple[int, int, Node]] = {entry: (0, 0, self.root)}
        self.root.refs = 1

    def row(self, initial: str, forced: bool, truncated: bool, copies: int) -> None:
        """One row and `copies` - 1 repeats of it, which are deleted."""
        moves = MOVES[initial if initial in ("s", "u", "a") else "", forced, truncated]
        rest, live = "D" * (copies - 1), self.live
        found = []
        for t in STATES:
            best = None
            for s, cost, edits in moves[t]:
                if s in live:
                    c, order, node = live[s]
                    # Two survivors' strings differ before this row, so their order decides a tie.
                    offer = (c + cost, order, edits, node)
                    if best is None or offer[:2] < best[:2]:
                        best = offer
            if best:
                found.append((t, *best))
        least = {t: f[0] for t, *f in found}
        found = [f for f in found if all(least[t] + MORE[t][f[0]] >= f[1] for t in least)]
        ranked = {f[0]: k for k, f in enumerate(sorted(found, key=lambda f: (f[2], f[3])))}
        old = [node for _, _, node in live.values()]
        self.live = {}
        for t, cost, _, edits, node in found:
            child = Node(node, edits + rest)
            node.refs += 1
            node.kids.append(child)
            child.refs = 1
            self.live[t] = (cost + DELETE * (copies - 1), ranked[t], child)
        for node in old:
            node.refs -= 1
            _release(node)
        # All survivors hang below the root's only child: its edits are settled.
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.settled(self.root.edits)

    def tail(self, state: int) -> list[str]:
        """Edits of the unsettled rows on the way to `state`."""
        out, node = [], self.live[state][2]
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]

    def end(self) -> tuple[int, int]:
        """Cost of the cheapest whole way, least in edits, and the state it comes from."""
        cost, _, state = min((c + ENDS[s][0], order, s) for s, (c, order, _) in self.live.items())
        return cost, state


def replay(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """What one row's edits write from `state` on, and the state after them."""
    lines = []
    for op in edits:
        if op == "D":
            continue
        name = role if op == "K" else WRITES[state]
        lines.append((name, "" if op == "I" else text))
        state = STEP[state][name[0]]
    return state, lines


class Writer:
    """Digest of the repaired lines, row by row."""

    def __init__(self):
        self.digest, self.state, self.first = hashlib.sha256(), 0, True

    def add(self, edits: str, role: str = "", text: str = "") -> None:
        self.state, lines = replay(self.state, edits, role, text)
        for name, said in lines:
            self.digest.update(("" if self.first else "\n").encode() + f"{name}:{said}".encode())
            self.first = False


class Fragment:
    """The rows of one conversation within one partition."""

    def __init__(self, key: str, entries: tuple[int, ...]):
        self.key, self.edits = key, {e: [] for e in entries}
        self.writer, self.waiting = Writer(), deque()
        self.whole = entries == (0,)
        self.searches = {e: Search(e, self._settle if self.whole else self.edits[e].append) for e in entries}
        self.illegal, self.first, self.last = 0, None, None

    def _settle(self, edits: str) -> None:
        self.edits[0].append(edits)
        self.writer.add(edits, *self.waiting.popleft())

    def row(self, role: str, text: str, copies: int, forced: bool, truncated: bool) -> None:
        initial = role[:1]
        self.illegal += copies - 1
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if self.whole:
            self.waiting.append((role, text))
        for search in self.searches.values():
            search.row(initial, forced, truncated, copies)

    def done(self) -> dict:
        """The result of a conversation that this partition holds whole."""
        search = self.searches[0]
        cost, state = search.end()
        for edits in search.tail(state):
            self._settle(edits)
        self.writer.add(ENDS[state][1])
        return {"key": self.key, "cost": cost, "illegal": self.illegal, "audit": "".join(self.edits[0]) + ENDS[state][1], "repaired_sha256": self.writer.digest.hexdigest()}

    def matrix(self, part: int) -> dict:
        """Costs, orders and edits by state before and state after, for a conversation that may go on in other partitions."""
        costs, orders, audits = [-1] * 16, [-1] * 16, [None] * 16
        for e, search in self.searches.items():
            for s, (cost, order, _) in search.live.items():
                costs[4 * e + s], orders[4 * e + s] = cost, order
                audits[4 * e + s] = "".join(self.edits[e]) + "".join(search.tail(s))
        return {"key": self.key, "part": part, "illegal": self.illegal, "first": self.first, "last": self.last, "costs": costs, "orders": orders, "audits": audits}


FOUND = "key string, part int, cost long, illegal long, first string, last string, costs array<long>, orders array<int>, audits array<string>, audit string, repaired_sha256 string"


_SHAPE = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}[t]) for n, t in (f.split() for f in FOUND.split(", "))])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, now, begun = TaskContext.get().partitionId(), None, False
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("_key", "role", "text", "_copies", "_forced", "_truncated"))
        for key, role, text, copies, forced, truncated in zip(*columns, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    # The partition's first conversation may have begun before it.
                    out.append(now.done() if begun else now.matrix(part))
                    begun = True
                now = Fragment(key, (0,) if now is not None else tuple(STATES))
            now.row(role, text, copies, forced, truncated)
        yield pa.RecordBatch.from_pylist(out, _SHAPE)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.matrix(part)], _SHAPE)


def chain(fragments: list[dict]) -> tuple[int, int, list[tuple[int, int]]]:
    """Cost, illegal pairs and (part, entry * 4 + exit) of each fragment of one conversation, fragments in order."""
    ways: dict[int, tuple[int, int, list]] = {0: (0, 0, [])}
    illegal, last = 0, None
    for f in fragments:
        found = {}
        for t in STATES:
            offers = [(c + f["costs"][4 * s + t], order, f["orders"][4 * s + t], s) for s, (c, order, _) in ways.items() if f["costs"][4 * s + t] >= 0]
            if offers:
                found[t] = min(offers)
        ranked = {t: k for k, t in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
        ways = {t: (o[0], ranked[t], (ways[o[3]][2], (f["part"], 4 * o[3] + t))) for t, o in found.items()}
        illegal += f["illegal"] + (last is not None and last + f["first"] not in LEGAL)
        last = f["last"]
    cost, _, state = min((c + ENDS[s][0], order, s) for s, (c, order, _) in ways.items())
    path, node = [], ways[state][2]
    while node:
        node, step = node
        path.append(step)
    return cost, illegal, path[::-1]


def _key(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _order() -> list[Column]:
    return [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def flag_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their faults, equal rows as one with `_copies`, as a scratch table.

    `_blank`: no character but white space; `_duplicate`: even the first copy
    has role and text of an earlier row; `_truncated`: the last character but
    white space is no end of a sentence; only a row's first fault is set.
    First turns are taken by an aggregate and joined back for repeated rows alone.
    """
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    one = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_copies")).withColumns({"_key": _key(F.col("conv_id")), "_digest": F.sha2(F.concat("role", F.lit("\n"), "text"), 256)})
    one = stage_table(one, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = one.groupBy("_key", "_digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = one.join(checked_broadcast(stage_table(firsts, "first-turns")), ["_key", "_digest"], "left")
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    blank = end == ""
    again = ~blank & F.coalesce(~F.col("_first.at").eqNullSafe(F.col("turn")) & F.col("_first").isNotNull(), F.lit(False))
    out = joined.withColumns({"_blank": blank, "_duplicate": again, "_truncated": ~blank & ~again & ~end.isin(".", "!", "?")})
    return stage_table(out.drop("_first", "_digest"), "flagged-turns")


def _sorted(flagged: DataFrame) -> DataFrame:
    thin = flagged.withColumn("_forced", F.col("_blank") | F.col("_duplicate")).select("_key", "turn", "role", "text", "_copies", "_forced", "_truncated")
    return thin.repartitionByRange(*_order()).sortWithinPartitions(*_order())


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Writer, list]]:
    """For each row, in order: key, the conversation's writer, and the lines written for it; edits come before a conversation's rows."""
    key, writer, edits, at, end = None, None, [], 0, 0
    for batch in batches:
        for k, kind, role, text, copies, piece in batch[["_key", "_kind", "role", "text", "_copies", "_piece"]].itertuples(index=False, name=None):
            if k != key:
                if key is not None:
                    yield key, writer, "".join(edits)[at:], "", ""
                key, writer, edits, at = k, Writer(), [], 0
            if kind == 0:
                edits.append(piece)
                continue
            if len(edits) > 1:
                edits = ["".join(edits)]
            whole, end = edits[0], at
            for _ in range(copies):
                while whole[end] == "I":
                    end += 1
                end += 1
            yield key, writer, whole[at:end], role, text
            at = end
    if key is not None:
        yield key, writer, "".join(edits)[at:], "", ""


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, last = [], None
    for key, writer, edits, role, text in _replayed(batches):
        if last is not None and key != last[0]:
            out.append((last[0], last[1].digest.hexdigest()))
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
                out = []
        writer.add(edits, role, text)
        last = (key, writer)
    if last is not None:
        out.append((last[0], last[1].digest.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "repaired_sha256"])


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, last, place, state = [], None, 0, 0
    for key, _, edits, role, text in _replayed(batches):
        if key != last:
            last, place, state = key, 0, 0
        state, lines = replay(state, edits, role, text)
        for name, said in lines:
            out.append((key, place, name, said))
            place += 1
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=["_key", "place", "role", "text"])
            out = []
    yield pd.DataFrame(out, columns=["_key", "place", "role", "text"])


def _with_edits(flagged: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows and pieces of edits (_key, _part, _piece) of the same conversations, each one's pieces before its rows, in one task each."""
    rows = flagged.select("_key", F.lit(1).alias("_kind"), F.lit(0).alias("_part"), "turn", "role", "text", "_copies", F.lit("").alias("_piece"))
    kind = dict(flagged.dtypes)["turn"]
    heads = pieces.select("_key", F.lit(0).alias("_kind"), "_part", F.lit(None).cast(kind).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("_copies"), "_piece")
    order = [F.col("_key"), F.col("_kind"), F.col("_part"), *_order()[1:]]
    return rows.unionByName(heads).repartition("_key").sortWithinPartitions(*order)


def repair(rows: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """A row per conversation of `rows` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, then role and text; equal rows lie side
    by side. A null role or text is one space; rows without conv_id are one
    conversation; other columns are ignored; an empty table gives no row. Texts
    of any length are whole. Conversations of any length: the search is shared
    by tasks. Only the digest of one conversation, which SHA-256 allows in
    order alone, is taken in one task, a row at a time.
    """
    spark = rows.sparkSession
    flagged = flag_rows(rows) if flagged is None else flagged
    n, later = F.col("_copies"), F.when(F.col("_duplicate"), F.col("_copies")).otherwise(F.col("_copies") - 1)
    turns = flagged.select("_key", "turn").distinct().groupBy("_key").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))).cast("long").alias("gaps"))
    counts = flagged.groupBy("_key").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum(F.when(F.col("_blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("_blank"), 0).otherwise(later)).alias("duplicate"),
        F.sum(F.col("_truncated").cast("long")).alias("truncated"),
    )
    with arrow_rows(spark, 1024):
        found = stage_table(_sorted(flagged).mapInArrow(_search, FOUND), "repairs")
    # Two rows per partition at most; their edits stay in the table.
    edge: dict[str, list] = defaultdict(list)
    for r in found.filter("part IS NOT NULL").select("key", "part", "illegal", "first", "last", "costs", "orders").orderBy("part").collect():
        edge[r["key"]].append(r.asDict())
    chained = {k: chain(v) for k, v in edge.items()}
    sums = spark.createDataFrame([(k, c, i) for k, (c, i, _) in chained.items()], "key string, cost long, illegal long")
    steps = spark.createDataFrame([(k, p, s) for k, (_, _, path) in chained.items() for p, s in path], "key string, part int, step int")
    pieces = stage_table(found.join(checked_broadcast(steps), ["key", "part"]).select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.get("audits", F.col("step")).alias("_piece")), "repair-pieces")
    ends = _ends(spark, chained)
    pieces = pieces.unionByName(ends)
    mine = flagged.join(checked_broadcast(sums.select(F.col("key").alias("_key"))), "_key", "left_semi")
    with arrow_rows(spark, 1024):
        digests = stage_table(_with_edits(mine, pieces).mapInPandas(_digests, "key string, repaired_sha256 string"), "repair-digests")
    audits = pieces.groupBy(F.col("_key").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_piece"))), lambda x: x["_piece"]), "").alias("audit"))
    crossing = sums.join(audits, "key").join(digests, "key").select("key", "cost", "illegal", "audit", "repaired_sha256")
    every = found.filter("part IS NULL").select("key", "cost", "illegal", "audit", "repaired_sha256").unionByName(crossing)
    joined = every.withColumnRenamed("key", "_key").join(counts, "_key").join(turns, "_key")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _ends(spark, chained: dict) -> DataFrame:
    """The inserts after the last row of each chained conversation, as pieces behind all others."""
    rows = [(k, 1 << 30, ENDS[path[-1][1] % 4][1]) for k, (_, _, path) in chained.items()]
    return spark.createDataFrame(rows, "_key string, _part int, _piece string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text. Odd rows as in repair."""
    flagged = flag_rows(rows)
    audits = repair(rows, flagged)
    pieces = audits.select(_key(F.col("conv_id")).alias("_key"), F.lit(0).alias("_part"), F.col("audit").alias("_piece"))
    ids = flagged.select("_key", "conv_id").distinct()
    with arrow_rows(rows.sparkSession, 1024):
        made = stage_table(_with_edits(flagged, pieces).mapInPandas(_turns, "_key string, place long, role string, text string"), "repaired-turns")
    return made.join(ids, "_key").select("conv_id", "place", "role", "text")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows that a fixed rule by crc32 of conv_id and turn drops, empties, cuts the ends of sentences of, repeats or makes the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code, role, text = F.crc32(key) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = conversations.select(
        "conv_id", "turn", code.alias("_code"), F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    twice = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.filter("_code <> 0").select("conv_id", "turn", "role", "text", twice.alias("_copy")).drop("_copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Every conversation's repair after damage; one that lost all its rows has zeros, no edits and the digest of nothing."""
    found = repair(damage(conversations)).withColumn("_key", _key(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("_key", _key(F.col("conv_id")))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    full = every.join(found, "_key", "left").withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})
    return full.select("conv_id", *zero, "audit", "repaired_sha256")
