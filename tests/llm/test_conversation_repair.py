"""Repair of conversations against a search over whole strings of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skemara.llm import conversation_repair as cr

SHAPE = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string"


def faults(rows):
    """Fault of each (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, edits, repaired lines): every state keeps its best whole string, ways may insert at any place."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserts(front):
        for _ in range(4):
            for (state, (cost, edits, lines)) in list(front.items()):
                for i, name in names.items():
                    if (state, i) in step:
                        to, offer = step[state, i], (cost + 2, edits + "I", [*lines, f"{name}:"])
                        front[to] = min(front.get(to, offer), offer)
        return front

    front = inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, edits, lines) in front.items():
            ways = [(state, cost + 3, edits + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role[:1]) in step:
                    ways.append((step[state, role[:1]], cost + extra, edits + "K", [*lines, f"{role}:{text}"]))
                ways += [(step[state, i], cost + 2 + extra, edits + "R", [*lines, f"{name}:{text}"]) for i, name in names.items() if (state, i) in step]
            for to, *offer in ways:
                new[to] = min(new.get(to, tuple(offer)), tuple(offer))
        front = inserts(new)
    return min(front[s] for s in (0, 3) if s in front)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    cost, edits, lines = best(rows)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    """The damage that the query does, in plain Python."""
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        yield from [(conv, turn, "user" if code == 4 else role, text)] * (1 + (code == 3))


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compare(got, rows):
    want = {}
    for conv, *rest in rows:
        want.setdefault(conv, []).append(tuple(rest))
    found = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got.collect()}
    assert {k: expected(v) for k, v in want.items()} == found


def odd_rows(seed, convs=40, most=14):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "", " ", "tool", "User", "unknown"]
    texts = ["Hi.", "So what?", "no end", "", " \n", "Hi.", "Ünï!\x0b", "a. ", "x\x85", "end. "]
    return [(r.choice([c, c, c, None]) if c % 9 == 0 else c, r.choice([None, i, i, i // 2, i + r.randrange(3)]), r.choice(roles), r.choice(texts)) for c in range(convs) for i in range(r.randrange(1, most))]


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_search_over_strings(spark, seed):
    rows = odd_rows(seed)
    compare(cr.repair(spark.createDataFrame(rows, ROWS)), rows)


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(7)
    rows = [(1, t, r.choice(["user", "assistant", "system", "user"]), f"say {r.randrange(400)}{r.choice(['.', '', '?'])}") for t in range(900)] + [(2, 0, "user", "Hi.")]
    compare(cr.repair(spark.createDataFrame(rows, ROWS).repartition(7)), rows)


def test_repeats_of_one_row_and_of_one_text(spark):
    rows = [(1, None, "user", "same.")] * 300 + [(1, t, "user", "same.") for t in range(300)] + [(1, 5, "assistant", "other.")]
    compare(cr.repair(spark.createDataFrame(rows, ROWS)), rows)


def test_matrices_chain_like_one_search():
    r = random.Random(3)
    for _ in range(300):
        rows = [(r.choice("sua?") + "x", "t", r.choice([1, 1, 1, 2, 5]), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(1, 30))]
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(3))})
        parts = []
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            f = cr.Fragment("x", (0, 1, 2, 3))
            for row in rows[a:b]:
                f.row(*row)
            parts.append(f.matrix(k))
        whole = cr.Fragment("x", (0,))
        for row in rows:
            whole.row(*row)
        done = whole.done()
        cost, illegal, path = cr.chain(parts)
        audit = "".join(p["audits"][step] for p, (_, step) in zip(parts, path, strict=True)) + cr.ENDS[path[-1][1] % 4][1]
        assert (cost, illegal, audit) == (done["cost"], done["illegal"], done["audit"])


def test_memory_holds_unsettled_rows_only():
    search, settled, most = cr.Search(0, lambda edits: settled.append(edits)), [], 0
    settled = []
    search.settled = settled.append
    for k in range(5000):
        search.row("ua"[k % 2] if k % 50 else "s", k % 7 == 0, k % 3 == 0, 1)
        most = max(most, k + 1 - len(settled))
    assert most < 60


def test_damage_and_repair_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 1, None, None), (None, None, "user", None), (10**9, None, "system", "Hello."), (10**9, 3, None, "And."), (10**9, 3, "user", "And.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("audit", __import__("pyspark").sql.functions.lit("mine"))
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in cr.damage_and_repair(df).collect()}
    left = {}
    for conv, *rest in hurt(rows):
        left.setdefault(conv, []).append(tuple(rest))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(left[c]) if c in left else none for c in {r[0] for r in rows}}


def test_repaired_turns_have_the_shape_and_the_digest(spark):
    rows = odd_rows(11)
    df = spark.createDataFrame(rows, ROWS)
    lines = {}
    for r in sorted(cr.repaired_turns(df).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in cr.repair(df).collect():
        mine = lines.get(r["conv_id"], [])
        assert SHAPE.fullmatch("".join(role[0] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r["repaired_sha256"]


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert cr.repair(df).count() == cr.damage_and_repair(df).count() == cr.repaired_turns(df).count() == 0
