"""Chat formatting from each participant's side.

A dialogue is rendered once for every participant: that speaker is the
assistant, the others are named users, system turns stay system turns, and the
mask covers what the speaker said with its end mark. A rendering is cut into
chunks at turns, so that a dialogue of any length fits in rows of bounded size.
Marks within roles and texts are spelt apart, so that no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import running_sums

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NAMELESS = "unknown"
#: Characters after which a new chunk begins at the next turn.
CHUNK = 1 << 16
#: What the marks begin with, and how that is spelt within a role or text.
MARK, APART = "<|im_", "<| im_"


def harmless(text: Column) -> Column:
    """A text without marks."""
    return F.replace(text, F.lit(MARK), F.lit(APART))


def harmless_name(role: Column) -> Column:
    """A role's name in one line, without marks."""
    return F.regexp_replace(harmless(role), r"[\r\n]+", " ")


def turn_parts(role: Column, text: Column, speaker: Column) -> tuple[Column, Column]:
    """Head and body of a turn as `speaker` sees it; the body of an own turn is what the mask covers."""
    head = F.when(role == SYSTEM, F.lit(f"{OPEN}system\n")).when(role == speaker, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), harmless_name(role), F.lit("\n")))
    return head, F.concat(harmless(text), F.lit(f"{CLOSE}\n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn and speaker: conv_id, speaker, turn, role, head, body, own, start (characters of the rendering before it).

    Turns go in order of turn, role and a hash of the text, nulls first;
    repeated rows stay repeated. A null role is a participant named "unknown",
    a null text is empty, and turns without a conversation make one. A
    conversation of system turns only has no speaker and gives no row. In roles
    and texts "<|im_" is written "<| im_", and a line end in a named role is a
    space. Texts of any length stay whole, an empty table gives no row, other
    columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(NAMELESS)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    speakers = rows.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    each = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    head, body = turn_parts(F.col("role"), F.col("text"), F.col("speaker"))
    each = each.select("conv_id", "speaker", "turn", "role", F.md5(F.col("text").cast("binary")).alias("_digest"), head.alias("head"), body.alias("body"), (F.col("role") == F.col("speaker")).alias("own"))
    each = each.withColumns({"chars": F.char_length(F.concat("head", "body")).cast("long"), "one": F.lit(1).cast("long")})
    placed = running_sums(each, ["conv_id", "speaker"], ["turn", "role", "_digest"], {"start": "chars", "place": "one"}, "turns")
    return placed.select("conv_id", "speaker", "turn", "role", "head", "body", "own", "start", "place", "chars")


def render(turns: DataFrame, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """conv_id, speaker, chunk (by first character), start, text and mask of each chunk; mask is an array of (from, to) within the text.

    A chunk holds the turns that begin within its stretch of `chunk` characters. Each turn has
    characters of its own, so a chunk's turns are bounded.
    """
    placed = perspectives(turns, **columns).withColumn("chunk", F.floor(F.col("start") / chunk).cast("long"))
    grouped = placed.groupBy("conv_id", "speaker", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("place", "start", "head", "body", "own"))).alias("_turns"), F.min("start").alias("start")
    )
    own = F.filter("_turns", lambda t: t["own"])
    span = lambda t: F.struct((t["start"] + F.char_length(t["head"]) - F.col("start")).alias("from"), (t["start"] + F.char_length(t["head"]) + F.char_length(t["body"]) - F.col("start")).alias("to"))
    return grouped.select(
        "conv_id", "speaker", "chunk", "start", F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), F.transform(own, span).alias("mask"),
    )
