"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made per row. Distinct fingerprints meet in buckets that the
pigeonhole principle makes complete: with b blocks of bits, two fingerprints
within radius r agree on at least b - r blocks. In a bucket 64 fingerprints
stand as 64 vertical bit planes, one machine word each; a query is compared
with a whole block by carry-save adders, and a block is abandoned once all its
lanes exceed the radius. Buckets send on a spanning star per linked group, not
its pairs; components over these stars are found by star rounds. A similarity
of word shingles instead of a radius is the work of skemara.llm.similar, which
compares the fingerprints of candidates in the same way before it checks sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemara.llm.components import connected_components
from skemara.llm.shared import arrow_rows, checked_broadcast, join_counted, shield, stage_table

RADIUS, SHINGLE, SEED = 4, 4, 42
#: A bucket of more fingerprints is split by a finer key, and what is still larger is compared tile by tile.
TILE = 4096
#: Rows to gather before whole buckets are compared, and (query, block) pairs compared at a time.
GATHER, PAIRS = 200_000, 1 << 19
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the text's lower-cased word shingles, repeats counted, as a signed long; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    return majority(np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(count)), np.uint64, count))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(places: list[int], blocks: int) -> list[int]:
    """Masks of `blocks` blocks of bits at these places."""
    edges = [len(places) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << p for p in places[edges[i] : edges[i + 1]]) for i in range(blocks)]


def masks(count: int, radius: int = RADIUS) -> list[int]:
    """Signed bit masks of the bucket keys: blocks are made finer until a key's share of `count` is small."""
    free = 1
    while True:
        block = _blocks(list(range(64)), radius + free)
        if free == 4 or count / 2 ** sum(sorted(b.bit_count() for b in block)[:free]) <= 512:
            return [_signed(sum(c)) for c in combinations(block, free)]
        free += 1


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Signed masks of which each pair within `radius` that agrees under `mask` agrees under one: `mask` and a block of the other bits."""
    mask &= (1 << 64) - 1
    return [_signed(mask | b) for b in _blocks([p for p in range(64) if not mask >> p & 1], radius + 1)]


def _adder(a, b, c):
    """Carry-save: sum and carry of three planes."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _over(counts: list, radius: int):
    """Lanes whose bitwise counter is over the radius; the last plane says that a counter ran over."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in range(len(counts) - 2, -1, -1):
        if radius >> k & 1:
            same &= counts[k]
        else:
            more |= same & counts[k]
            same &= ~counts[k]
    return more | counts[-1]


def sliced_links(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS, asks: np.ndarray | None = None, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j of one run whose values differ in at most `radius` bits.

    `starts` has the first position of each run, and the length of `values` at
    its end. `asks` says which positions are compared with those after them in
    their run (None: all). `pairs` (query, block) pairs are compared at a time.
    """
    n = len(values)
    blocks = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, blocks * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    flip = np.where(bits.T.astype(bool), ~np.uint64(0), np.uint64(0))
    ends = np.repeat(starts[1:], np.diff(starts))
    here = np.arange(n)
    each = (ends - 1) // 64 - here // 64 + 1
    each[ends - here == 1] = 0
    if asks is not None:
        each[~asks] = 0
    upto = np.concatenate([[0], np.cumsum(each)])
    depth = max(2, int(radius).bit_length())
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + pairs, "right")) - 1)
        query = np.repeat(here[low:high], each[low:high])
        block = query // 64 + np.arange(len(query)) - np.repeat(upto[low:high] - upto[low], each[low:high])
        low = high
        if not len(query):
            continue
        first = np.clip(query + 1 - 64 * block, 0, 64)
        last = np.clip(ends[query] - 64 * block, 0, 64)
        full = ~np.uint64(0)
        alive = np.where(first > 63, np.uint64(0), full << np.minimum(first, 63).astype(np.uint64))
        alive &= np.where(last > 63, full, (ONE << np.minimum(last, 63).astype(np.uint64)) - ONE)
        counts = [np.zeros(len(query), np.uint64) for _ in range(depth + 1)]
        for p in range(0, 64, 4):
            a, b, c, d = (planes[p + k, block] ^ flip[p + k, query] for k in range(4))
            counts[0], two = _adder(counts[0], a, b)
            counts[0], more = _adder(counts[0], c, d)
            counts[1], carry = _adder(counts[1], two, more)
            for k in range(2, depth):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            counts[depth] |= carry
            if p in (12, 20, 28, 36, 48, 60):
                alive &= ~_over(counts, radius)
                going = np.flatnonzero(alive)
                if len(going) < len(alive):
                    query, block, alive, counts = query[going], block[going], alive[going], [x[going] for x in counts]
                if not len(query):
                    break
        if len(query):
            row, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[row], block[row] * 64 + lane


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: each position's label is a position with a smaller or equal one."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _stars(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning stars of the linked groups in the sorted, whole buckets of `frame`."""
    keys = frame[["band", "key", "tile"]].to_numpy()
    values = frame["fp"].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(values)]])
    lone = np.repeat(np.diff(starts) == 1, np.diff(starts))
    values, starts = values[~lone], np.concatenate([[0], np.cumsum(np.diff(starts)[np.diff(starts) > 1])])
    labels = np.arange(len(values))
    if len(values):
        for a, b in sliced_links(values, starts, radius):
            labels = _join_labels(labels, a, b)
    member = np.flatnonzero(labels != np.arange(len(values)))
    return pd.DataFrame({"a": values[member], "b": values[labels[member]]})


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): stars that connect the fingerprints of column fp within `radius`; all links' components, no more."""
    keys = masks(distinct.count(), radius)
    one = F.lit(0).cast("long")
    rows = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in keys))).alias("band", "key"))
    sizes = lambda rows, label: stage_table(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile), label)
    large = sizes(rows, "large")
    if large.limit(1).count():
        # A large bucket is split by a finer key first: any two of its members within the radius agree on one block more.
        split = F.array(*(F.array(*(F.lit(x) for x in finer(m, radius))) for m in keys))
        more = rows.join(checked_broadcast(large.drop("n")), ["band", "key"], "left_semi").select("fp", "band", F.posexplode(F.element_at(split, F.col("band") + 1)).alias("sub", "mask"))
        more = more.select("fp", (len(keys) + F.col("band") * (radius + 1) + F.col("sub")).alias("band"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        # What is large still is cut into parts by hash; each pair of parts is a tile of its own, so any two members meet in one.
        tiles = sizes(more, "tiled").select("band", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
        more = more.join(checked_broadcast(tiles), ["band", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        part = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(part, o).cast("long") * F.col("tiles") + F.greatest(part, o))
        more = more.select("fp", "band", "key", F.explode(F.when(F.col("tiles") == 1, F.array(one)).otherwise(every)).alias("tile"))
        rows = rows.join(checked_broadcast(large.drop("n")), ["band", "key"], "left_anti").withColumn("tile", one).unionByName(more)
    else:
        rows = rows.withColumn("tile", one)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < GATHER:
                continue
            frame = pd.concat(held, ignore_index=True)
            last = frame.iloc[-1]
            open_run = ((frame["band"] == last["band"]) & (frame["key"] == last["key"]) & (frame["tile"] == last["tile"])).to_numpy()
            held = [frame[open_run]]
            yield _stars(frame[~open_run], radius)
        if held:
            yield _stars(pd.concat(held, ignore_index=True), radius)

    dealt = rows.repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile", "fp")
    return dealt.mapInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, radius: int) -> DataFrame:
    """One row per row of `docs`: id, key (digest of the text), fp, and of its component the smallest id and the key of the row that stays."""
    spark = docs.sparkSession

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "key": batch["key"], "fp": [fingerprint(t, shingle, seed) for t in batch["_text"]]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    with arrow_rows(spark, 256):
        made = docs.select(F.col(id_col).cast("string").alias("_id"), F.md5(text.cast("binary")).alias("key"), text.alias("_text")).mapInPandas(prints, "_id string, key string, fp long")
        made = stage_table(made.select(F.col("_id").cast(docs.schema[id_col].dataType).alias("id"), "key", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    distinct = stage_table(made.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("_n")), "distinct")
    with arrow_rows(spark, 50_000):
        stars = stage_table(near_links(distinct, radius).distinct(), "stars")
    labels = connected_components(stars)
    distinct = stage_table(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    best = distinct.groupBy("label").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("_c"))
    of = join_counted(distinct, best, "label", "_c").select("fp", F.col("best.id").alias("component_id"), F.col("best.key").alias("stays"), "_n")
    return join_counted(made, stage_table(of, "components"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits) and component_id (smallest id that links reach, itself included).

    Null and empty texts share the fingerprint zero; texts of any length are
    read whole. Rows without an id have a component too; it is null if no row
    of it has an id. Repeated rows stay repeated. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _grouped(docs, id_col, text_col, shingle, seed, radius).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The rows of `docs` that stay: of each component the row with the smallest id, of equal ids that with the least digest of its text.

    Links are fingerprints within `radius`; with `similarity`, a fraction, they
    are sets of word shingles of at least that Jaccard similarity. Rows are
    told apart by id and text: rows that repeat both stay or go together, and
    rows that repeat an id with an unlike text are judged on their own. A row
    without an id stays only if its component has none with one.
    """
    if similarity:
        from skemara.llm.similar import grouped

        found = grouped(docs, id_col, text_col, shingle, seed, similarity)
    else:
        found = _grouped(docs, id_col, text_col, shingle, seed, radius)
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("stays"))
    gone = stage_table(found.filter(~stays).select(F.col("id").alias("_gone"), F.col("key").alias("_key")).distinct(), "gone")
    own, back = shield(docs, ("_gone", "_key"))
    mine = {v: k for k, v in back.items()}
    digest = F.md5(F.coalesce(F.col(mine.get(text_col, text_col)), F.lit("")).cast("binary"))
    same = F.col(mine.get(id_col, id_col)).eqNullSafe(F.col("_gone")) & (digest == F.col("_key"))
    return own.join(checked_broadcast(gone), same, "left_anti").withColumnsRenamed(back)
