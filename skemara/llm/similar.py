"""Near-duplicates by Jaccard similarity of word shingles: complete candidates by a salted prefix filter, bit-sliced comparison, exact checks, components.

Two texts with a similarity of 4/5 share one of the first n - ceil(4n/5) + 1 of
their n shingles in any order that is the same for all texts. The order here
puts shingles last that a sample shows to be frequent, so that few texts meet
at a shingle; what the sample misses costs time, not results. Texts that share
such a shingle are first compared with one hub per part of at most PART of
them, and the hubs with each other's first. Then those outside the largest
component at a shingle are compared with all others there: their SimHash
fingerprints bit-sliced, 64 to a word, with a radius that similar sets keep;
then bitmaps of their prefixes. Where very many would have to be compared, they
meet at pairs of shingles instead, which prefixes that are one longer make
complete, so rows grow with the texts and not with the square of a group. Both happen within a task, which sends on only
the pairs that may be similar; these are checked exactly. A text is never
compared with all of a group of copies of it that hang together, and no pairs
of a group are sent that the comparison rejects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemara.llm.components import connected_components
from skemara.llm.shared import arrow_rows, checked_broadcast, join_counted, stage_table
from skemara.llm.simhash import majority, sliced_links

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Fingerprints of sets of this similarity differ in about ten bits. They differ in more than RADIUS with a chance of four in a hundred
#: million at the similarity itself (sets of 15 shingles and more; one in a million for sets of 5), and of less above it.
RADIUS = 28
#: Texts that meet one hub.
PART = 1024
#: Texts and shingles of one side of a comparison within a task, and (query, block) pairs compared at a time.
TILE, SHINGLES, PAIRS = 4096, 2_000_000, 1 << 13
#: Members of a set per word of 64 bits of its bitmap, the most words of a bitmap, and words looked at at a time.
MEMBERS, WORDS, LOOK = 32, 2048, 1 << 22
RUN = ["cell", "part", "turn"]
#: One text in SAMPLE shows which shingles are frequent: those in OFTEN sampled texts, the first LISTED of them.
SAMPLE, OFTEN, LISTED = 8, 2, 500_000


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's distinct lower-cased word shingles, ascending; a text with fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(count)), np.uint64, count).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, more: int = 0) -> np.ndarray:
    """The hashes of which a similar text must share one, and with `more` further ones 1 + more (if it shares as many at all): rare ones first, by their count in the list `common`, then by value."""
    n = len(hashes)
    often = np.zeros(n, np.int64)
    if len(common):
        spot = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[spot] == hashes, counts[spot], 0)
    return hashes[np.lexsort((hashes, often))[: n - -(-OVER * n // UNDER) + 1 + more]]


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parities of the members that fall to each bit; the words are a power of two, so a wide bitmap folds onto a narrow one."""
    words = 1 << max(0, min(WORDS, -(-len(members) // MEMBERS)) - 1).bit_length()
    odd = np.bincount(members & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(words: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps a and b differ, the wider one folded; bitmap k is words[at[k] : at[k] + size[k]]. Their sets differ in as many members at least."""
    out = np.zeros(len(a), np.int64)
    sizes = size[a] * (WORDS + 1) + size[b]
    for kind in np.unique(sizes):
        both = divmod(int(kind), WORDS + 1)
        every, narrow = np.flatnonzero(sizes == kind), min(both)
        for low in range(0, len(every), max(1, LOOK // max(both))):
            pick = every[low : low + max(1, LOOK // max(both))]
            sides = [np.bitwise_xor.reduce(words[at[x[pick], None] + np.arange(w)].reshape(len(pick), w // narrow, narrow), axis=1) for x, w in zip((a, b), both, strict=True)]
            out[pick] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many members two similar sets of n and m members share at least."""
    return -(-OVER * (n + m) // (OVER + UNDER))


def _near(frame: pd.DataFrame, bits: list[np.ndarray], root: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of an asking and an own row of each run whose fingerprints, sizes and bitmaps can be those of similar sets, and whose labels have another root."""
    keys = frame[RUN].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(frame)]])
    n, mine = frame["n"].to_numpy(), frame["mine"].to_numpy()
    size = np.array([len(x) for x in bits])
    words, at = np.concatenate(bits).view(np.uint64), np.cumsum(size) - size
    for i, j in sliced_links(frame["fp"].to_numpy(), starts, RADIUS, frame["asks"].to_numpy(), PAIRS):
        keep = (root[label[i]] != root[label[j]]) & (mine[i] | mine[j]) & (np.minimum(n[i], n[j]) * UNDER >= np.maximum(n[i], n[j]) * OVER)
        i, j = i[keep], j[keep]
        near = bits_apart(words, at, size, i, j) <= n[i] + n[j] - 2 * least_shared(n[i], n[j])
        yield i[near], j[near]


def _left(frame: pd.DataFrame) -> pd.DataFrame:
    """(cell, sid) of the rows that are in a pair of _near."""
    frame = frame.sort_values([*RUN, "asks"], ascending=[True, True, True, False], kind="stable")
    label = np.unique(frame["label"].to_numpy(), return_inverse=True)[1]
    hit = np.zeros(len(frame), bool)
    for i, j in _near(frame, frame["bits"].to_list(), np.arange(label.max() + 1), label):
        hit[i] = hit[j] = True
    return frame.loc[hit, ["cell", "sid"]].drop_duplicates()


def _forest(frame: pd.DataFrame, shingle: int, seed: int) -> pd.DataFrame:
    """(a, b): links of similar sets, of an asking and an own row of each run, that connect all labels which such links connect."""
    frame = frame.sort_values([*RUN, "asks"], ascending=[True, True, True, False], kind="stable")
    sid, n = frame["sid"].to_numpy(), frame["n"].to_numpy()
    label = np.unique(frame["label"].to_numpy(), return_inverse=True)[1]
    sets = [shingles(t, shingle, seed) for t in frame["_text"]]
    # Members as small numbers: a set is looked up in a table that has another's marked.
    ends = np.cumsum(n)
    members = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked, root, found = np.zeros(members.max() + 1, bool), np.arange(label.max() + 1), []
    for i, j in _near(frame, [bitmap(x) for x in sets], root, label):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for x, others in zip(i[np.concatenate([[0], cuts])] if len(i) else [], np.split(j, cuts), strict=False):
            others = others[root[label[others]] != root[label[x]]]
            if not len(others):
                continue
            own = members[ends[x] - n[x] : ends[x]]
            marked[own] = True
            upto = np.cumsum(n[others])
            flat = np.repeat(ends[others] - upto, n[others]) + np.arange(upto[-1])
            shared = np.add.reduceat(marked[members[flat]].astype(np.int64), upto - n[others])
            marked[own] = False
            for y in others[shared >= least_shared(n[x], n[others])]:
                old, new = sorted((root[label[x]], root[label[y]]))
                if old != new:
                    root[root == new] = old
                    found.append((max(sid[x], sid[y]), min(sid[x], sid[y])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _by_runs(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`work` over whole runs, which arrive in order."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(int(x["n"].sum()) for x in held) < SHINGLES:
            continue
        frame = pd.concat(held, ignore_index=True)
        going = (frame[RUN] == frame[RUN].iloc[-1]).all(axis=1).to_numpy()
        held = [frame[going]]
        if not going.all():
            yield work(frame[~going])
    if held and sum(map(len, held)):
        yield work(pd.concat(held, ignore_index=True))


def _deal(cells: DataFrame) -> DataFrame:
    """The rows of cells, (cell, sid, asks, n, ...), in runs.

    The rows of a cell lie in parts, and those who ask in turns; each part meets
    each turn in a run of its own, so no task holds more than two tiles.
    """
    asked = lambda value: F.sum(F.when(F.col("asks"), value).otherwise(0))
    tiles = lambda count, members: F.greatest(F.lit(1), F.ceil(count / TILE), F.ceil(members / SHINGLES)).cast("int")
    sizes = cells.groupBy("cell").agg(tiles(F.count(F.lit(1)), F.sum("n")).alias("parts"), tiles(asked(1), asked(F.col("n"))).alias("turns"), F.count(F.lit(1)).alias("_n"))
    met = join_counted(cells, stage_table(sizes, "cell-sizes"), "cell")
    met = met.withColumns({"own": F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"), "its_turn": F.pmod(F.xxhash64("sid", F.lit(1)), F.col("turns")).cast("int")})
    run = lambda part, turn, asks, mine: F.struct(part.alias("part"), turn.alias("turn"), asks.alias("asks"), mine.alias("mine"))
    own, turn, no, yes = F.col("own"), F.col("its_turn"), F.lit(False), F.lit(True)
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: run(p, turn, yes, p == own))
    owned = F.transform(F.filter(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: ~F.col("asks") | (t != turn)), lambda t: run(own, t, no, yes))
    rest = [c for c in cells.columns if c != "asks"]
    return met.select(*rest, F.explode(F.when(F.col("asks"), F.concat(asking, owned)).otherwise(owned)).alias("x")).select(*rest, "x.*").repartition(*RUN).sortWithinPartitions(*RUN)


def _finer(cells: DataFrame, rows: DataFrame, largest: DataFrame, made: DataFrame) -> DataFrame:
    """`cells` with those in which more than a tile asks replaced by smaller ones.

    Similar sets of two members and more share two of their prefixes' tokens if
    these are one token longer, and one of a single member hangs together with
    its likes already. So the rows of a large cell meet at pairs of tokens: each
    is in as many cells as its prefix has tokens, whatever the cell's size, and
    again those outside a cell's largest component ask.
    """
    large = stage_table(cells.groupBy("cell").agg(F.count_if("asks").alias("c")).filter(F.col("c") > TILE).select("cell"), "large-cells")
    if not large.limit(1).count():
        return cells
    tokens = largest.join(checked_broadcast(large), "cell", "left_semi").select("token")
    mine = rows.join(checked_broadcast(stage_table(tokens, "large-tokens")), "token").select("token", "sid", "n", "fp", "label")
    both = mine.join(made.select(F.col("row").alias("sid"), "prefix"), "sid").withColumn("other", F.explode("prefix")).filter("other <> token")
    pairs = stage_table(both.select(F.xxhash64(F.least("token", "other"), F.greatest("token", "other")).alias("cell"), "sid", "n", "fp", "label").distinct(), "token-pairs")
    main = pairs.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", "label")).alias("_main"), F.count(F.lit(1)).alias("labels"), F.sum("count").alias("_n")).filter("labels > 1").drop("labels")
    split = join_counted(pairs, stage_table(main, "pair-cells"), "cell").select("cell", "sid", "n", "fp", "label", (F.col("label") != F.col("_main")).alias("asks"))
    return stage_table(cells.join(checked_broadcast(large), "cell", "left_anti").unionByName(split), "finer-cells")


def _frequent(texts: DataFrame, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.int64), *(shingles(t, shingle, seed) for t in batch["_text"])])})

    sample = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0).select("_text").mapInPandas(explode, "h long")
    found = sample.groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LISTED).toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "count"))
    order = np.argsort(h)
    return h[order], n[order]


def _alike(na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(na, nb) * UNDER >= F.greatest(na, nb) * OVER


def _counted(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """`side` (a row per b) with how many pairs each b, a hub, has."""
    return side.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")), "b")


def _may_meet(pairs: DataFrame, tokens_of: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by the number of tokens that their prefixes share.

    Of the set whose prefix ends first, no member of the prefix is in the other
    set beyond the other's prefix. So the sets meet in no more than the shared
    tokens and what one set has after its prefix, ceil(4n/5) - 1; similar sets
    meet in 4/9 of both sizes.
    """
    side = {c: tokens_of.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab"}
    both = join_counted(pairs.join(side["a"], "a"), _counted(pairs, side["b"]), "b")
    after = F.ceil(F.greatest("na", "nb") * OVER / UNDER) - 1
    return both.filter((F.size(F.array_intersect("ta", "tb")) + after) * (OVER + UNDER) >= (F.col("na") + F.col("nb")) * OVER).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = {c: sets.select(F.col("sid").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab"}
    both = join_counted(pairs.join(side["a"], "a"), _counted(pairs, side["b"]), "b")
    met = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("met"), (F.size("ha") + F.size("hb")).alias("total"))
    return stage_table(met.filter(F.col("met") * UNDER >= (F.col("total") - F.col("met")) * OVER).select("a", "b"), label)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, similarity: tuple[int, int] = (OVER, UNDER)) -> DataFrame:
    """One row per row of `docs`: id, key (digest of the text), and of its component the smallest id (component_id) and the key of the row that stays."""
    if similarity != (OVER, UNDER):
        raise ValueError(f"the prefixes, bounds and radius are those of {OVER}/{UNDER}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), text.alias("_text"), F.md5(text.cast("binary")).alias("key"))

    with arrow_rows(spark, 256):
        common, counts = _frequent(texts, shingle, seed)
        listed = spark.sparkContext.broadcast((common, counts))

        def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            common, counts = listed.value
            for batch in batches:
                sets = [shingles(t, shingle, seed) for t in batch["_text"]]
                firsts = [prefix(s, common, counts, 1) for s in sets]
                yield pd.DataFrame({"_id": batch["_id"], "key": batch["key"], "n": [len(s) for s in sets], "fp": [majority(s.view(np.uint64)) for s in sets], "prefix": firsts, "bits": [bitmap(s) for s in sets]})

        made = texts.mapInPandas(prefixes, "_id string, key string, n long, fp long, prefix array<long>, bits array<long>")
        made = stage_table(made.select(F.col("_id").cast(kind).alias("id"), "key", "n", "fp", "prefix", "bits", F.monotonically_increasing_id().alias("row")), "prefixes")
    # Equal texts are one text, named by its first row.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    units = stage_table(made.groupBy("key").agg(F.min("row").alias("sid"), first.alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.count(F.lit(1)).alias("_n")), "units")
    first = F.slice("prefix", 1, (F.col("n") - F.ceil(F.col("n") * OVER / UNDER) + 1).cast("int"))
    tokens = made.select("row", F.explode(first).alias("token"))
    often = lambda df: df.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = stage_table(join_counted(tokens, stage_table(often(tokens), "token-counts"), "token"), "meeting")
    named = made.select("row", "key").join(units.select("key", "sid", "n", "fp"), "key").select("row", "sid", "n", "fp")
    rows = stage_table(rows.join(named, "row").select("token", "sid", "n", "fp").distinct(), "meeting-units")
    rows = join_counted(rows, stage_table(often(rows).withColumn("met", F.col("_n")), "token-counts"), "token")
    rows = stage_table(rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.ceil(F.col("met") / PART))).select("token", "sid", "n", "fp", "met", "salt"), "members")
    tokens_of = stage_table(rows.groupBy("sid", "n").agg(F.collect_list("token").alias("tokens")), "tokens")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sid": batch["sid"], "hashes": [shingles(t, shingle, seed) for t in batch["_text"]]})

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar; only those that _may_meet are fetched and compared."""
        pairs = stage_table(_may_meet(pairs, tokens_of), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(units.select("sid", "key"), "sid")
        with arrow_rows(spark, 256):
            sets = texts.select("key", "_text").join(checked_broadcast(stage_table(wanted, "wanted")), "key").select("sid", "_text").mapInPandas(hashed, "sid long, hashes array<long>")
            sets = stage_table(sets, "sets").dropDuplicates(["sid"])
        return _similar(pairs, sets, "links")

    hubs = stage_table(rows.groupBy("token", "salt").agg(F.min_by(F.struct("sid", "n", "fp"), "sid").alias("hub")), "hubs")
    tops = hubs.groupBy("token").agg(F.min("hub").alias("hub"))
    stars = rows.join(hubs, ["token", "salt"]).select("sid", "n", "fp", "hub").unionByName(hubs.select("token", "hub.*").join(tops, "token").select("sid", "n", "fp", "hub"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= RADIUS
    stars = stage_table(stars.filter((F.col("sid") != F.col("hub.sid")) & _alike(F.col("n"), F.col("hub.n")) & near).select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).distinct(), "stars")
    labels = stage_table(connected_components(similar(stars)).withColumnRenamed("node", "sid"), "labels")
    rows = stage_table(rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labelled")
    # The largest component at a token names a cell, of all rows that have such a token. Its rows outside that component, which ask, meet all its rows.
    largest = rows.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("cell"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    cells = stage_table(rows.join(largest.select("token", "cell"), "token").select("cell", "sid", "n", "fp", "label").distinct().withColumn("asks", F.col("label") != F.col("cell")), "cells")
    cells = _finer(cells, rows, largest, made)
    with arrow_rows(spark, 4096):
        light = _deal(cells.join(made.select(F.col("row").alias("sid"), "bits"), "sid"))
        left = stage_table(light.mapInPandas(lambda batches: _by_runs(batches, _left), "cell long, sid long").distinct(), "left")
    cells = stage_table(cells.join(left, ["cell", "sid"]), "cells-left")
    wanted = stage_table(cells.select("sid").distinct().join(units.select("sid", "key"), "sid"), "wanted")
    known = stage_table(texts.select("key", "_text").join(checked_broadcast(wanted), "key").select("sid", "_text"), "texts").dropDuplicates(["sid"])
    with arrow_rows(spark, 1024):
        whole = _deal(cells.join(known, "sid"))
        cross = stage_table(whole.mapInPandas(lambda batches: _by_runs(batches, lambda frame: _forest(frame, shingle, seed)), "a long, b long").distinct(), "crossing")
    if cross.limit(1).count():
        labels = connected_components(cross.unionByName(labels.filter("sid <> label").select(F.col("sid").alias("a"), F.col("label").alias("b")))).withColumnRenamed("node", "sid")
    units = stage_table(units.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "components")
    best = units.groupBy("label").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("_c"))
    of = join_counted(units, best, "label", "_c").select("key", F.col("best.id").alias("component_id"), F.col("best.key").alias("stays"), "_n")
    return join_counted(made.select("id", "key"), stage_table(of, "groups"), "key")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of `docs`: id and component_id, the smallest id that links of similar texts reach, itself included.

    Null and empty texts are alike, and a text of fewer than five words is one
    shingle; texts of any length are read whole. Rows without an id link too;
    component_id is null if no row of a component has an id. Repeated rows stay
    repeated, an empty table gives an empty result, other columns are ignored.
    """
    return grouped(docs, id_col, text_col, **kw).select(F.col("id").alias(id_col), "component_id")
