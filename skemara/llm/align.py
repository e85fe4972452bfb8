"""Alignment of two tokenizers by external spill counting.

Both tokenizers cut a text before a single space that a visible character
follows, so words are aligned once each: places where tokens of both end cut a
word into groups, and every token of one side is linked with every token of
the other in its group. Tasks gather (pair of ids, document) records up to a
bound, sort them by pair, and spill them as compressed runs, radix-partitioned
by the first side's id: a run's head has its pairs and in how many documents
each is, its body the documents. A k-way heap merge over heads counts each pair
over the corpus. Pairs come in the order of the first side, so each id's
highest count is known when its last pair has passed. The counts then meet the
bodies, run by run, and what they contribute streams back to the spill that the
documents lie in.

Heads hold a pair once per run however many documents have it, and bodies are
dealt by (radix, salt), so frequent pairs are no single task's.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemara.llm.pieces import SPACE, PieceModel
from skemara.llm.shared import arrow_rows, stage_table
from skemara.llm.token_files import ByteEncoder

#: Parts by the first side's id; records and documents of a spill; pairs of a block of a head.
RADIX, SPILL_RECORDS, SPILL_DOCS, BLOCK = 32, 2_000_000, 1 << 16, 1 << 16
#: Runs and bytes of heads that one merge holds, and runs that share a copy of a radix's counts.
FAN_IN, MERGE_BYTES, SHARED = 512, 128 << 20, 64
#: Words that a worker keeps aligned, the longest of them, and words aligned at a time.
WORDS, LONGEST, AT_ONCE = 250_000, 64, 20_000
#: Groups with more links than this are linked by distinct ids with multiplicities.
WIDE = 64


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, its lowest bytes first, compressed."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def swell(data: bytes, kind: str) -> np.ndarray:
    """The array that squeeze made `data` of."""
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def pack_head(codes: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending pair codes with a value each, in blocks that can be read one at a time."""
    out = []
    for i in range(0, len(codes), BLOCK):
        part = codes[i : i + BLOCK].astype("<i8")
        a, b = squeeze(np.diff(part, prepend=0)), squeeze(values[i : i + BLOCK].astype("<i8"))
        out += [len(a).to_bytes(4, "little"), len(b).to_bytes(4, "little"), a, b]
    return b"".join(out)


def head_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and values of a head, block by block."""
    at, data = 0, memoryview(data)
    while at < len(data):
        a, b = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4))
        at += 8
        yield np.cumsum(swell(data[at : at + a], "<i8")), swell(data[at + a : at + a + b], "<i8")
        at += a + b


def merge_heads(heads: list[bytes]) -> Iterator[tuple[int, int]]:
    """(code, sum of values) of all heads, codes ascending, by a heap over the heads."""
    now, total = -1, 0
    for code, value in heapq.merge(*((x for c, v in head_blocks(h) for x in zip(c.tolist(), v.tolist(), strict=True)) for h in heads)):
        if code != now:
            if now >= 0:
                yield now, total
            now, total = code, 0
        total += value
    if now >= 0:
        yield now, total


def merged_head(heads: list[bytes], span: int, last: bool) -> bytes:
    """One head of many. With `last`, a value is twice the count, and one more if no pair of the same first id has a higher count."""
    out, codes, values = [], [], []

    def flush() -> None:
        if codes:
            c, v = np.array(codes, np.int64), np.array(values, np.int64)
            if last:
                side = c // span
                starts = np.flatnonzero(np.diff(side, prepend=-1))
                v = 2 * v + (v == np.repeat(np.maximum.reduceat(v, starts), np.diff(starts, append=len(c))))
            out.append(pack_head(c, v))
            codes.clear()
            values.clear()

    for code, value in merge_heads(heads):
        # Pairs of one first id stay together: there are no more of them than ids of the other side.
        if len(codes) >= BLOCK and code // span != codes[-1] // span:
            flush()
        codes.append(code)
        values.append(value)
    flush()
    return b"".join(out)


class Aligner:
    """Links of words, each distinct word once. `first` is a byte-level BPE file, `second` a piece model."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteEncoder(first), PieceModel(second)
        self.a.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(map(letters.__getitem__, n)) if all(map(letters.__contains__, n)) else n.encode() for n in names]
        self.b_bytes = self.b.text
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: A pair's code is the first side's id times this, and the second side's id.
        self.span = len(self.b_bytes)
        self.a_text, self.b_text = ([np.array([f"{i}{end}" for i in range(len(x))], object) for end in ends] for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        #: Of each word after a space: pair codes, counts of tokens and groups, text of the groups, and weighted links of wide groups; None if the bytes differ.
        self.known: dict[str, tuple | None] = {}
        self.unclear, self.cut = re.compile(r" (?:\s|$)"), re.compile(r"(?<! ) (?=\S)")

    def words(self, text: str) -> list[str]:
        """A space and `text`, cut where both tokenizers cut; each word without the space that it begins with."""
        spaced = " " + text
        if not self.unclear.search(spaced):
            return text.split(" ")
        head, *rest = self.cut.split(spaced)
        return [head[1:], *rest] if head else rest

    def _ids(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        odd = [w for w in words if not w or w[0].isspace()]
        first = self.a._learn([w for w in words if w and not w[0].isspace()])
        first.update(zip(odd, self.a.alone([" " + w for w in odd]), strict=True))
        for known in self.a.bits:
            if len(known) > WORDS:
                known.clear()
        split = [re.findall(" +[^ ]*", (" " + w).replace(SPACE, " ")) if " " in w or SPACE in w else [" " + w] for w in words]
        merged = iter(self.b.merge([p for s in split for p in s]))
        return [first[w] for w in words], [b"".join(next(merged) for _ in s) for s in split]

    def align(self, words: list[str]) -> dict[str, tuple | None]:
        """What `known` holds, for new words."""
        a_raw, b_raw = self._ids(words)
        spelt = [(" " + w).encode() for w in words]
        same = [True] * len(words)
        a, b = np.frombuffer(b"".join(a_raw), "<u4").astype(np.int64), np.frombuffer(b"".join(b_raw), "<i4").astype(np.int64)
        said = b"".join(spelt)
        if any(b"".join(map(of.__getitem__, ids.tolist())) != said for of, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            whole = lambda of, raw, kind: b"".join(map(of.__getitem__, np.frombuffer(raw, kind).tolist()))
            same = [whole(self.a_bytes, x, "<u4") == s == whole(self.b_bytes, y, "<i4") for x, y, s in zip(a_raw, b_raw, spelt, strict=True)]
            out = {w: None for w, ok in zip(words, same, strict=True) if not ok}
            return out | (self.align(left) if (left := [w for w in words if w not in out]) else {})
        n_a, n_b = (np.fromiter(map(len, raw), np.int64, len(raw)) // 4 for raw in (a_raw, b_raw))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        of_group = np.searchsorted(np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt))), both)
        n_groups = np.bincount(of_group, minlength=len(words))
        a_many, b_many = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        b_start = np.cumsum(b_many) - b_many
        wide = a_many * b_many > WIDE
        # Links of narrow groups: each first token beside each second one.
        reps = np.where(wide[a_group], 0, b_many[a_group])
        left = np.repeat(np.arange(len(a)), reps)
        right = b_start[a_group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
        codes = (a[left] * self.span + b[right]).astype("<i8").tobytes()
        per_word = np.bincount(of_group[a_group[left]], minlength=len(words)) if len(left) else np.zeros(len(words), np.int64)
        more: dict[int, list] = {}
        for g in np.flatnonzero(wide).tolist():
            ca, cb = Counter(a[a_group == g].tolist()), Counter(b[b_group == g].tolist())
            more.setdefault(int(of_group[g]), []).extend((x * self.span + y, m * n) for x, m in ca.items() for y, n in cb.items())
        # The groups' text: tokens in the order of group, then side.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ends = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        parts = [np.where(e, t[1][ids], t[0][ids]) for e, t, ids in ((ends[0], self.a_text, a), (ends[1], self.b_text, b))]
        text = np.concatenate(parts)[order].tolist()
        stats = np.stack([n_a, n_b, n_groups], 1).astype("<i8").tobytes()
        out, at, said_at = {}, 0, 0
        for k, (w, links, tokens) in enumerate(zip(words, (8 * per_word).tolist(), (n_a + n_b).tolist(), strict=True)):
            out[w] = codes[at : at + links], stats[24 * k : 24 * k + 24], "".join(text[said_at : said_at + tokens]), more.get(k)
            at, said_at = at + links, said_at + tokens
        return out

    def look_up(self, words: list[str]) -> list[tuple | None]:
        """The alignment of each word; distinct ones are counted out first."""
        distinct = set(words)
        here = dict(zip(distinct, map(self.known.get, distinct), strict=True))
        new = [w for w, found in here.items() if found is None]
        for i in range(0, len(new), AT_ONCE):
            found = self.align(new[i : i + AT_ONCE])
            here |= found
            if len(self.known) + len(found) > WORDS:
                self.known.clear()
            self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return list(map(here.__getitem__, words))


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(first, second)


STORED = pa.schema([
    ("spill", pa.int64()), ("place", pa.int32()), ("id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("radix", pa.int32()), ("head", pa.binary()), ("body", pa.binary()), ("weights", pa.binary()),
])
STORED_DDL = "spill long, place int, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, head binary, body binary, weights binary"


class Spill:
    """Records of consecutive documents of a task."""

    def __init__(self, number: int, span: int, radix: int):
        self.number, self.span, self.radix = number, span, radix
        self.docs, self.records, self.held = 0, 0, []

    def add(self, doc: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        self.held.append((doc, code, weight))
        self.records += len(doc)

    def runs(self) -> Iterator[dict]:
        """A run per radix that has records, in pair order; a pair's documents ascend."""
        if not self.records:
            return
        doc, code, weight = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        part = (code // self.span) % self.radix
        order = np.argsort(code, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        doc, code, weight, part = doc[order], code[order], weight[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=self.radix))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            c, d = code[low:high], doc[low:high]
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            steps = np.diff(d, prepend=0)
            steps[starts] = d[starts]
            yield {"spill": self.number, "radix": int(part[low]), "head": pack_head(c[starts], np.diff(starts, append=len(c))), "body": squeeze(steps.astype("<i4")), "weights": squeeze(weight[low:high].astype("<i8"))}


def spill_runs(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """A row per document (its id as text, counts and digest) and a row per run, as one scratch table, so that both come from the same attempt of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24
        m = aligner(first, second)
        spill = Spill(base, m.span, radix)
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text").to_pylist()
            for low in range(0, len(ids), SPILL_DOCS):
                rows, records = _align_batch(m, ids[low : low + SPILL_DOCS], texts[low : low + SPILL_DOCS])
                if spill.docs + len(rows) > SPILL_DOCS or spill.records and spill.records + len(records[0]) > SPILL_RECORDS:
                    yield from (pa.RecordBatch.from_pylist([r], STORED) for r in spill.runs())
                    spill = Spill(spill.number + 1, m.span, radix)
                for k, r in enumerate(rows):
                    r |= {"spill": spill.number, "place": spill.docs + k}
                spill.add(records[0] + spill.docs, *records[1:])
                spill.docs += len(rows)
                yield pa.RecordBatch.from_pylist(rows, STORED)
        yield from (pa.RecordBatch.from_pylist([r], STORED) for r in spill.runs())

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    with arrow_rows(docs.sparkSession, 256):
        return stage_table(rows.mapInArrow(run, STORED_DDL), "align-runs")


def _align_batch(m: Aligner, ids: list, texts: list) -> tuple[list[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the documents, and their distinct (document, pair, links) records in the order of the documents."""
    split = [m.words(t) if t else [] for t in texts]
    rows = m.look_up([w for words in split for w in words])
    sizes = list(map(len, split))
    if None in rows:
        # A word whose tokens do not spell it leaves its whole document without tokens.
        starts = np.cumsum([0, *sizes]).tolist()
        kept = [[] if None in rows[a:b] else rows[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        rows, sizes = [r for k in kept for r in k], list(map(len, kept))
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    codes = [r[0] for r in rows]
    code = np.frombuffer(b"".join(codes), "<i8")
    doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), np.fromiter(map(len, codes), np.int64, len(codes)) // 8)
    stats = np.frombuffer(b"".join([r[1] for r in rows]), "<i8").reshape(-1, 3)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(stats, 0)])[edges]
    counts = np.diff(sums, axis=0)
    wide = [(int(np.searchsorted(edges, k, "right")) - 1, r[3]) for k, r in enumerate(rows) if r[3]]
    weight = np.ones(len(code), np.int64)
    if wide:
        doc = np.concatenate([doc, np.repeat([d for d, _ in wide], [len(x) for _, x in wide])])
        more = np.array([x for _, links in wide for x in links], np.int64)
        code, weight = np.concatenate([code, more[:, 0]]), np.concatenate([weight, more[:, 1]])
    links = np.zeros(len(sizes), np.int64)
    np.add.at(links, doc, weight)
    key = doc * (len(m.a_bytes) * m.span) + code
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    key, weight = key[starts], np.add.reduceat(weight, starts) if len(starts) else weight
    text = [r[2] for r in rows]
    digests = [hashlib.sha256("".join(text[a:b])[:-1].encode()).hexdigest() if b > a else "" for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
    made = [{"id": i, "n_a": a, "n_b": b, "n_groups": g, "n_links": n, "groups_sha256": s} for i, (a, b, g), n, s in zip(ids, counts.tolist(), links.tolist(), digests, strict=True)]
    return made, (key // (len(m.a_bytes) * m.span), key % (len(m.a_bytes) * m.span), weight)


def count_pairs(runs: DataFrame, span: int) -> DataFrame:
    """(radix, head): in how many documents each pair is, and whether it is a highest of its first id (see merged_head), a row per radix.

    Heads are merged in groups of bounded number and bytes until one is left per radix.
    """
    level = runs.filter("radix IS NOT NULL").select("radix", "spill", "head")
    while True:
        sizes = level.groupBy("radix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("head")).alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
        most, size = sizes[0] or 0, sizes[1] or 0
        groups = max(1, min(max(-(-most // FAN_IN), -(-size // MERGE_BYTES)), most // 4))
        last = groups == 1

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            now, heads = None, []
            shape = pa.schema([("radix", pa.int32()), ("spill", pa.int64()), ("head", pa.binary())])

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([{"radix": now[0], "spill": now[1], "head": merged_head(heads, span, last)}], shape)

            for batch in batches:
                for radix, group, head in zip(*(batch.column(c).to_pylist() for c in ("radix", "group", "head")), strict=True):
                    if now is not None and now != (radix, group):
                        yield made()
                        heads = []
                    now = (radix, group)
                    heads.append(head)
            if now is not None:
                yield made()

        dealt = level.withColumn("group", F.pmod(F.xxhash64("spill"), F.lit(groups))).repartition("radix", "group").sortWithinPartitions("radix", "group")
        with arrow_rows(runs.sparkSession, 64):
            level = stage_table(dealt.select("radix", "group", "head").mapInArrow(run, "radix int, spill long, head binary"), "align-counts")
        if last:
            return level.select("radix", "head")


def pair_counts(counts: DataFrame, span: int) -> DataFrame:
    """The counts as rows: a_id, b_id, n_docs, best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.column("head").to_pylist():
                for codes, values in head_blocks(head):
                    yield pa.RecordBatch.from_arrays([pa.array(codes // span), pa.array(codes % span), pa.array(values // 2), pa.array(values % 2 == 1)], ["a_id", "b_id", "n_docs", "best"])

    return counts.mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(spill, place, n_best, count_sum) of each document with links.

    A radix's counts are read once for SHARED runs or so; bodies stay packed
    until they meet them, and what comes of a run is packed again by document.
    """
    bodies = runs.filter("radix IS NOT NULL").select("radix", "spill", "head", "body", "weights")
    most = bodies.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // SHARED))
    none = F.lit(None).cast("binary")
    sides = bodies.withColumns({"salt": F.pmod(F.xxhash64("spill"), F.lit(salts)).cast("int"), "kind": F.lit(1)}).unionByName(
        counts.select("radix", F.lit(-1).cast("long").alias("spill"), "head", none.alias("body"), none.alias("weights"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"))
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = values = np.empty(0, np.int64)
        for batch in batches:
            out = []
            for spill, kind, head, body, weights in zip(*(batch.column(c).to_pylist() for c in ("spill", "kind", "head", "body", "weights")), strict=True):
                blocks = [np.concatenate(x) for x in zip(*head_blocks(head), strict=True)]
                if kind == 0:
                    codes, values = blocks
                    continue
                mine, many = blocks
                value = values[np.searchsorted(codes, mine)]
                steps, weight = swell(body, "<i4").astype(np.int64), swell(weights, "<i8")
                # A pair's first step is its document, the next ones go on from it.
                starts = np.cumsum(many) - many
                upto = np.cumsum(steps)
                doc = upto - np.repeat(upto[starts] - steps[starts], many)
                found, place = np.unique(doc, return_inverse=True)
                best, total = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                np.add.at(best, place, weight * np.repeat(value & 1, many))
                np.add.at(total, place, weight * np.repeat(value >> 1, many))
                out.append({"spill": spill, "docs": squeeze(np.diff(found, prepend=0).astype("<i4")), "best": squeeze(best), "total": squeeze(total)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("spill", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("total", pa.binary())]))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total, seen = None, *(np.zeros(SPILL_DOCS, np.int64) for _ in range(2)), np.zeros(SPILL_DOCS, bool)

        def made() -> pa.RecordBatch:
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["spill", "place", "n_best", "count_sum"])

        for batch in batches:
            for spill, *data in zip(*(batch.column(c).to_pylist() for c in ("spill", "docs", "best", "total")), strict=True):
                if now is not None and spill != now:
                    yield made()
                    for x in (best, total, seen):
                        x[:] = 0
                now = spill
                at = np.cumsum(swell(data[0], "<i4"))
                best[at] += swell(data[1], "<i8")
                total[at] += swell(data[2], "<i8")
                seen[at] = True
        if now is not None:
            yield made()

    dealt = sides.repartition("radix", "salt").sortWithinPartitions("radix", "salt", "kind", "spill")
    with arrow_rows(runs.sparkSession, 64):
        met = stage_table(dealt.select("spill", "kind", "head", "body", "weights").mapInArrow(meet, "spill long, docs binary, best binary, total binary"), "align-met")
        return stage_table(met.repartition("spill").sortWithinPartitions("spill").mapInArrow(back, "spill long, place int, n_best long, count_sum long"), "align-back")


def align_documents(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `docs`.

    The first tokenizer encodes a space and the text, the second the text, to
    which it adds the space itself; strings of special tokens are plain text. A
    null or empty text, and one that either side's tokens do not spell (as with
    U+2581, which the second takes for a space), has no tokens: zeros and an
    empty digest. Rows with equal or null ids stay apart and count as documents
    each; texts of any length are whole; other columns are ignored; an empty
    table stays empty.
    """
    kind = docs.schema[id_col].dataType
    runs = spill_runs(docs, first, second, id_col, text_col)
    sums = contributions(runs, count_pairs(runs, _span(second)))
    mine = runs.filter("place IS NOT NULL").select("spill", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return mine.join(sums, ["spill", "place"], "left").select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _span(second: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
