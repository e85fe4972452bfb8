"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in ascending order. Its ids are
cut into blocks of BLOCK: a block stores its minimum, and each id less that
minimum at the width that a percentile of them needs; the few wider ones go to
an exception list with their places and their upper bits. An index gives each
block's start, another each document's first id, so a reader can begin
anywhere. Layout, little-endian:

    magic, blocks, block starts (u64 each, and the end), document ids (i64),
    flags of null ids (u8), first ids (u64, and the end), footer (6 u64, magic)

A block: minimum u32, ids u16, width u8, 0 u8, exceptions u16, packed bits,
exception places u16 each, exception upper parts u32 each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.llm.shared import CACHE, arrow_rows, look_up, scratch_dir, stage_table

MAGIC, BLOCK, PERCENTILE = b"PFRB0001", 1024, 95
HEAD, FOOT = struct.Struct("<IHBBH"), struct.Struct("<6Q8s")
#: Characters that are letters to the pattern; a word of others goes to the library as it is.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
#: Ids decoded at a time.
WINDOW = 1 << 18


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, one after the other from the lowest bit on."""
    size = 1 if width <= 8 else 2 if width <= 16 else 4
    raw = values.astype(f"<u{size}")
    if width == 8 * size:
        return raw.tobytes()
    return np.packbits(np.unpackbits(raw.view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack_bits(data: memoryview, width: int, count: int) -> np.ndarray:
    """The `count` values that pack_bits has packed, as unsigned 32-bit integers."""
    if width in (16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype("<u4")
    if width > 16:
        whole = np.zeros((count, 32), np.uint8)
        whole[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * width].reshape(count, width)
        return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    if not width:
        return np.zeros(count, "<u4")
    # Eight values fill `width` bytes: they are read as two machine words, with four values each.
    eights = -(-count // 8)
    raw = np.zeros((eights, 16), np.uint8)
    raw[:, :width] = np.frombuffer(bytes(data).ljust(eights * width, b"\0"), np.uint8).reshape(eights, width)
    joined = raw.view("<u8").astype(np.uint64)
    fours = np.empty_like(joined)
    fours[:, 0] = joined[:, 0]
    fours[:, 1] = (joined[:, 0] >> np.uint64(4 * width)) | (joined[:, 1] << np.uint64(64 - 4 * width))
    values = np.empty((2 * eights, 4), "<u4")
    for k in range(4):
        values[:, k] = (fours.ravel() >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return values.ravel()[:count]


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block; `ids` are up to 65,535 unsigned 32-bit integers."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, at := int((len(rest) - 1) * percentile / 100))[at]).bit_length()
    wide = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = pack_bits(rest, width)
    over = (rest[wide] >> np.uint32(width)).astype("<u4") if len(wide) else np.empty(0, "<u4")
    return HEAD.pack(low, len(ids), width, 0, len(wide)) + packed + wide.astype("<u2").tobytes() + over.tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    """The ids of one block."""
    low, count, width, _, exceptions = HEAD.unpack_from(data)
    size = (count * width + 7) // 8
    ids = unpack_bits(data[HEAD.size : HEAD.size + size], width, count)
    if exceptions:
        at = np.frombuffer(data, "<u2", exceptions, HEAD.size + size)
        ids[at] |= np.frombuffer(data, "<u4", exceptions, HEAD.size + size + 2 * exceptions) << np.uint32(width)
    return ids + np.uint32(low)


class TokenWriter:
    """Writes one file; documents must come in ascending order."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = pafs.FileSystem.from_uri(uri)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.count, self.starts = len(MAGIC), 0, []
        self.docs: list[int | None] = []
        self.firsts: list[int] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.firsts.append(self.count)
        self.count += len(ids)
        self.held.append(ids.astype(np.uint32))
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        upto = len(ids) if end else len(ids) // BLOCK * BLOCK
        for i in range(0, upto, BLOCK):
            block = pack_block(ids[i : min(i + BLOCK, upto)])
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        blocks_end = self.at
        index = np.array([*self.starts, blocks_end], "<u8").tobytes()
        ids = np.array([0 if d is None else d for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs)
        firsts = np.array([*self.firsts, self.count], "<u8").tobytes()
        self.out.write(index + ids + firsts + FOOT.pack(len(self.starts), len(self.docs), self.count, blocks_end, blocks_end + len(index), blocks_end + len(index) + len(ids), MAGIC))
        self.out.close()


def read_documents(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, first id's place in the file, ids) of each document of a file, a window of blocks at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        blocks, docs, count, index_at, docs_at, firsts_at, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"no token file: {uri}")
        starts = np.frombuffer(f.read_at(8 * (blocks + 1), index_at), "<u8").astype(np.int64)
        ids = np.frombuffer(f.read_at(8 * docs, docs_at), "<i8").tolist()
        null = f.read_at(docs, docs_at + 8 * docs)
        firsts = np.frombuffer(f.read_at(8 * (docs + 1), firsts_at), "<u8").astype(np.int64)
        d = 0
        while d < docs:
            e = max(d + 1, int(np.searchsorted(firsts, firsts[d] + WINDOW, "right")) - 1)
            low, high = int(firsts[d]) // BLOCK, -(-int(firsts[e]) // BLOCK)
            data = memoryview(f.read_at(int(starts[high] - starts[low]), int(starts[low]))) if high > low else memoryview(b"")
            run = [unpack_block(data[starts[b] - starts[low] : starts[b + 1] - starts[low]]) for b in range(low, high)]
            values = np.concatenate(run) if run else np.empty(0, np.uint32)
            for k in range(d, e):
                yield (None if null[k] else ids[k]), int(firsts[k]), values[firsts[k] - low * BLOCK : firsts[k + 1] - low * BLOCK]
            d = e


class ByteEncoder:
    """Encodes with the tokenizers library, each distinct word once.

    The vocabulary's own pattern never joins characters over a space that
    precedes a character that is no white space, so texts are cut there. New
    words go to the library side by side, as " word word word": each begins with
    the only id of its own that starts with a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        #: Ids of a word that follows a space, as bytes of unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}
        #: Ids of a word's parts: letters after a space, and others.
        self.bits: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.letters = re.compile(f"{LETTERS}+").fullmatch
        self.parts = re.compile(f"({LETTERS}+)([.,]*)(?:(\\n)({LETTERS}+)([.,]*))?").fullmatch
        self.feed = self.alone(["\n"])[0]
        self.line = int(np.frombuffer(self.feed, "<u4")[0])
        self.unclear, self.cut = re.compile(r" (?:\s|$)"), re.compile(r" (?=\S)")

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, words: list[str], mark: str) -> dict[str, bytes]:
        """Ids of words that are encoded side by side, each after `mark`; a word is cut off where the next mark's id stands."""
        rows = [words[i : i + 256] for i in range(0, len(words), 256)]
        out, odd = {}, []
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(f"{mark}{w}" for w in r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids] if mark == " " else ids == self.line)
            if len(starts) != len(row):
                odd += row
                continue
            lows = starts if mark == " " else starts + 1
            data = ids.tobytes()
            out.update(zip(row, map(data.__getitem__, map(slice, (4 * lows).tolist(), [*(4 * starts[1:]).tolist(), len(data)])), strict=True))
        out.update(zip(odd, self.alone([f"{mark}{w}" if mark == " " else w for w in odd]), strict=True))
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that follow a space. Letters, a run of stops and a line feed with more letters are parts that the pattern always cuts, so they are looked up apart."""
        whole, odd, plain, cut = [], [], [], {}
        for w in words:
            if w.isalpha() and (w.isascii() or self.letters(w)):
                whole.append(w)
            elif not w or " " in w:
                odd.append(w)
            elif m := self.parts(w):
                cut[w] = m.groups("")
            else:
                plain.append(w)
        bits = self.bits
        heads = {a for a, *_ in cut.values()}.union(whole).difference(bits[0])
        tails = {x for _, b, _, c, d in cut.values() for x in (b, c, d) if x}.difference(bits[1])
        if len(bits[0]) + len(bits[1]) + len(heads) + len(tails) > CACHE:
            bits[0].clear()
            bits[1].clear()
            heads, tails = {a for a, *_ in cut.values()}.union(whole), {x for _, b, _, c, d in cut.values() for x in (b, c, d) if x}
        bits[0].update(self._row(list(heads), " "))
        bits[1].update(self._row(list(tails), "\n"))
        first, other, line = *bits, self.feed
        out = dict(zip(whole, map(first.__getitem__, whole), strict=True))
        out |= {w: first[a] + (other[b] if b else b"") + (line if n else b"") + (other[c] if c else b"") + (other[d] if d else b"") for w, (a, b, n, c, d) in cut.items()}
        out |= self._row(plain, " ")
        out.update(zip(odd, self.alone([f" {w}" for w in odd]), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [((self.cut.split(t) if self.unclear.search(t) else t.split(" ")) if t else [""]) for t in texts]
        heads = dict.fromkeys(words[0] for words in split if words[0])
        heads = dict(zip(heads, self.alone(list(heads)), strict=True))
        heads[""] = b""
        starts = [heads[words[0]] for words in split]
        for words in split:
            del words[0]
        found = look_up(self.known, split, self._learn)
        return [np.frombuffer(head + rest, "<u4") for head, rest in zip(starts, found, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder per worker process, on one thread: Spark has a task for each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteEncoder(path)


FILES = "file int, uri string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the files of `folder` in ascending order of ids; returns a row per file.

    Rows are range partitioned by id (and a hash of the text, so that rows
    without an id or with one id lie in many partitions) and sorted, and each
    partition writes one file. Its name has the task's attempt, so an attempt
    that runs again or beside another never meets its file; what counts is the
    returned table, which has the attempts that Spark committed. Null and empty
    texts have the end id alone, null ids come first, rows with equal ids stay
    apart, texts are encoded whole whatever their length, other columns are
    ignored, an empty table gives no file. `folder` must be a URI or path that all executors share.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context, tail = TaskContext.get(), [] if end is None else [end]
        writer = None
        for batch in batches:
            if batch.empty:
                continue
            writer = writer or TokenWriter(f"{folder}/tokens-{context.partitionId():06d}-{context.taskAttemptId()}.pfr")
            for doc, ids in zip(batch["_id"], encoder(tokenizer).encode(batch["_text"].tolist()), strict=True):
                writer.add(None if pd.isna(doc) else int(doc), np.concatenate([ids, np.array(tail, np.uint32)]))
        if writer:
            writer.close()
            yield pd.DataFrame({"file": [context.partitionId()], "uri": [writer.uri], "n_docs": [len(writer.docs)], "n_tokens": [writer.count]})

    rows = docs.select(F.col(id_col).alias("_key"), F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    with arrow_rows(docs.sparkSession, 256):
        return stage_table(rows.repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash").select("_id", "_text").mapInPandas(write, FILES), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files, read back block by block."""
    # A row per file, which a file listing has on the driver too.
    rows, before = [], 0
    for r in files.orderBy("file").collect():
        rows.append((r["file"], r["uri"], before))
        before += r["n_tokens"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, base in zip(batch["uri"], batch["base"], strict=True):
                held = []
                for doc, first, ids in read_documents(uri):
                    held.append((None if doc is None else str(doc), base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["_id", "start", "n_tokens", "ids_crc32"])
                        held = []
                yield pd.DataFrame(held, columns=["_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(rows, "file int, uri string, base long").repartition(max(1, len(rows)))
    found = names.mapInPandas(read, "_id string, start long, n_tokens long, ids_crc32 long")
    return found.select(F.col("_id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str, end: int | None = 2) -> DataFrame:
    """Write the token files of `docs` to a scratch folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, folder, end))
