"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words of a batch lie one after the other in flat numpy symbol arrays. A round
finds each word's least pair rank by a segmented minimum, merges its
occurrences from the left in all words at once, and compacts; words with no
pair left leave the arrays. Words are told apart where no piece of the
vocabulary can cross: before a space that follows another character.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemara.llm.shared import arrow_rows, look_up, stage_table

SPACE = "▁"
NONE = np.int32(1 << 30)
#: Rounds after which a word's rest is merged by a queue: only very long runs without a space take so many.
ROUNDS = 2000


class PieceModel:
    """Vocabulary, pair ranks and byte pieces of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.end = sp.eos_id()
        self.byte = {int(names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        plain = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece crosses words")
        scores = {p: sp.get_score(i) for p, i in plain.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(plain)
        for p in plain:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.char = {c: i for c, i in symbols.items() if len(c) == 1}
        self.size, self.unknown = n, n + len(symbols) + 1
        self.extra = {i: c for c, i in self.char.items() if i >= n}
        pairs = {(symbols[p[:k]], symbols[p[k:]]): (order[scores[p]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.base = self.unknown + 1
        self.keys = np.array([x * self.base + y for x, y in pairs], np.int64)
        self.ranks, self.merged = (np.array([v[k] for v in pairs.values()], np.int32) for k in (0, 1))
        self._table(20)
        # Pieces that a longer piece ranks no worse than: after such a merge a neighbouring pair may come first.
        rank_of = np.full(self.base, NONE, np.int32)
        for p, i in plain.items():
            rank_of[i] = order[scores[p]]
        self.early = np.zeros(self.base, bool)
        for (x, y), (r, _) in pairs.items():
            self.early[x] |= r <= rank_of[x] < NONE
            self.early[y] |= r <= rank_of[y] < NONE
        self.letter = np.full(0x110000, self.unknown, np.int32)
        for c, i in self.char.items():
            self.letter[ord(c)] = i
        self.text = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.text[i] = b""
            elif sp.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        #: Ids of a word, as bytes of signed 32-bit integers.
        self.known: dict[str, bytes] = {}

    def _table(self, bits: int) -> None:
        """Open addressing over the pair keys, for lookups of whole arrays."""
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int32)
        place = self._place(self.keys)
        left = np.arange(len(self.keys))
        self.probes = 0
        while len(left):
            spot = place[left] + self.probes
            free = self.slots[spot] < 0
            chosen, first = np.unique(spot[free], return_index=True)
            self.slots[chosen] = left[free][first]
            left = left[self.slots[place[left] + self.probes] != left]
            self.probes += 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE where no piece is made."""
        key = left.astype(np.int64) * self.base + right
        place = self._place(key)
        rank, made = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for probe in range(self.probes):
            slot = self.slots[place[todo] + probe]
            used = slot >= 0
            todo, slot = todo[used], slot[used]
            hit = self.keys[slot] == key[todo]
            rank[todo[hit]], made[todo[hit]] = self.ranks[slot[hit]], self.merged[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return rank, made

    def merge(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word, as bytes; a space is part of a word as its first characters."""
        out: list[bytes] = [b""] * len(words)
        letters = "".join(words).replace(" ", SPACE)
        symbol = self.letter[np.frombuffer(letters.encode("utf-32-le"), np.uint32)]
        raw = np.arange(len(letters), dtype=np.int32)  # where a symbol began, for characters without a piece
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
        rank, made = self._pairs(symbol, word, np.arange(len(word)))
        for turn in range(len(letters) + 1):
            if not len(word):
                break
            if turn == ROUNDS:
                self._queue(out, symbol, raw, word, letters)
                break
            new = np.empty(len(word), bool)
            new[0] = True
            np.not_equal(word[1:], word[:-1], out=new[1:])
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(word))
            over = least == NONE
            if over.any():
                done = np.repeat(over, sizes)
                self._finish(out, symbol[done], raw[done], word[done], letters)
                going = ~done
                symbol, raw, word, rank, made, least, sizes = symbol[going], raw[going], word[going], rank[going], made[going], least[~over], sizes[~over]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            close = np.diff(at) == 1
            if close.any():
                # Of overlapping pairs the left one, then every second.
                order = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~close]), order, 0))
                at = at[(order - run) % 2 == 0]
            if self.early[made[at]].any():
                at = at[self._safe(symbol, word, rank, made, at)]
            symbol[at] = made[at]
            stay = np.ones(len(word), bool)
            stay[at + 1] = False
            fix = np.zeros(len(word), bool)
            fix[at] = True
            symbol, raw, word, rank, made, fix = symbol[stay], raw[stay], word[stay], rank[stay], made[stay], fix[stay]
            fix[:-1] |= fix[1:]
            fix = np.flatnonzero(fix)
            rank[fix], made[fix] = self._pairs(symbol, word, fix)
        return out

    def _safe(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merges of this round: of each word those up to the first after which a neighbouring pair ranks no worse."""
        piece, low, of = made[at], rank[at], word[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(word) - 1)
        stop = (at > 0) & (word[before] == of) & (self.pair(symbol[before], piece)[0] <= low)
        stop |= (at + 2 < len(word)) & (word[after] == of) & (self.pair(piece, symbol[after])[0] <= low)
        twin = (np.diff(at) == 2) & (of[1:] == of[:-1]) & (self.pair(piece[:-1], piece[1:])[0] <= low[1:])
        stop[1:] |= twin
        stop[:-1] |= twin
        stops = np.cumsum(stop) - stop
        head = np.concatenate([[True], of[1:] != of[:-1]])
        return stops == np.maximum.accumulate(np.where(head, stops, 0))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(word) - 1)
        rank, made = self.pair(symbol[at], symbol[after])
        rank[(after == at) | (word[after] != word[at])] = NONE
        return rank, made

    def _finish(self, out: list[bytes], symbol: np.ndarray, raw: np.ndarray, word: np.ndarray, letters: str) -> None:
        ends = np.flatnonzero(np.diff(word, append=-1)) + 1
        data, odd, low = symbol.astype("<i4").tobytes(), np.maximum.reduceat(symbol, np.concatenate([[0], ends[:-1]])) >= self.size, 0
        for high, w, strange in zip(ends.tolist(), word[ends - 1].tolist(), odd.tolist(), strict=True):
            if strange:
                ids = (i for s, r in zip(symbol[low:high].tolist(), raw[low:high].tolist(), strict=True) for i in ([s] if s < self.size else [self.byte[b] for b in letters[r].encode()]))
                out[w] = np.array(list(ids), "<i4").tobytes()
            else:
                out[w] = data[4 * low : 4 * high]
            low = high

    def _queue(self, out: list[bytes], symbol: np.ndarray, raw: np.ndarray, word: np.ndarray, letters: str) -> None:
        """The same merges one at a time, best rank first and leftmost among equals."""
        table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        s, of = symbol.tolist(), word.tolist()
        n = len(s)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, k: int) -> None:
            if i >= 0 and k >= 0 and of[i] == of[k] and (hit := table.get(s[i] * self.base + s[k])):
                heapq.heappush(heap, (hit[0], i, s[i], s[k], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, x, y, piece = heapq.heappop(heap)
            k = right[i] if live[i] else -1
            if k < 0 or s[i] != x or s[k] != y:
                continue
            s[i], live[k], right[i] = piece, False, right[k]
            if right[k] >= 0:
                left[right[k]] = i
            offer(left[i], i)
            offer(i, right[i])
        stay = np.array(live)
        self._finish(out, np.array(s, np.int32)[stay], raw[stay], word[stay], letters)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text without an end id; a null or empty text has none."""
        split = [re.findall(" +[^ ]*", " " + t.replace(SPACE, " ")) if t else [] for t in texts]
        found = look_up(self.known, split, lambda new: dict(zip(new, self.merge(new), strict=True)))
        return [np.frombuffer(ids, "<i4") for ids in found]

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`: control ids are silent, bytes that are no UTF-8 give U+FFFD each, one space at the start goes."""
        spoken = [i for i in ids if self.text[i]]
        data = b"".join([self.text[i] for i in spoken])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._loose(spoken)
        return text[1:] if spoken and not self.is_byte[spoken[0]] and text.startswith(" ") and self.text[spoken[0]] != " ⁇ ".encode() else text

    def _loose(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.text[i]
                continue
            while run:
                for k in range(1, 5):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        if k == 4 or k >= len(run):
                            out.append("�")
                            run = run[1:]
                            break
            if i is not None:
                out.append(self.text[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(id, ids array<int>) for each row: the text's pieces, then the end id.

    A null text counts as empty, an empty one has the end id alone; texts of any
    length are encoded whole. Rows stay as they are repeated, null ids too; an
    empty table stays empty, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        tail = np.array([m.end] if end else [], np.int32)
        for batch in batches:
            ids = [np.concatenate([x, tail]) for x in m.encode(batch["_text"].tolist())]
            yield pd.DataFrame({"_id": batch["_id"], "ids": ids})

    kind = docs.schema[id_col].dataType
    made = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, "_id string, ids array<int>")
    return made.select(F.col("_id").cast(kind).alias(id_col), "ids")


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(path)
        return ids.map(lambda x: m.decode([] if x is None else x.tolist()))

    return encoded.withColumn(out_col, text(ids_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of each row, as a scratch table."""
    with arrow_rows(docs.sparkSession, 256):
        both = decode_pieces(encode_pieces(docs, path, id_col, text_col), path)
        ids = F.array_join(F.col("ids").cast("array<string>"), " ")
        return stage_table(both.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "pieces")
