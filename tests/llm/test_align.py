"""Alignment of two tokenizers against the libraries and plain Python."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skemara.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return a, ranks, sentencepiece.SentencePieceProcessor(model_file=B)


def groups(libraries, text):
    """[(A ids, B ids)] of a text, or nothing if it has no tokens."""
    a, ranks, b = libraries
    if not text:
        return []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    spelt = [ranks[i] for i in ids[0]], [piece(i) for i in ids[1]]
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
    out, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(end) + 1 for e in ends]
        out.append(tuple(i[x:y] for i, x, y in zip(ids, at, to, strict=True)))
        at = to
    return out


def expected(libraries, texts):
    found = [groups(libraries, t) for t in texts]
    links = [Counter((x, y) for g, h in f for x in g for y in h) for f in found]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for f, c in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in f)
        out.append((sum(len(g) for g, _ in f), sum(len(h) for _, h in f), len(f), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if f else ""))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  ", "a", " a", "  a  b ", "a \n b\n\n c", "\n", "\t x", "▁", "a▁b c", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x41>", "漢字かな交じり文 日本語", "\U0001f600\U0001f468‍\U0001f469 é é", "x\x1cy \x1c z\x85w   q  r",
    "a" * 3000, " " * 500, "ab" * 700 + " " + "!?" * 400, "don't we'll it's 1234567 12,345.67", "\x00 \x01", "the the the, the", "￿￾", "Zeile.\nNächste Zeile.\r\nEnde",
]


def check(spark, libraries, texts, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = align.align_documents(df.withColumn("n_a", df["doc_id"]).withColumn("spill", df["doc_id"]), A, B).collect()
    assert sorted(((r["doc_id"], *(r[f] for f in FIELDS)) for r in got), key=repr) == sorted(((i, *e) for i, e in zip(ids, expected(libraries, texts), strict=True)), key=repr)


def test_odd_texts(spark, libraries):
    check(spark, libraries, ODD)


def test_random_texts_small_spills_and_merges_in_levels(spark, libraries, monkeypatch):
    for name, value in (("SPILL_RECORDS", 60), ("SPILL_DOCS", 7), ("FAN_IN", 3), ("SHARED", 2), ("BLOCK", 5), ("WORDS", 50), ("WIDE", 2)):
        monkeypatch.setattr(align, name, value)
    r = random.Random(4)
    bits = ["the", "alpha", "Öl", " ", "  ", "\n", "x", "ing", "漢", "!", "▁", "\U0001f600", "'s", "12", "<|endoftext|>"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(12))) for _ in range(150)]
    rows, _ = align._align_batch(align.Aligner(A, B), list(range(len(texts))), texts)
    want = expected(libraries, texts)
    assert [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for x in rows] == [(*w[:4], w[6]) for w in want]
    check(spark, libraries, texts, [r.choice([i, 3, None]) for i in range(len(texts))])


def test_documents_whole(spark, libraries, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in align.align_documents(docs.repartition(5), A, B).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], expected(libraries, [r["text"] for r in rows]), strict=True))


def test_merge_and_packing():
    r = random.Random(2)
    heads, want = [], Counter()
    for _ in range(20):
        c = Counter(r.randrange(500) for _ in range(r.randrange(1, 200)))
        want += c
        codes = np.array(sorted(c))
        heads.append(align.pack_head(codes, np.array([c[x] for x in codes.tolist()])))
    assert list(align.merge_heads(heads)) == sorted(want.items())
    found = [np.concatenate(x).tolist() for x in zip(*align.head_blocks(align.merged_head(heads, 10, True)), strict=True)]
    top = {a: max(n for c, n in want.items() if c // 10 == a) for a in {c // 10 for c in want}}
    assert found == [sorted(want), [2 * want[c] + (want[c] == top[c // 10]) for c in sorted(want)]]
    for kind in ("<i4", "<i8"):
        values = np.array([0, 1, -5, 2**30], kind)
        assert align.swell(align.squeeze(values), kind).tolist() == values.tolist()
    assert align.swell(align.squeeze(np.empty(0, "<i8")), "<i8").tolist() == []


def test_no_rows_and_no_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(df, A, B).count() == 0
    got = align.align_documents(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"), A, B).collect()
    assert [(r["n_a"], r["count_sum"], r["groups_sha256"]) for r in got] == [(0, 0, "")] * 2


def test_pair_counts_as_rows(spark, libraries):
    texts = ["the cat the cat", "the dog", "a cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = align.spill_runs(df, A, B)
    span = align._span(B)
    got = {(r["a_id"], r["b_id"]): r["n_docs"] for r in align.pair_counts(align.count_pairs(runs, span), span).collect()}
    assert got == Counter(p for t in texts for p in {(x, y) for g, h in groups(libraries, t) for x in g for y in h})
