"""Exact and near duplicates, quality rules, licences, packing and the pipeline against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from skemara.llm import exact_dedup, licences, packing, quality_rules, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6
    return [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (2, base, "en", "b", 1), (3, None, "en", None, None), (4, "", None, "a", 0),
        (None, base, "en", "a", 1), (None, "only one", "en", "a", 1), (5, LONG, "en", "a", 1), (6, LONG, "en", "a", 1), (7, "Ünï cödé\nline\nline\n\n#$% x", "de", "c", 2),
        (8, "a b", "en", "a", 3), (9, "a b c", "en", "a", 3), (10, "a b c a b c", "en", "a", 3),
    ]


def as_docs(spark, rows, more=()):
    df = spark.createDataFrame(rows, DOCS)
    for c in more:
        df = df.withColumn(c, df["doc_id"].cast("string"))
    return df


CLASH = ("kept", "keep_id", "n_words", "Base_Failed", "group_size", "fingerprint")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, rows, keep):
    got = exact_dedup.exact_groups(as_docs(spark, rows), keep=keep).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((max if keep == "max" else min)(known) if known else None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_hot_text_is_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 0.01)
    data = [(i, "same" if i % 3 else f"t{i}", "en", "a", 1) for i in range(600)]
    got = exact_dedup.exact_groups(as_docs(spark, data), keep="max").collect()
    for r in got:
        assert (r.keep_id, r.group_size, r.kept) == ((599, 400, r.doc_id == 599) if r.doc_id % 3 else (r.doc_id, 1, True))


def test_drops_keep_all_columns(spark, rows):
    docs = as_docs(spark, rows, CLASH)
    for f in (exact_dedup.drop_exact, quality_rules.drop_failed, simhash.drop_near):
        out = f(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    exact = exact_dedup.drop_exact(docs).collect()
    assert len(exact) == len({r[1] or "" for r in rows})


def test_empty_tables(spark):
    docs = as_docs(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert licences.scan_licences(docs).count() == 0
    assert packing.pack(docs).count() == 0


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, rows):
    got = quality_rules.quality_rules(as_docs(spark, rows, ("kept",))).collect()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], *measured(r[1])) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_host_falls_and_clean_host_stays(spark):
    good = " ".join(f"word{i}" for i in range(60))
    data = [(i, "short text" if i < 190 else good + str(i), "en", "bad", 1) for i in range(200)]
    data += [(1000 + i, good + str(i), "en", f"h{i % 10}", 1) for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(as_docs(spark, data)).collect()}
    assert not any(got[i].kept for i in range(200)) and got[195].host_failed and not got[195].base_failed
    assert all(got[1000 + i].kept for i in range(300))


def plain_groups(texts, ids, radius=4):
    def fp(text):
        words = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    prints = [fp(t) for t in texts]
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{p:016x}", least.get(root(i))) for i, (d, p) in enumerate(zip(ids, prints, strict=True))]


def test_near_groups(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(as_docs(spark, rows))
    data = docs.collect()
    want = collections.Counter(plain_groups([r.text for r in data], [r.doc_id for r in data]))
    assert collections.Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 7])
def test_sliced_links(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(-(2**63), 2**63 - 1, 700)
    values[350:] = values[:350]
    for i in range(350, 700):
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            values[i] ^= np.int64(1) << np.int64(b)
    starts = np.array([0, 1, 3, 70, 134, 700])
    got = [p for a, b in simhash.sliced_links(values, starts, radius) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for s, e in zip(starts[:-1], starts[1:], strict=True) for i in range(s, e) for j in range(i + 1, e) if ((int(values[i]) ^ int(values[j])) & (2**64 - 1)).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_large_buckets_are_tiled(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    prints = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))})
    distinct = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.near_links(distinct, 4, tile=16)
    labels = {r.node: r.label for r in simhash.connected_components(links).collect()}
    assert set(labels) == set(prints) and set(labels.values()) == {min(prints)}


@pytest.mark.parametrize("count", [1, 10**5, 10**8, 10**12])
def test_masks_are_complete(count):
    rng = np.random.default_rng(1)
    masks = [m & (2**64 - 1) for m in simhash.masks(count)]
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_licences(spark):
    mit = next(t for k, t in licences.KNOWN if k == "MIT")
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ; "), mit + " extra", None, "", "Some prose.\nReleased under the MIT Licence.\nLICENSED UNDER CC BY-NC 4.0\nend", LONG]
    docs = as_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], ("licence", "digest"))
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan_licences(docs).collect()}
    assert [got[i] for i in range(7)] == [("MIT", ""), ("MIT", ""), (None, ""), (None, ""), (None, ""), (None, "CC-BY-NC-4.0,MIT"), (None, "")]


def test_licence_lines_of_any_kind(spark, tmp_path):
    isc = next(t for k, t in licences.KNOWN if k == "ISC").replace("\n", " ")
    texts = ["=" * 8000 + " Released under the MIT License. " + "=" * 8000, f"before\n{isc}\nafter", "x\n  ** public DOMAIN!\n", "licensed, under the apache licence; version 2.0"]
    docs = as_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    known = (*licences.KNOWN, ("PD", "Public domain."), ("none", "© 2020 someone"))
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan_licences(docs, known=known).collect()}
    assert got == {0: ("MIT", "MIT"), 1: (None, "ISC"), 2: (None, "PD"), 3: ("Apache-2.0", "Apache-2.0")}
    for name, text in (("GPL-9.0+.txt", "Long\nlicence\n" + "word " * 5000), ("X-1", "Other text")):
        (tmp_path / name).write_text(text)
    more = licences.licence_texts(spark, str(tmp_path))
    assert [k for k, _ in more] == ["GPL-9.0+", "X-1"]
    whole = as_docs(spark, [(1, "LONG LICENSE; " + "word, " * 5000, None, None, None), (2, None, None, None, None)], ("notices",))
    assert {r.doc_id: r.licence for r in licences.scan_licences(whole, known=more).collect()} == {1: "GPL-9.0+", 2: None}


def test_beginnings_lose_no_line():
    rng = random.Random(4)
    pattern = re.compile(licences.beginnings())
    for _, text in licences.KNOWN:
        for line in text.split("\n"):
            for _ in range(5):
                spelt = "".join(rng.choice((c.upper(), c, c + rng.choice("-* ") if not c.isalnum() else c)) for c in line)
                whole = [t for _, t in licences.KNOWN if t == line]
                assert not whole or pattern.search(rng.choice(("", "  -- ", "§ ")) + spelt.lower())


def test_hot_text_without_identifiers(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 0.05)
    data = [(None if i % 2 else 7, "same", "en", f"s{i}", i) for i in range(300)] + [(k, f"t{k}", "en", "a", 1) for k in range(300)]
    for keep in ("min", "max"):
        got = exact_dedup.exact_groups(as_docs(spark, data), keep=keep).filter("group_size > 1").collect()
        assert {(r.keep_id, r.group_size) for r in got} == {(7, 300)} and sum(r.kept for r in got) == 1 and next(r for r in got if r.kept).doc_id == 7
    nobody = exact_dedup.exact_groups(as_docs(spark, [(None, "same", "en", f"s{i}", i) for i in range(200)])).collect()
    assert sum(r.kept for r in nobody) == 1 and {(r.keep_id, r.group_size) for r in nobody} == {(None, 200)}


@pytest.mark.parametrize("share", [2.0, 0.05])
def test_hot_fingerprints(spark, monkeypatch, share):
    from skemara.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_SHARE", share)
    data = [(i, f"one two three {i % 3 or i}", "en", "a", 1) for i in range(300)]
    want = collections.Counter(plain_groups([r[1] for r in data], [r[0] for r in data]))
    assert collections.Counter(tuple(r) for r in simhash.near_groups(as_docs(spark, data)).collect()) == want


def test_finer_masks_are_complete():
    rng = np.random.default_rng(6)
    for mask in simhash.masks(10**8)[::9]:
        sub = [m & (2**64 - 1) for m in simhash.finer(mask)]
        free = [p for p in range(64) if not (mask & (2**64 - 1)) >> p & 1]
        for _ in range(100):
            diff = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(diff & m == 0 for m in sub)


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 40, 60).tolist()
        hist = sorted(collections.Counter(lengths).items())
        for k in (1, 2, 3, 4):
            got = packing.best_bounds([x for x, _ in hist], [n for _, n in hist], [x * n for x, n in hist], k)
            least = min(padding(lengths, (*c, hist[-1][0])) for j in range(k) for c in combinations([x for x, _ in hist[:-1]], j))
            assert len(got) <= k and padding(lengths, got) == least


def test_pack(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(as_docs(spark, rows))
    got = packing.pack(docs, budget=2000).collect()
    assert len(got) == docs.count()
    assert sorted(r.n_tokens for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in docs.collect())
    bounds = sorted({(r.bucket, r.bucket_len) for r in got})
    assert [b for b, _ in bounds] == list(range(len(bounds)))
    for b, most in bounds:
        mine = sorted((r for r in got if r.bucket == b), key=lambda r: (r.batch, r.slot))
        room = max(1, 2000 // most)
        assert [(r.batch, r.slot) for r in mine] == [(i // room, i % room) for i in range(len(mine))]
        ids = [r.doc_id for r in mine]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
        assert all((bounds[b - 1][1] if b else 0) < r.n_tokens <= most for r in mine)


def fallen_hosts(docs):
    rules = {
        "short": lambda n, c, s, d, r: n < 50, "repeats": lambda n, c, s, d, r: 100 * r > 50 * n,
        "dup_lines": lambda n, c, s, d, r: 10 * d > n, "symbols": lambda n, c, s, d, r: 10 * s > n,
    }
    hosts, fallen = collections.defaultdict(list), set()
    for d in docs:
        hosts[d.source].append(measured(d.text)[:5])
    for rule in rules.values():
        rate = {h: sum(rule(*m) for m in ms) / len(ms) for h, ms in hosts.items()}
        mean, var = np.mean(list(rate.values())), np.var(list(rate.values()), ddof=1)
        weight = min(1000, max(0, mean * (1 - mean) / var - 1)) if var > 0 else 1000
        fallen |= {h for h, ms in hosts.items() if (rate[h] * len(ms) + mean * weight) / (len(ms) + weight) > 0.5}
    return fallen
