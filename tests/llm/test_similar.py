"""The pipeline's near stage against a brute-force count of all pairs."""

import collections
import hashlib

import numpy as np
import pytest

from skemara.llm import similar, simhash
from tests.llm.test_text_operators import DOCS, fallen_hosts, measured


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_components(docs):
    """(id, smallest id of its component) per row; all pairs are compared."""
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if 5 * met >= 4 * (len(sets[i]) + len(sets[j]) - met):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("tile", [3])
def test_all_pairs_are_found(spark, sf_dir, monkeypatch, tile):
    monkeypatch.setattr(similar, "PART", 4)  # hubs of parts meet too
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "SHINGLES", 2000)
    base = [f"w{i}" for i in range(80)]
    made = [(None, None), (9001, ""), (9002, None), (9003, "one two"), (None, "one  TWO"), (9004, " ".join(base)), (9004, " ".join(base))]
    # A chain whose ends are not alike, and copies that differ in one word each.
    made += [(9010 + k, " ".join([*base[3 * k :], *(f"x{i}" for i in range(3 * k))])) for k in range(12)]
    made += [(9050 + k, " ".join([*base[:k], f"y{k}", *base[k + 1 :]])) for k in range(0, 80, 5)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(d, t, None, None, None) for d, t in made], DOCS))
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    got = similar.similar_groups(docs).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_rows_are_dropped_not_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = a.replace("a30", "x")
    rows = [(3, a), (5, near), (5, b), (6, b), (None, near), (None, "alone"), (7, a), (3, near)]
    docs = spark.createDataFrame([(i, t, None, None, k) for k, (i, t) in enumerate(rows)], DOCS).withColumnRenamed("n_chars", "key")
    first = min(((hashlib.md5(t.encode()).hexdigest(), k) for k, (i, t) in enumerate(rows) if i == 3))[1]
    for kw in ({"shingle": 5, "similarity": (4, 5)}, {"radius": 12}):
        out = simhash.drop_near(docs, **kw)
        assert out.columns == docs.columns
        assert {r.key for r in out.collect()} == {first, 2, 5}
    assert simhash.drop_near(docs.limit(0), similarity=(4, 5)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(-(2**63), 2**63 - 1, 3000)
    sets = [rng.choice(pool, n, replace=False) for n in rng.integers(1, 900, 60)]
    bits = [similar.bitmap(x) for x in sets]
    size = np.array([len(x) for x in bits])
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(60) for j in range(60)), strict=True))
    apart = similar.bits_apart(np.concatenate(bits).view(np.uint64), np.cumsum(size) - size, size, a, b)
    assert all(k <= len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j, k in zip(a, b, apart, strict=True))
    assert all(apart[a == b] == 0)
    for n in range(1, 200):
        for m in range(1, n + 1):
            least = int(similar.least_shared(np.array([n]), np.array([m]))[0])
            assert 5 * least >= 4 * (n + m - least) and 5 * (least - 1) < 4 * (n + m - least + 1)


def test_pipeline_drops_all_similar_texts(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fallen, first = fallen_hosts(docs), {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        if not measured(d.text)[-1] and d.source not in fallen:
            first.setdefault(d.text or "", d)
    kept = {d for d, c in plain_components([(d.doc_id, d.text) for d in first.values()]) if d == c}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == kept and len(got) == len(kept)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a30", "x")
    rows = [(1, a, "s"), (1, a, "s"), (2, near, None), (None, a, "s"), (None, c, None), (2, b, "s"), (3, None, "s"), (4, "", "s"), (5, "short", None), (6, a + "\n" + " ".join(f"d{i}" for i in range(60_000)), "s")]
    docs = spark.createDataFrame([(i, t, "en", s, k, "q") for k, (i, t, s) in enumerate(rows)], DOCS + ", kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 61), (1, 61), (2, 61), (6, 60_061)]
    for stage in (corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.near):
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_large_cells_meet_at_pairs_of_tokens(spark, monkeypatch):
    """Texts that share one shingle and are not alike: rows grow with the texts, not with their square."""
    monkeypatch.setattr(similar, "TILE", 64)
    count = {}
    for n in (400, 1600):
        # Every text has the common shingle in its prefix: it has no others but its own, which are as rare.
        rows = [(i, [7, 1000 + 3 * i, 1001 + 3 * i]) for i in range(n)] + [(n, [7, 1000, 1001])]
        made = spark.createDataFrame(rows, "row long, prefix array<long>")
        members = made.selectExpr("row AS sid", "explode(prefix) AS token", "3L AS n", "0L AS fp", "row AS label").filter("token = 7 OR token < 1002")
        largest = spark.createDataFrame([(7, 0)], "token long, cell long")
        cells = members.filter("token = 7").selectExpr("0L AS cell", "sid", "n", "fp", "label", "sid <> 0 AS asks")
        finer = similar._finer(cells, members, largest, made)
        assert {r["sid"] for r in finer.collect()} == {0, n}
        count[n] = similar._deal(finer).count()
        whole = similar._deal(cells).count()
        assert whole > 5 * n
    assert count[400] == count[1600] < 20


def test_similar_pairs_in_large_cells_are_kept(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 2)
    monkeypatch.setattr(similar, "PART", 3)
    base = [f"b{i}" for i in range(30)]
    docs = [(100 * g + k, " ".join([*base, *(f"g{g}w{i}" for i in range(90)), f"own{g}x{k}"])) for g in range(12) for k in range(3)]
    docs += [(5000 + k, f"tiny {k % 4}") for k in range(16)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS)
    assert collections.Counter(tuple(r) for r in similar.similar_groups(df).collect()) == collections.Counter(plain_components(docs))


@pytest.mark.parametrize("name", ["_gone", "_key", "key", "stays", "_m", "_host", "_fallen", "_text", "_hash", "_head", "_salt", "_rank", "_first", "_n"])
def test_columns_named_like_working_ones(spark, monkeypatch, name):
    from skemara.llm import exact_dedup, quality_rules

    for module in (exact_dedup,):
        monkeypatch.setattr(module, "HOT_ROWS", 2)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (2, words, "en", "s", 1), (3, words + " more", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumn(name, df["doc_id"] * 10)
    for keep, want in ((quality_rules.drop_failed, {1, 2, 3}), (exact_dedup.drop_exact, {1, 3}), (lambda d: simhash.drop_near(d, shingle=5, similarity=(4, 5)), {1})):
        got = keep(df)
        assert got.columns == df.columns and {(r["doc_id"], r[name]) for r in got.collect()} == {(i, 10 * i) for i in want}


def test_repeats_of_a_whole_row_are_salted_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skemara.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 0.05)
    df = spark.createDataFrame([(1, "same", "en", "a", 1)] * 400 + [(i, f"t{i}", "en", "a", 1) for i in range(2, 50)], DOCS).repartition(3)
    got = exact_dedup.exact_groups(df, keep="max").groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("keep_id = 1").collect()
    assert [(r["group_size"], r["kept"], r["n"]) for r in got] == [(400, 1, 400)]
