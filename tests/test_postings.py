"""Stored postings against a search that reads the texts; updates, deletions, skipped blocks."""

import random

import pytest

from skemara.operators import postings as X
from skemara.operators import retrieval as R
from skemara.sources.scratch import scratch

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, seed, n=300, first=0):
    r = random.Random(seed)
    rows = [(first + i, " ".join(WORDS[min(59, int(r.expovariate(0.08)))] for _ in range(r.choice([0, 3, 20, 90])))) for i in range(n)]
    return spark.createDataFrame([*rows, (first + n, None), (first + n + 1, "the of !?")], "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "w0 w1 w40"), (1, "w55"), (2, "nothing of this"), (3, "w3 w3 w2 the w59 w58"), (4, None)], "query_id int, text string")


def rows(df, key="key"):
    return sorted((r["query_id"], r["rank"], r[key], round(r["score"], 7)) for r in df.collect())


def same(index, docs, queries, k=10):
    want = rows(R.bm25(docs, queries, k), "doc_id")
    got, read = X.search(index, queries, k)
    every, whole = X.search(index, queries, k, skip=False)
    assert rows(got) == rows(every) == want and want
    assert read["read"] <= whole["read"] == whole["postings"] == read["postings"]
    return read


def test_search_updates_and_compaction(spark, queries):
    docs = corpus(spark, 1).cache()
    index = X.build(docs, "doc_id", X.text_terms())
    for turn in range(1):
        changed = corpus(spark, 7 + turn, 40, 30 * turn).cache()
        changed = changed.unionByName(corpus(spark, 20 + turn, 25, 1000 + 100 * turn))
        deleted = docs.filter(f"doc_id % 11 = {turn + 3}").join(changed, "doc_id", "left_anti").select("doc_id")
        index = X.update(index, changed, "doc_id", X.text_terms(), deleted)
        docs = docs.join(changed, "doc_id", "left_anti").join(deleted, "doc_id", "left_anti").unionByName(changed).cache()
        assert index.size()[0] == docs.count()
    again = X.Index.open(spark, index.root)
    assert len(again.generations) == 2
    same(again, docs, queries, 3)
    small = X.compact(index)
    assert len(small.generations) == 1 and small.size() == index.size()
    assert rows(X.search(small, queries)[0]) == rows(X.search(index, queries)[0])


def test_second_search_reads_no_text(spark, queries):
    path = scratch(spark, "texts") + "/docs"
    corpus(spark, 3).write.parquet(path)
    index = X.build(spark.read.parquet(path), "doc_id", X.text_terms())
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    assert X.search(index, queries)[0].count() > 10


def test_blocks_are_skipped(spark):
    r = random.Random(5)
    data = [(i, " ".join(["common"] * r.randrange(1, 4) + [f"x{j}" for j in range(r.randrange(5, 60))] + (["rare"] * 5 if i % 400 == 7 else []))) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    q = spark.createDataFrame([(0, "common rare"), (1, "common")], "query_id int, text string")
    read = same(X.build(docs, "doc_id", X.text_terms()), docs, q, 5)
    assert read["read"] < read["postings"] / 4


def test_broken_generation_is_no_part(spark, queries):
    docs = corpus(spark, 4)
    index = X.build(docs, "doc_id", X.text_terms())
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{index.root}/gen-000001-broken/postings")
    assert X.Index.open(spark, index.root).generations == index.generations


def test_columns_and_empty_tables(spark, queries):
    df = spark.createDataFrame([(1, "Red car", 7), (2, "red", None), (3, None, 7)], "id int, name string, size int")
    index = X.build(df, "id", X.column_terms(["name", "size"]))
    asked = spark.createDataFrame([(0, "a", "name=red"), (0, "b", "size=7"), (1, "a", "name=none")], "query_id int, group string, term string")
    found = X.lookup(index, asked)
    assert sorted((r["query_id"], r["group"], r["key"]) for r in found.collect()) == [(0, "a", 1), (0, "a", 2), (0, "b", 1), (0, "b", 3)]
    assert [(r["query_id"], r["key"]) for r in R.intersect_groups(found.drop("term")).collect()] == [(0, 1)]
    none = X.build(df.limit(0), "id", X.column_terms(["name"]))
    assert X.lookup(none, asked).count() == 0 and X.search(none, queries)[0].count() == 0
    gone = X.update(index, df.limit(0), "id", X.column_terms(["name", "size"]), df.select("id"))
    assert gone.size()[0] == 0 and X.lookup(gone, asked).count() == 0


def test_phrases_are_consumed_from_left_to_right(spark):
    phrases = spark.createDataFrame([("gold mine site", "a", 1), ("site east", "b", 1), ("mine", "c", 1), ("east", "b", 1), ("gold", "d", 1)], "phrase string, column string, n int")
    q = spark.createDataFrame([(0, "Gold mine site east, gold mine"), (1, "east gold EAST"), (2, "none"), (3, None), (4, "site east mine")], "query_id int, text string")
    got = {}
    for r in sorted(R.match_entities(q, phrases).collect(), key=lambda r: r["place"]):
        got.setdefault(r["query_id"], []).append(r["phrase"])
    assert got == {0: ["gold mine site", "east", "gold", "mine"], 1: ["east", "gold"], 4: ["site east", "mine"]}
    assert [r["phrase"] for r in R.match_entities(q.filter("query_id = 0"), phrases.filter("phrase IN ('gold mine site', 'site east')")).collect()] == ["gold mine site"]
    many = spark.createDataFrame([(0, " ".join(f"k{i}" for i in range(14)))], "query_id int, text string")
    words = spark.createDataFrame([(f"k{i}", "c", 1) for i in range(14)], "phrase string, column string, n int")
    assert [r["phrase"] for r in sorted(R.match_entities(many, words).collect(), key=lambda r: r["place"])] == [f"k{i}" for i in range(10)]
