"""Lookup layouts, the inverted index and the vector index against plain joins and brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, retrieval, shelves, vector_index
from corpusloom.plans import search
from corpusloom.plans.index import build, word_gazetteer
from corpusloom.session import buckets_for, power_of_two, stored

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ sizes


def test_counts_come_from_what_is_there(spark):
    """A DataFrame of unknown size, and a join, ask for the buckets of their rows."""
    assert [power_of_two(x) for x in (0, 1, 1.5, 2, 5, 1024, 1025)] == [1, 1, 2, 2, 8, 1024, 2048]
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(200)], "id long, text string")
    cores = spark.sparkContext.defaultParallelism
    joined = docs.join(docs.select("id"), "id").mapInPandas(lambda it: it, "id long, text string")
    for df in (docs, joined):
        assert buckets_for(df) == power_of_two(cores)
        assert buckets_for(df, bucket_bytes=1000) == 256
    twice = docs.unionAll(docs)
    assert buckets_for(twice, bucket_bytes=1000) == 512
    assert buckets_for(docs.filter("id < 0")) == power_of_two(cores)


# ------------------------------------------------------------------ shelves


@pytest.fixture(scope="module")
def shelved(spark):
    rows = [(f"k{i % 40}", i) for i in range(200)] + [("hub", i) for i in range(300)] + [(None, 1)]
    df = stored(spark.createDataFrame(rows, "key string, value long"), "shelf-rows")
    return df, shelves.shelve(df, ("key",), "shelf-test", rows_per_part=32, rows_per_shelf=16)


def opened(table, wanted) -> int:
    """How many files a lookup reads."""
    return table.at(table.asked(wanted)).select(F.input_file_name()).distinct().count()


def test_lookup_is_the_join(spark, rows, shelved):
    df, table = shelved
    wanted = spark.createDataFrame([("k3", 1), ("hub", 2), ("none", 3), (None, 4), ("k3", 5)], "key string, asked int")
    assert rows(table.lookup(wanted), "key", "value", "asked") == rows(df.join(wanted, "key"), "key", "value", "asked")
    assert table.lookup(wanted.filter("asked > 9")).count() == 0
    assert {r.parts for r in table.hubs.collect()} == {10}


def test_a_lookup_opens_its_shelves_only(spark, shelved):
    _, table = shelved
    one = spark.createDataFrame([("k3",)], "key string")
    few = table.lookup(one)
    assert shelves.SHELF in plan_of(few).split("PartitionFilters: [")[1][:80]
    assert opened(table, one) == 1
    assert 1 < opened(table, spark.createDataFrame([("hub",)], "key string")) <= 10 < table.rows.select(shelves.SHELF).distinct().count()


# ------------------------------------------------------------------ postings


def word(i: int) -> str:
    return "w" + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]


def brute_rank(texts, asked, k):
    """Cosine of log-weighted terms by definition."""
    vectors = {i: Counter(t.split()) for i, t in texts}
    df = Counter(t for v in vectors.values() for t in v)
    out = []
    for q, text in asked:
        tf = {t: n for t, n in Counter(text.split()).items() if t in df}
        w = {t: (1 + math.log(n)) * math.log(len(texts) / df[t]) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        scores = []
        for i, v in vectors.items():
            size = math.sqrt(sum((1 + math.log(n)) ** 2 for n in v.values()))
            score = sum(w[t] / norm * (1 + math.log(v[t])) / size for t in w if t in v) if norm else 0
            if round(score, 6) > 0:
                scores.append((-round(score, 6), i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    """Words in falling frequency: some in nearly all items, some in one."""
    rng = random.Random(3)
    words = [word(i) for i in range(250)]
    weights = [1 / (i + 1) for i in range(250)]
    texts = [(f"c{i:04d}", " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(600)]
    texts += [(f"same{i}", f"{word(1)} {word(3)} {word(200)}") for i in range(9)]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    return texts, stored(retrieval.term_vectors(df, "chunk_id"), "test-vectors")


ASKED = [
    (1, f"{word(0)} {word(1)} {word(2)}"),  # in nearly every item
    (2, f"{word(0)} {word(200)} {word(1)} {word(1)}"),
    (3, f"{word(240)} {word(241)} unknown"),
    (4, "unknown words"),
    (5, f"{word(1)} {word(3)} {word(200)}"),  # ties
    (6, " ".join(map(word, range(60)))),
]


@pytest.mark.parametrize(("k", "block"), [(1, 512), (4, 4), (5_000, 4)])
def test_ranking_is_exact(spark, rows, corpus, k, block):
    texts, vectors = corpus
    index = postings.build(vectors, block=block, blocks_per_part=3)
    asked = spark.createDataFrame([(q, t, k) for q, t in ASKED], "query_id long, text string, top_k int")
    got = rows(postings.rank(index, asked, k), "query_id", "item", "score", "rank")
    want = brute_rank(texts, ASKED, k)
    assert [g[:2] + g[3:] for g in sorted(got)] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(sorted(got), want))


def test_little_is_read(spark, corpus):
    """Frequent terms are not needed to find items; rare terms open few shelves."""
    _, vectors = corpus
    index = postings.build(vectors, block=4, blocks_per_part=3)
    asked = spark.createDataFrame([(2, " ".join(map(word, (0, 200, 1, 1, 2))), 3)], "query_id long, text string, top_k int")
    weights = stored(postings.weigh(index, asked), "w")
    planned = {r.term: r for r in postings.plan(weights, postings.floors(index, weights)).collect()}
    assert planned[word(200)].needed and not planned[word(0)].needed

    def shelves_of(*terms):
        df = spark.createDataFrame([(t,) for t in terms], "term string")
        assert shelves.SHELF in plan_of(index.blocks.lookup(df)).split("PartitionFilters: [")[1][:80]
        return opened(index.blocks, df)

    assert shelves_of(word(249)) <= 2 < shelves_of(word(0))
    sizes = index.blocks.rows.groupBy("term", "piece").agg(F.max("n").alias("n")).agg(F.max("n")).first()[0]
    assert sizes < 30


def test_searches_open_the_shelves_they_need(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    idx = build(docs, word_gazetteer(spark.read.parquet(f"{SF_DIR}/benchmark.parquet")), 100)
    name = idx.edges.orderBy("source", "target").first().source
    asked = spark.createDataFrame([(1, name, 3)], "query_id long, text string, top_k int")
    idx.lay_out()
    for found in (search.local(idx, asked), search.global_(idx, asked)):
        assert re.search(rf"PartitionFilters: \[[^\]]*{shelves.SHELF}#", plan_of(found))


# ------------------------------------------------------------------ vectors


def _vectors(n=1_500, dim=8, clusters=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 3
    x = centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * 0.3
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def _brute(vectors, asked, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = []
    for q, v in asked:
        v = np.array(v, float) / np.linalg.norm(np.array(v, float))
        scores = np.round(x @ v, 6)
        out += [(q, int(ids[j]), rank) for rank, j in enumerate(np.lexsort((ids, -scores))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "cells"), [(3, None), (10, 1), (7, 60), (2_000, None)])
def test_index_search_is_exact(spark, rows, k, cells):
    data = _vectors() + [(5_000 + i, [1.0] * 8) for i in range(40)]
    vectors = spark.createDataFrame(data, "item_id long, embedding array<float>")
    index = vector_index.build(vectors, cells=cells)
    asked = [r for r in data if r[0] % 100 == 0]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    found = vector_index.nearest(index, queries, k)
    assert sorted(rows(found, "query_id", "item_id", "rank")) == _brute(data, asked, k)


def test_cells_are_passed_over(spark, rows):
    data = _vectors()
    vectors = spark.createDataFrame(data, "item_id long, embedding array<float>")
    index = vector_index.build(vectors)
    one = spark.createDataFrame([(0, data[0][1])], "query_id long, embedding array<float>")
    found = vector_index.nearest(index, one, 5)
    assert 0 < len(index.cells_read) < len(index.centres) / 3
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan_of(found))
    assert sorted(rows(found, "query_id", "item_id", "rank")) == _brute(data, [(0, data[0][1])], 5)


def test_probes_and_recall(spark, rows):
    """A few cells give most neighbours, all cells give all."""
    rng = np.random.default_rng(0)
    data = [(i, v.tolist()) for i, v in enumerate((rng.standard_normal((2_000, 12)) + rng.integers(0, 2, (2_000, 12)) * 2).astype(np.float32))]
    vectors = spark.createDataFrame(data, "item_id long, embedding array<float>")
    index = vector_index.build(vectors)
    asked = [r for r in data if r[0] % 100 == 0]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    want = {w[:2] for w in _brute(data, asked, 10)}

    def recall(probes):
        return len(want & set(rows(vector_index.nearest(index, queries, 10, probes), "query_id", "item_id"))) / len(want)

    few, some = recall(1), recall(20)
    assert few < 1 and some >= 0.9 and few <= some and recall(len(index.centres)) == 1


def test_odd_vectors(spark, rows):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0])]
    vectors = spark.createDataFrame([*data, (None, [1.0, 1.0])], "item_id long, embedding array<float>")
    index = vector_index.build(vectors)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [0.0, 0.0]), (10, [1.0]), (11, None)], "query_id long, embedding array<double>")
    want = [(7, 1, 1.0, 1), (7, 4, 0.707107, 2), (8, 2, 1.0, 1), (8, 4, 0.707107, 2)]
    assert rows(vector_index.nearest(index, queries, 2)) == want
    assert vector_index.nearest(index, queries.limit(0), 2).count() == 0
    assert vector_index.nearest(vector_index.build(vectors.limit(0)), queries, 2).count() == 0
    assert vector_index.build(vectors.filter("item_id = 3")) is None
