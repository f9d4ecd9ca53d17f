"""What the inverted index packs, stores and leaves on disk."""

from __future__ import annotations

import hashlib
import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from corpusloom.operators import postings, retrieval
from corpusloom.session import stored
from tests.test_layouts import ASKED, brute_rank, word


def vectors_of(spark, texts, kind, parts=3):
    df = spark.createDataFrame(texts, f"chunk_id {kind}, text string").repartition(parts)
    return stored(retrieval.term_vectors(df, "chunk_id"), "test-vectors")


def texts_of(n, names, seed=4):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(250)]
    return [(names(i), " ".join(map(word, rng.choices(range(250), weights, k=rng.randint(0, 40))))) for i in range(n)]


def test_numbers_are_packed_and_read():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 33) - 1, 1 << 33, (1 << 62) + 5, (1 << 63) - 1, 3], np.uint64)
    data, width = postings._packed(values)
    assert width.tolist() == [1, 1, 1, 2, 2, 3, 5, 5, 9, 9, 1] and len(data) == width.sum()
    assert postings._numbers(data).tolist() == values.tolist()


@pytest.mark.parametrize(("flush", "packed", "unpacked", "block"), [(1, 1, 1, 4), (90, 16, 64, 4), (10**6, 99, 1 << 20, 16)])
def test_ranking_is_exact_however_postings_are_cut(spark, rows, monkeypatch, flush, packed, unpacked, block):
    """Long ids in no order, items without terms, many and few postings at a time."""
    monkeypatch.setattr(postings, "FLUSH", flush)
    monkeypatch.setattr(postings, "PACKED", packed)
    monkeypatch.setattr(postings, "UNPACKED", unpacked)
    texts = texts_of(300, lambda i: i * 7919 % 300 - 100)
    asked = spark.createDataFrame([(q, t, 5) for q, t in ASKED], "query_id long, text string, top_k int")
    index = postings.build(vectors_of(spark, texts, "long"), block=block, blocks_per_part=3)
    got = sorted(rows(postings.rank(index, asked, 5), "query_id", "item", "score", "rank"))
    want = brute_rank(texts, ASKED, 5)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_no_texts(spark):
    index = postings.build(vectors_of(spark, [], "string"))
    asked = spark.createDataFrame([(1, word(1), 5)], "query_id long, text string, top_k int")
    assert postings.rank(index, asked, 5).count() == 0


def test_a_posting_is_a_few_bytes(spark):
    texts = texts_of(3_000, lambda i: hashlib.md5(b"%d" % i).hexdigest())
    vectors = vectors_of(spark, texts, "string")
    n = vectors.select(F.inline("terms")).count()
    index = postings.build(vectors)
    held = sum(Path(urlparse(f).path).stat().st_size for f in index.blocks.rows.select("entries").inputFiles())
    assert held - 40 * len(texts) < 8 * n  # the items' names lie beside them


def test_the_layout_leaves_no_shuffle_files(spark):
    top = Path(SparkFiles.getRootDirectory()).parents[1]
    vectors = vectors_of(spark, texts_of(200, str), "string")

    def held():
        return set(top.glob("blockmgr-*/*/shuffle_*.data"))

    before = held()
    postings.shelve(vectors.select("chunk_id", "norm"), ("chunk_id",), "shelves-test", n_rows=10)
    stored(vectors.groupBy("norm").count(), "stored-test")
    stored(vectors.groupBy("chunk_id").agg(F.first("norm")), "bucketed-test", bucket_by="chunk_id", buckets=3)
    for _ in range(40):
        if not held() - before:
            break
        time.sleep(0.25)
    assert not held() - before


def test_bucketed_tables_keep_their_rows_and_settings(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id").groupBy("k").agg(F.max("id").alias("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    table = stored(df, "buckets-test", bucket_by="k", buckets=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
