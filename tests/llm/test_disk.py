"""What the steps of the n-gram join leave on disk, and n-grams too frequent to be told apart."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark import SparkFiles

from corpusloom.llm import components, ngram_join


def test_shuffles_go_with_their_step(spark):
    top = Path(SparkFiles.getRootDirectory()).parents[1]

    def held():
        return set(top.glob("blockmgr-*/*/shuffle_*.data"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(setting)
    grouped = spark.range(5_000, numPartitions=3).selectExpr("id % 700 AS a", "id AS b").groupBy("a").count()
    grouped.collect()
    kept = held() - before
    assert kept, "shuffle files are looked for in the wrong place"
    assert ngram_join._stored(grouped, "grouped").schema.names == ["a", "count"]
    assert components._written(grouped.toDF("a", "b")).schema.names == ["a", "b"]
    for _ in range(40):
        left = held() - before - kept
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get(setting) == was


@pytest.mark.parametrize("most", [1, 3])
def test_components_do_not_depend_on_told_frequencies(spark, monkeypatch, most):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 60)}" for _ in range(60)]
        for _ in range(5):
            near = list(base)
            near[rng.randrange(60)] = "odd"
            texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        return sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())

    told = found()
    monkeypatch.setattr(ngram_join, "MOST_DF", most)
    assert found() == told
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert told == [(i, len(sets[i]), root[i]) for i in range(len(texts))]
    assert len(set(root)) < len(root)
