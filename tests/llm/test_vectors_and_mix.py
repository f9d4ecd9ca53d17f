"""KD-tree search, source mixing and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import kd_search, mixing, queries
from tests.llm.fixtures import by_id, clashing, documents, empty, table
from tests.llm.test_texts import brute_components, brute_lines
from tests.llm.test_tokens import check_pieces

# ------------------------------------------------------------------ search


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("scale", "seed"), [(3, 0), (64, 1), (1 << 27, 2)])
def test_search(spark, monkeypatch, scale, seed):
    """Few values give ties and equal vectors; large ones leave floating point."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-scale, scale, (300, 6))
    vectors[50:90] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("shard", F.lit("x"))
    got = kd_search.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=90, query_rows=6)
    assert by_id(got, "query_id", "rank", "vec_id", "score") == sorted(brute_top(rows, 5), key=repr)


def test_tree_prunes():
    """Clustered vectors: a good bound leaves most leaves unvisited, with the same result."""
    rng = np.random.default_rng(3)
    vectors = (rng.integers(-400, 400, (16, 1, 4)) + rng.integers(-5, 5, (16, 100, 4))).reshape(-1, 4).astype(float)
    tree = kd_search.KdTree(np.arange(1600), vectors, leaf=16)
    query = vectors[7]
    bounds = tree.bounds(query[None])[0]
    ids, scores = tree.search(7, query, bounds, 10, kd_search._LOWEST)
    want = np.lexsort((np.arange(1600), -(vectors @ query)))
    assert ids.tolist() == [i for i in want if i != 7][:10]
    leaves = tree.nodes[:, 2] < 0
    assert (bounds[leaves] >= scores[-1]).sum() < leaves.sum() / 4
    assert tree.search(7, query, bounds, 10, int(scores[-1]))[0].tolist() == ids.tolist()


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, [1.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = df.select("vec_id", kd_search.quantised(F.col("embedding")).alias("vector"))
    assert by_id(kd_search.top_k(vectors, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 32 * 64 - 64)]
    assert kd_search.top_k(vectors.filter("vec_id > 99"), F.col("vec_id") % 20 == 0).count() == 0
    twice = vectors.filter("vec_id < 2").unionAll(vectors.filter("vec_id < 2"))
    assert by_id(kd_search.top_k(twice, F.col("vec_id") == 0), "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 1)]


# ------------------------------------------------------------------ mixing


def test_schedule_stays_within_a_block():
    rng = random.Random(0)
    for _ in range(60):
        weights = {f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 12))}
        parts = mixing.parts_of(weights, 200)
        slots, counts = mixing.schedule(parts), dict.fromkeys(parts, 0)
        assert len(slots) == sum(parts.values())
        for t, source in enumerate(slots * 2, 1):
            counts[source] += 1
            assert all(abs(counts[s] - t * parts[s] / len(slots)) < 1 for s in parts)


def test_plan_places_every_block_once():
    rng = random.Random(1)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(0, 900) for i in range(rng.randint(1, 9))}
        weights = {s: rng.choice([0, 1, 3, 8]) for s in blocks}
        slots, seen = set(), {s: [] for s in blocks}
        for source, first, last, offset, period, mine in mixing.plan(blocks, weights, 100):
            for i in range(last - first + 1):
                slots.add(offset + period * (i // len(mine)) + mine[i % len(mine)])
                seen[source].append(first + i)
        assert slots == set(range(sum(blocks.values())))
        assert all(seen[s] == list(range(n)) for s, n in blocks.items())


def test_plan_keeps_to_the_given_weights():
    """Weights that divide no period, a tiny one among them, over many slots."""
    blocks = {"hot": 9_000, "tiny": 1, **{f"s{i}": 150 + 37 * i for i in range(12)}}
    for weights in (mixing.default_weights(blocks), {s: 0.1 + 3.7 * (s == "hot") + 1e-6 * n for s, n in blocks.items()} | {"tiny": 1e-5}):
        order = {}
        for source, first, last, offset, period, mine in mixing.plan(blocks, weights):
            order |= {int(offset + period * (i // len(mine)) + mine[i % len(mine)]): source for i in range(last - first + 1)}
        counts, total = dict.fromkeys(blocks, 0), sum(weights.values())
        end = int(min(n * total / weights[s] for s, n in blocks.items()))
        assert sorted(order) == list(range(sum(blocks.values()))) and end > 100
        for t in range(end):
            counts[order[t]] += 1
            assert all(abs(counts[s] - (t + 1) * w / total) < 1 for s, w in weights.items())


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 40)
    rows = [(i, "t", "en", "big" if i % 3 else ("b" if i % 2 else None), 1) for i in range(900)] + [(None, None, None, "", None)] * 2
    weights = {"big": 2.0, "b": 1.0, "": 1.0}
    docs = clashing(table(spark, rows))
    out = mixing.mix(docs, weights, block_docs=4, period=20)
    got = sorted(out.select("mix_position", "mix_slot", "mix_block", "source", "doc_id").collect(), key=lambda r: r[0])
    assert len(got) == len(rows) and len({r["mix_position"] for r in got}) == len(rows)
    assert out.columns == [*docs.columns, "mix_block", "mix_slot", "mix_position"]
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot"], set()).add((r["source"] or "", r["mix_block"]))
        assert r["mix_position"] // 4 == r["mix_slot"]
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    counts = dict.fromkeys(weights, 0)
    for t in range(1, 150):  # before a source is used up
        counts[next(iter(slots[t - 1]))[0]] += 1
        assert all(abs(counts[s] - t * w / 4) < 1 for s, w in weights.items())
    ordered = mixing.mixed_order(docs, weights, 4)
    assert ordered.columns == docs.columns
    again = mixing.mix(table(spark, rows, 7), weights, block_docs=4, period=20)
    assert by_id(out, "doc_id", "mix_position") == by_id(again, "doc_id", "mix_position")


def test_mix_of_very_many_sources(spark):
    """More sources than ten thousand, of several sizes."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.floor(F.sqrt("id"))).alias("source"))
    docs = docs.unionAll(spark.range(21_000, 31_600).select("id", F.concat(F.lit("e"), F.col("id"))))
    assert docs.select("source").distinct().count() > 10_000
    got = mixing.mix(docs, block_docs=2).select("doc_id", "mix_slot", "mix_position").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(31_600)) and len({r["mix_position"] for r in got}) == len(got)
    slots = {r["mix_slot"] for r in got}
    assert slots == set(range(len(slots)))


def test_mix_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_order(empty(spark)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = [r for r in documents(n=150) if r[0] is not None]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = [tuple(r) for r in docs.collect()]
    first = seen["language ID"]
    kept = {r[0] for r in first}
    # Four labels or none on one invented language: all texts with letters stay.
    assert kept == {r[0] for r in at if any(c.isalpha() for c in r[1] or "")}
    lines = {r[0]: r[3] for r in brute_lines(first)}
    assert {r[0]: r[1] for r in seen["line dedup"]} == lines
    assert all(r[4] == len(r[1]) for r in seen["line dedup"] if lines[r[0]] != dict((x[0], x[1]) for x in first)[r[0]])
    roots = brute_components(seen["line dedup"])
    assert {r[0] for r in seen["n-gram Jaccard join"]} == {d for d, (_, root) in roots.items() if root == d}
    assert sorted(seen["source mixing"]) == sorted(seen["n-gram Jaccard join"])
    packed = docs.select("doc_id").distinct().count()
    assert packed == len(seen["source mixing"])
    check_pieces_without_ids(seen["source mixing"], docs.collect())


def test_packing_keeps_the_mix_over_several_files(spark, tmp_path):
    """The last phase is the long texts of one source alone: its files are the largest."""
    rows = [(i, "word " * (20 if i % 10 == 0 else 200), "en", "small" if i % 10 == 0 else "hot", 1) for i in range(1000)]
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        corpus_pipeline.mixed(spark, table(spark, rows), str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
        docs = spark.read.parquet(f"{tmp_path}/mixed")
        assert len(docs.inputFiles()) > 2
        pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).filter("start = 0").select("sequence_id", "offset", "doc_id").collect()
    finally:
        spark.conf.set(coalesced, "true")
    order = [r["doc_id"] % 10 == 0 for r in sorted(pieces)]
    assert len(order) == len(rows)
    # The small source has 2 slots for 5.4 of the other and is used up before half of the mix.
    assert 0.15 < sum(order[:250]) / 250 < 0.4 and not any(order[750:])


def check_pieces_without_ids(rows, pieces):
    from tests.llm.test_tokens import library

    texts = {r[0]: [*library(r[1]), 0] for r in rows}

    class Piece(dict):
        pass

    check_pieces(rows, [Piece(p.asDict(), ids=texts[p["doc_id"]][p["start"] : p["start"] + p["length"]]) for p in pieces], 1024)


def test_all_queries_are_there():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES if name != "pipeline"]
    assert sorted(numbers) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    from verification.check import compare, connect

    verdict, *_ = compare(spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    assert verdict.startswith("ok"), verdict
