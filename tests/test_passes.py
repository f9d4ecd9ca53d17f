"""Ranking in one pass, and what an index writes."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import postings, retrieval
from corpusloom.plans import index, search
from corpusloom.session import stored


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    names = [f"{a}{b}ameword" for a in "bcdfghjk" for b in "aeiou"]
    texts = [(i, "en", " ".join(rng.choices(names, k=30))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    asked = [(q, " ".join(rng.sample(names, 6)), 3) for q in range(8)]
    return index.build(docs, index.word_gazetteer(docs), 20), spark.createDataFrame(asked, "query_id long, text string, top_k int")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_graph_needs_no_term_vectors(small):
    idx = index.Index(**{f: getattr(small[0], f) for f in index.Index.__dataclass_fields__})
    idx.nodes.count(), idx.edges.count()
    assert "vectors" not in vars(idx)


def test_postings_are_stored_once_and_items_not_per_question(spark, small, monkeypatch):
    idx, asked = small
    rows = {}

    def noted(df, name, **kw):
        out = stored(df, name, **kw)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(postings, "stored", noted)
    built = postings.build(idx.vectors)
    found = postings.rank(built, asked, 3).select("query_id", "item", "score", "rank")
    assert "posting-blocks" not in rows
    want = search.naive(idx, asked).select("query_id", "item", "score", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # Pairs that cannot be among the best are gone before anything is written.
    met = idx.vectors.count() * asked.count()
    assert rows["query-items"] < met / 3


def test_items_and_questions_never_meet_as_rows(small):
    idx, asked = small
    assert "Join" not in plan_of(search.naive(idx, asked))


def test_many_entities_in_one_pass_give_what_lookups_give(small, monkeypatch):
    idx, asked = small
    rank = lambda: [sorted(map(tuple, f(idx, asked).collect())) for f in (search.local, search.global_)]
    monkeypatch.setattr(search, "FEW_KEYS", 0)
    passed = rank()
    monkeypatch.setattr(search, "FEW_KEYS", 10_000)
    assert passed == rank() and all(any(r[1] == "chunk" for r in part) for part in passed)


@pytest.mark.parametrize("per_block", [1, 256])
def test_blocks_of_questions(spark, monkeypatch, per_block):
    """Null and repeated questions, null weights, items without terms, ties and negative sums."""
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", per_block)
    items = spark.createDataFrame(
        [("b", ["x", "y"], [1.0, 2.0]), ("a", ["y"], [2.0]), ("c", [], []), ("d", ["x", "x"], [0.25, 0.25]), ("e", ["z"], [1.0])],
        "id string, term array<string>, share array<double>",
    )
    weights = spark.createDataFrame(
        [(1, 2, "y", 0.5), (1, 2, "z", None), (2, 1, "x", 1.0), (2, 1, "x", 1.0), (None, 2, "z", 3.0), (3, 2, "x", -1.0), (4, 0, "x", 1.0)],
        "query_id long, top_k int, term string, weight double",
    )
    got = retrieval.rank_by_terms(items, "id", stored(weights, "w")).select("query_id", "item", "score", "rank").collect()
    want = [(1, "a", 1.0, 1), (1, "b", 1.0, 2), (2, "b", 2.0, 1), (None, "e", 3.0, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
