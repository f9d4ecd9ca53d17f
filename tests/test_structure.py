"""Chunks along headings and names of several words against definitions by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import chunking, graph
from corpusloom.plans.index import phrase_gazetteer

PAGE = """before

# One
a b c
d e
## Two
x
### Deep  
y z
## Three
####### no heading
#nor this
# Last
### Skipped
w"""


def _cut(spark, text, size):
    docs = spark.createDataFrame([(1, text)], "id INT, text STRING")
    return [(tuple(r.headings), r.text, r.n_tokens) for r in chunking.structured_chunks(docs, ["id"], size).orderBy("seq").collect()]


def test_chunks_keep_to_headings(spark):
    assert _cut(spark, PAGE, 100) == [
        ((), "before\n", 1),
        (("One",), "a b c\nd e", 5),
        (("One", "Two"), "x", 1),
        (("One", "Two", "Deep"), "y z", 2),
        (("One", "Three"), "####### no heading\n#nor this", 5),
        (("Last", "Skipped"), "w", 1),
    ]
    assert _cut(spark, PAGE, 3)[1:3] == [(("One",), "a b c", 3), (("One",), "d e", 2)]
    assert _cut(spark, "# only\n## headings\n", 5) == _cut(spark, "", 5) == _cut(spark, None, 5) == []
    assert _cut(spark, "one two three four five", 2) == [((), "one two", 2), ((), "three four", 2), ((), "five", 1)]


def test_many_headings(spark):
    text = "\n".join(f"{'#' * (i % 6 + 1)} h{i}\nt{i}" for i in range(600))
    got = _cut(spark, text, 10)
    assert len(got) == 600 and got[-1][0] == tuple(f"h{i}" for i in range(594, 600))


def _brute(words, names):
    out, at = [], 0
    while at < len(words):
        n = next((n for n in range(5, 0, -1) if at + n <= len(words) and " ".join(words[at : at + n]) in names), 0)
        if n:
            out.append((at, " ".join(words[at : at + n]), words[at + n] if at + n < len(words) else None))
        at += max(1, n)
    return out


def test_names_of_several_words(spark):
    rng = random.Random(4)
    names = {" ".join(rng.choice("abc") * 2 for _ in range(rng.randint(1, 5))) for _ in range(30)}
    texts = [(f"c{i}", i, " ".join(rng.choice("abcd") * 2 for _ in range(rng.randint(0, 40))), "en") for i in range(80)]
    chunks = spark.createDataFrame(texts, "chunk_id STRING, doc_id LONG, text STRING, lang STRING")
    gazetteer = spark.createDataFrame([(n,) for n in sorted(names)], "term STRING")
    found = graph.phrase_mentions(chunks, gazetteer)
    got = sorted((r.chunk_id, r.pos, r.name, r.link) for r in found.collect())
    assert got == sorted((c, *hit) for c, _, text, _ in texts for hit in _brute(text.split(), names))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert graph.phrase_mentions(chunks, gazetteer.limit(0)).count() == 0
    typed = gazetteer.withColumn("entity_type", F.lit("kind"))
    assert {r.entity_type for r in graph.phrase_mentions(chunks, typed).collect()} == {"kind"}
    assert graph.relation_pairs(found).count() > 0


def test_phrase_gazetteer(spark):
    texts = spark.createDataFrame([("Alphabet bravado to charlie deltas echoes, fox",)], "text STRING")
    got = {r.term for r in phrase_gazetteer(texts).collect()}
    assert got == {"alphabet bravado", "charlie deltas", "deltas echoes", "charlie deltas echoes"}
