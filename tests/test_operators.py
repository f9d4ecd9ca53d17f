from __future__ import annotations

import ast
import random

import pytest
from corpusloom import schemas
from corpusloom.functions import hooks
from corpusloom.functions import text as tx
from corpusloom.operators import chatlog, chunking, code, context, graph, retrieval, skew, summaries
from corpusloom.plans import ingest as runs
from corpusloom.plans import search
from corpusloom.plans.index import build, word_gazetteer
from corpusloom.options import Options
from corpusloom.sources import sinks
from corpusloom.streaming import ingest
from pyspark.sql import functions as F

PYTHON = """import os

class A:
    def f(self):
        return 1

    async def g(self):
        x = 2

        return x

def top():
    pass

print(top())
"""

SCRIPT = """// class Not {
class A extends B {
  constructor(a) {
    this.s = "} not an end {";
  }
  /* method() {
  } */
  get(x) { return x; }
}
function f(a) {
  if (a) {
    return [1].map((x) => {
      return x;
    });
  }
}
const h = x => x + 1;
"""


def _files(spark, *texts):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(texts)], schemas.CODE_FILES)


def test_python_blocks(spark, rows):
    closing = "def f(\n    a,\n):\n    return a\nx = 1"
    df = _files(spark, ("a.py", PYTHON), ("b.py", "x = 1\n\nprint(x)\n"), ("c.py", ""), ("d.py", closing))
    got = rows(code.python_blocks(df), "file_id", "start_line", "end_line", "type")
    assert got == [
        (0, 12, 13, "function_definition"),
        (0, 3, 10, "class_definition"),
        (0, 4, 5, "function_definition"),
        (0, 7, 10, "function_definition"),
        (1, 1, 3, "module"),
        (3, 1, 4, "function_definition"),
    ]
    text = code.python_blocks(df).filter("file_id = 0 AND start_line = 4").first().text
    assert text == "def f(self):\n        return 1"


def test_script_blocks(spark, rows):
    got = rows(code.script_blocks(_files(spark, ("a.ts", SCRIPT))), "start_line", "end_line", "type")
    assert got == [
        (10, 16, "function_declaration"),
        (12, 14, "arrow_function"),
        (17, 17, "arrow_function"),
        (2, 9, "class_declaration"),
        (3, 5, "method_definition"),
        (8, 8, "method_definition"),
    ]


def test_dispatch(spark, rows):
    long = "\n".join(f"line {i}" for i in range(1601))
    df = _files(
        spark, ("a.py", PYTHON), ("b.lua", long), ("c.js", "var x = 1;"), ("d.md", "one\ntwo"), ("e.txt", " \n")
    )
    got = rows(code.file_chunks(df).filter("path <> 'a.py'"), "path", "type", "start_line", "end_line", "seq")
    assert got == [
        ("b.lua", "fallback_chunk", 1, 800, None),
        ("b.lua", "fallback_chunk", 1601, 1601, None),
        ("b.lua", "fallback_chunk", 801, 1600, None),
        ("c.js", "fallback_chunk", 1, 1, None),
        ("d.md", "document_chunk", None, None, 0),
    ]


def _random_docs(spark, n=60, seed=5):
    rnd = random.Random(seed)
    texts = []
    for i in range(n):
        lines = [
            " ".join(rnd.choice(["a", "bb", "ccc", "dddd"]) for _ in range(rnd.choice([0, 1, 3, 9, 30])))
            for _ in range(rnd.randrange(0, 12))
        ]
        texts.append((i, "\n".join(lines)))
    return spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), dict(texts)


def test_windows_rebuild_the_text(spark):
    docs, texts = _random_docs(spark)
    for size, overlap in ((7, 0), (7, 3), (1, 0)):
        got = {}
        for r in chunking.token_windows(docs, ["doc_id"], size, overlap).orderBy("doc_id", "seq").collect():
            words = r.text.split()
            assert 0 < len(words) == r.n_tokens <= size
            got.setdefault(r.doc_id, []).extend(words if r.seq == 0 else words[overlap:])
        assert got == {i: t.split() for i, t in texts.items() if t.split()}
    lines = {}
    for r in chunking.line_windows(docs, "doc_id", 4).collect():
        part = texts[r.doc_id].split("\n")[r.start_line - 1 : r.end_line]
        assert r.text == "\n".join(part) and r.text.strip()
        lines[r.doc_id] = lines.get(r.doc_id, 0) + len(part)
    with pytest.raises(ValueError):
        chunking.token_windows(docs, ["doc_id"], 5, 5)


def test_paragraph_pack_keeps_tokens_and_limit(spark):
    docs, texts = _random_docs(spark)
    got = {}
    for r in chunking.paragraph_pack(docs, ["doc_id"], 10).orderBy("doc_id", "seq").collect():
        assert r.n_tokens == len(r.text.split()) <= 10
        got.setdefault(r.doc_id, []).extend(r.text.split())
    assert got == {i: t.split() for i, t in texts.items() if t.split()}


def test_term_counts(spark):
    docs, texts = _random_docs(spark)
    for r in docs.select("doc_id", tx.term_counts(tx.words(F.col("text"))).alias("t")).collect():
        words = texts[r.doc_id].split()
        assert {t.term: t.tf for t in r.t} == {w: words.count(w) for w in words}


def test_salted_join_equals_plain_join(spark, rows):
    big = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(big, keyed, "k", how, min_rows=100), "k", "id") == rows(
            big.join(keyed, "k", how), "k", "id"
        )
    assert [r.k for r in skew.hot_keys(big, "k", 100).collect()] == [0]


def test_numbered_has_no_gaps(spark):
    got = [r.row_no for r in skew.numbered(spark.range(500), F.col("id").cast("string")).collect()]
    assert sorted(got) == list(range(1, 501))


def test_next_row_crosses_stretches(spark):
    df = spark.createDataFrame([(1, t, f"x{t}") for t in (0, 1, 4, 9, 10, 25)] + [(2, 3, "y")], "g INT, t INT, v STRING")
    got = {(r.g, r.t): r.next_v for r in skew.next_row(df, "g", "t", ["v"], span=5).collect()}
    assert got == {(1, 0): "x1", (1, 1): "x4", (1, 4): "x9", (1, 9): "x10", (1, 10): "x25", (1, 25): None, (2, 3): None}


def test_chat(spark, rows):
    log = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"), (2, 0, "assistant", "b")],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    )
    assert rows(chatlog.pairs(log)) == [(1, 1, 2, "q", "a")]
    new = spark.createDataFrame([(1, 0, "assistant", "z"), (3, 0, "user", "n"), (3, 1, "assistant", "m")], "conv_id BIGINT, seq INT, role STRING, text STRING")
    added = chatlog.append(log, new).subtract(log.select("conv_id", "turn", "role", "text"))
    assert rows(added, "conv_id", "turn", "text") == [(1, 4, "z"), (3, 0, "n"), (3, 1, "m")]


def test_relation_type(spark):
    cases = {
        "leadership,uses": "lead",
        "participates, located": "participate",
        "reuses": "uses",
        "Lead": "Lead",
        '"works with",team': "works with",
        "it occurs": "occurs",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "k STRING")
    assert {r[0]: r[1] for r in df.select("k", graph.relation_type(F.col("k"))).collect()} == cases


def _small_graph(spark):
    nodes = spark.createDataFrame([(n, "t", "d", "s") for n in "abcdexyzi"], schemas.NODES)
    pairs = ["ab", "bc", "cd", "de", "xy", "yz", "xz"]
    edges = spark.createDataFrame([(p[0], p[1], float(i), "d", "k", "s") for i, p in enumerate(pairs)], schemas.EDGES)
    return nodes, edges


def test_neighbourhood_and_subgraph(spark, rows):
    nodes, edges = _small_graph(spark)
    seeds = spark.createDataFrame([("a",), ("x",)], "seed STRING")
    hops = graph.two_hop(edges, seeds)
    assert rows(hops) == [
        ("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0), ("x", "y", 1), ("x", "z", 1),
    ]
    shown = {r.id: r.hop for r in graph.highlight(nodes, hops.filter("seed = 'a'")).collect()}
    assert shown["i"] is None and shown["a"] == 0 and shown["d"] is None
    picked = spark.createDataFrame([("a",), ("b",), ("x",)], "id STRING")
    some_nodes, some_edges = graph.subgraph(nodes, edges, picked)
    assert rows(some_nodes, "id") == [("a",), ("b",), ("x",)]
    assert rows(some_edges, "source", "target") == [("a", "b")]
    all_nodes, all_edges = graph.subgraph(nodes, edges, picked.limit(0))
    assert all_nodes.count() == 9 and all_edges.count() == 7


def test_graph_filters(spark, rows):
    nodes, edges = _small_graph(spark)
    mixed = nodes.withColumn("entity_type", F.when(F.col("id") == "a", "").otherwise("ty"))
    assert len(rows(graph.filter_nodes(mixed, "entity_type", ["ty"]))) == 8
    assert len(rows(graph.filter_nodes(mixed, "entity_type", "some ty here"))) == 8
    # A weight of 0 counts as not set.
    assert rows(graph.filter_edges(edges, "weight", ["0", "1"])) == [("b",), ("c",)]


def test_endpoints_and_upsert(spark, rows):
    nodes, edges = _small_graph(spark)
    some = nodes.filter("id IN ('a', 'b', 'c')")
    assert rows(graph.edges_with_endpoints(edges, some), "source", "target") == [("a", "b"), ("b", "c")]
    dropped = rows(graph.edges_without_endpoints(edges, some))
    assert ("c", "d", False, True) in dropped and ("x", "y", True, True) in dropped and len(dropped) == 5
    new = spark.createDataFrame(
        [("a", "u", "d1", "s", 1), ("a", "w", "d2", "s", 2), ("new", "w", "d3", "s", 1)],
        schemas.NODES + ", batch INT",
    )
    merged = graph.node_upsert(some, new)
    assert rows(merged, "id", "entity_type", "display_name") == [
        ("a", "w", "a"), ("b", "t", "b"), ("c", "t", "c"), ("new", "w", "new"),
    ]


def test_relations_against_brute_force(spark, rows):
    rnd = random.Random(3)
    words = ["alphaa", "betaaa", "gammaa", "the", "of", "x"]
    texts = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(6)]
    chunks = spark.createDataFrame([(f"c{i}", i, "en", t) for i, t in enumerate(texts)], "chunk_id STRING, doc_id BIGINT, lang STRING, text STRING")
    gazetteer = word_gazetteer(chunks)
    found = graph.mentions(chunks, gazetteer)
    expected = {}
    for i, t in enumerate(texts):
        ws = t.split()
        for p, a in enumerate(ws):
            for b in ws[p + 1 : p + 6]:
                if a != b and len(a) >= 6 and len(b) >= 6:
                    key = (f"c{i}", min(a, b), max(a, b))
                    expected[key] = expected.get(key, 0) + 1
    pairs = graph.relation_pairs(found)
    assert {tuple(r[:3]): r[3] for r in pairs.select("chunk_id", "source", "target", "weight").collect()} == expected
    # The order of the input does not matter.
    again = graph.relation_merge(graph.relation_pairs(found.orderBy(F.rand(1))))
    assert rows(again) == rows(graph.relation_merge(pairs))
    typed = graph.mentions(chunks, gazetteer.withColumn("entity_type", F.lit("thing")))
    assert {r.entity_type for r in typed.collect()} == {"thing"}


def test_entity_type_ties_go_to_the_smaller_name(spark):
    found = spark.createDataFrame(
        [("c1", 1, "n", "b", 2), ("c2", 2, "n", "a", 2), ("c3", 3, "n", "z", 1)],
        "chunk_id STRING, doc_id BIGINT, name STRING, entity_type STRING, n BIGINT",
    )
    node = graph.entity_merge(found).first()
    assert (node.entity_type, node.n_mentions, node.n_sources, node.source_id) == ("a", 5, 3, "1")


# ---------------------------------------------------------------- retrieval


@pytest.fixture(scope="module")
def small_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gazetteer = word_gazetteer(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    return build(docs, gazetteer, 100)


def _ask(spark, *texts, k=10):
    return spark.createDataFrame([(i, t, k) for i, t in enumerate(texts)], "query_id BIGINT, text STRING, top_k INT")


def test_modes(spark, small_index):
    with pytest.raises(ValueError, match="Invalid search mode"):
        search.search(small_index, _ask(spark, "x"), "fuzzy")
    bad = _ask(spark, "x").withColumn("mode", F.lit("fuzzy"))
    with pytest.raises(Exception, match="Invalid search mode"):
        search.by_mode(small_index, bad).collect()
    assert retrieval.with_modes(_ask(spark, "x")).count() == 5


def test_limits_and_empty_results(spark, small_index):
    text = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    asked = _ask(spark, text, "zzzz qqqq", k=1_000_000)
    found = search.naive(small_index, asked)
    hits = found.collect()
    assert {r.query_id for r in hits} == {0} and len(hits) <= small_index.chunks.count()
    assert [r.rank for r in sorted(hits, key=lambda r: r.rank)] == list(range(1, len(hits) + 1))
    assert [r.query_id for r in retrieval.no_hits(asked, found).collect()] == [1]
    mixed_limits = asked.withColumn("top_k", F.lit(3))
    assert search.naive(small_index, mixed_limits).count() == 3


def test_hybrid_is_the_first_of_local_and_global(spark, small_index):
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text", F.lit(5).alias("top_k")
    )
    both: dict = {}
    for df in (search.local(small_index, asked), search.global_(small_index, asked)):
        for r in df.collect():
            items = both.setdefault((r["query_id"], r["part"]), {})
            items[r["item"]] = max(r["score"], items.get(r["item"], r["score"]))
    first = {
        (*group, item, rank)
        for group, items in both.items()
        for rank, item in enumerate(sorted(items, key=lambda i: (-items[i], i))[:5], 1)
    }
    got = search.hybrid(small_index, asked).select("query_id", "part", "item", "rank").collect()
    assert {tuple(r) for r in got} == first
    mixed = search.search(small_index, asked, "mix").groupBy("query_id").count().collect()
    assert max(r["count"] for r in mixed) <= 5
    by_mode = asked.withColumn("mode", F.when(F.col("query_id") % 2 == 0, "naive").otherwise("mix"))
    assert {r.mode for r in search.by_mode(small_index, by_mode).collect()} == {"naive", "mix"}


def test_vector_topk_blocks_and_zero_vectors(spark, rows, monkeypatch):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "item_id BIGINT, embedding ARRAY<FLOAT>"
    )
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [0.0, 0.0])], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    expected = [(7, 1, 1.0, 1), (7, 4, 0.707107, 2), (8, 2, 1.0, 1), (8, 4, 0.707107, 2)]
    assert rows(retrieval.vector_topk(vectors, asked, 2)) == expected
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 1)
    assert rows(retrieval.vector_topk(vectors, asked, 2)) == expected
    assert retrieval.vector_topk(vectors, asked.limit(0), 2).count() == 0


# ---------------------------------------------------------------- contexts


def test_context_entities(spark):
    text = "\n".join(
        [
            "x-----Entities-----", "```csv", "id, entity ,note", '1,"a, b",x', "", "1,a", "1,a,b,c", '1,"a, b',
            "```", "-----Relationships-----", "-----Sources-----",
        ]
    )
    df = spark.createDataFrame([(1, text), (2, "no marker"), (3, "-----Entities-----\na,b\n1,2")], schemas.CONTEXTS)
    got = {}
    for r in context.entities(df).orderBy("query_id", "row_no", "col_no").collect():
        got.setdefault((r.query_id, r.row_no), []).append((r.column, r.value))
    values = {k: [v for _, v in cells] for k, cells in got.items()}
    assert [c for c, _ in got[(1, 1)]] == ["id", "entity", "note"]
    assert values == {
        (1, 1): ["1", '"a, b"', "x"],
        (1, 3): ["1", "a", ""],
        (1, 4): ["1", "a", "b"],
        (1, 5): ["1", '"a, b', ""],
        (3, 1): ["1", "2"],
    }


def test_context_entity_table(spark, rows):
    text = "-----Entities-----\nid,name\n1,x\n2\n3,y,z"
    df = spark.createDataFrame([(1, text)], schemas.CONTEXTS)
    assert rows(context.entity_table(df, ["name", "id", "rank"])) == [
        (1, 1, "x", "1", None), (1, 2, "", "2", None), (1, 3, "y", "3", None),
    ]


def test_context_relationships(spark, rows):
    good = '-----Relationships-----\n```csv\nid,source,target,description\n0,a,b,"one, ""two""\nthree"\n\n1,c,d\n```\n-----Sources-----'
    wide = "-----Relationships-----\nid,source\n0,a,b\n-----Sources-----"
    df = spark.createDataFrame([(1, good), (2, "none"), (3, wide)], schemas.CONTEXTS)
    got = context.relationships(df, "id INT, source STRING, target STRING, description STRING")
    assert rows(got, "query_id", "id", "source", "target", "description") == [
        (1, 0, "a", "b", 'one, "two"\nthree'),
        (1, 1, "c", "d", None),
    ]


def test_context_sources_and_numbers(spark, rows):
    text = "-----Sources-----\n```csv\nid,content\n1, a, b \n\nplain line\n```"
    df = spark.createDataFrame([(1, text), (2, "none")], schemas.CONTEXTS)
    assert rows(context.sources(df), "id", "content") == [("1", "a, b"), ("row_3", "plain line")]
    lists = spark.createDataFrame([(1, ["x", "y"])], "query_id BIGINT, context_list ARRAY<STRING>")
    assert rows(context.numbered_contexts(lists)) == [(1, 1, "x"), (1, 2, "y")]


# ---------------------------------------------------------------- summaries, stores, streams


def test_summaries(spark):
    results = spark.createDataFrame(
        [("a", ["a"], {}, True, None), ("b", [], {}, False, "bad"), ("c", [], {}, False, "")], schemas.RESULTS
    )
    assert tuple(summaries.process_summary(results).first()) == (3, 1, 2, 1, False)
    assert [r.error for r in summaries.process_errors(results).collect()] == ["bad"]
    status = spark.createDataFrame(
        [("a", "f1", 3, True), ("a", "f2", 0, True), ("a", "f3", 4, False)], schemas.FILE_STATUS
    )
    assert tuple(summaries.store_summary(results, status).first()) == (1, 4, 3, 7)
    assert tuple(summaries.store_summary(results.limit(0), status.limit(0)).first()) == (0, 0, 0, 0)


def test_repeated_insert_adds_nothing(spark, rows, tmp_path):
    docs, _ = _random_docs(spark)
    chunks = chunking.unique_chunks(ingest.document_chunks(docs, 5))
    path = str(tmp_path / "store")
    sinks.insert_chunks(chunks, None, path)
    first = spark.read.parquet(path).count()
    assert first == chunks.count() > 0
    sinks.insert_chunks(chunks, spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == first


def test_stream_equals_batch_over_several_runs(spark, rows, tmp_path):
    docs, _ = _random_docs(spark, 40)
    folder, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    for part in range(2):
        docs.filter(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.stream_documents(spark, folder, docs.schema, "*.parquet", files_per_batch=1)
        ingest.start_ingest(stream, store, state, 5).awaitTermination()
    batch = chunking.unique_chunks(ingest.document_chunks(docs, 5))
    assert rows(ingest.read_store(spark, store), "chunk_id") == rows(batch, "chunk_id")
    # A second stream over the same files, with a state of its own, adds nothing.
    stream = ingest.stream_documents(spark, folder, docs.schema, "*.parquet")
    ingest.start_ingest(stream, store, state + "2", 5).awaitTermination()
    assert rows(ingest.read_store(spark, store), "chunk_id") == rows(batch, "chunk_id")


def test_process_run(spark, tmp_path):
    items = spark.createDataFrame([("https://x.org/1", "url"), ("notes.txt", "file"), ("https://x.org/2", "url")], schemas.MANIFEST)
    texts = spark.createDataFrame([("https://x.org/1", "one two\nthree")], "item STRING, text STRING")
    options = Options(output_dir=str(tmp_path / "out"))
    store = str(tmp_path / "store")
    when = F.lit("2024-01-02 03:04:05").cast("timestamp")
    row = runs.process(items, texts, None, store, when, options).first()
    assert (row.total_files, row.successful_files, row.failed_files, row.ok) == (3, 2, 1, False)
    assert (row.successful_stores, row.failed_stores, row.total_chunks) == (1, 2, 1)
    assert [r.text for r in spark.read.parquet(store).collect()] == ["one two\nthree"]
    record = spark.read.json(str(tmp_path / "out/chunks")).first()
    assert record.source_file == "https://x.org/1" and record.chunks == ["one two\nthree"]


def test_hooks(spark, rows):
    df = spark.createDataFrame([(1, "a bb"), (2, "ccc")], "id BIGINT, text STRING")
    vectors = df.select("id", hooks.embed(F.col("text"), lambda: lambda texts: [[len(t), 1.0] for t in texts]).alias("v"))
    assert rows(vectors) == [(1, [4.0, 1.0]), (2, [3.0, 1.0])]
    counts = df.select("id", hooks.count_tokens(F.col("text"), lambda: lambda t: len(t.split())))
    assert rows(counts) == [(1, 2), (2, 1)]
    named = hooks.map_batches(df, lambda: lambda b: b.assign(name=b["text"].str.upper())[["id", "name"]], "id BIGINT, name STRING")
    assert rows(named) == [(1, "A BB"), (2, "CCC")]


PYTHON_SOURCE = r'''import os


@deco(
"x")
def one(
a,
b="(",
):
    x = """
text at column 0
def not_one():
"""
# a note at column 0
    y = [1,
2, {3:
4}]
    return x + \
y  # tail


class Two:
    "doc # string"

    async def three(self): return {"def": 1}

# about four
    def four(self):
        z = 'it\'s ('
        if z:
# deep note

            return """
"""


s = "(" * 3
'''


def test_python_blocks_are_those_of_the_syntax_tree(spark):
    """Comments and strings at column 0, unindented signatures, decorators, a very long line."""
    source = PYTHON_SOURCE + "t = '" + "q" * 1_000_000 + "'\n"
    kinds = {ast.ClassDef: "class_definition", ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition"}
    want = [(n.lineno, n.end_lineno, kinds[type(n)]) for n in ast.walk(ast.parse(source)) if type(n) in kinds]
    files = spark.createDataFrame([("f", "a.py", source)], "file_id STRING, path STRING, text STRING")
    got = code.python_blocks(files).select("start_line", "end_line", "type").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_script_blocks_with_a_very_long_string(spark):
    source = "function f() {\n  return '" + "\\x{" * 300_000 + "';\n}\nclass A {\n}\n"
    files = spark.createDataFrame([("f", "a.js", source)], "file_id STRING, path STRING, text STRING")
    got = code.script_blocks(files).select("start_line", "end_line", "type").collect()
    assert sorted(map(tuple, got)) == [(1, 3, "function_declaration"), (4, 5, "class_declaration")]
