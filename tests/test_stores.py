"""Stores that grow by batches: the commit log, the id store and the graph store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import chunking, graph
from corpusloom.plans import graphstore
from corpusloom.plans import ingest as runs
from corpusloom.plans.index import corpus_chunks, word_gazetteer
from corpusloom.session import new_path, stored
from corpusloom.sources import idstore
from corpusloom.sources.runlog import RunLog, State
from corpusloom.streaming import ingest

SF_DIR = "/root/testdata/sf0.001"


def _chunks(spark, numbers):
    rows = [(f"{i % 3:02x}{i:06d}", i, 0, f"text {i}", 2) for i in numbers]
    return spark.createDataFrame(rows, ingest.CHUNKS)


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_a_number_is_taken_once(spark):
    log = RunLog(spark, new_path(spark, "log"))
    assert log.read() == State()
    first, other = State().with_run("a", "s", 0), State().with_run("b", "t", 0)
    assert log.commit(first) and not log.commit(other)
    assert log.read() == first
    assert log.commit(log.read().with_run("b", "t", 0)) and log.read().names() == ["a", "b"]


def test_insert_replay_and_levels(spark):
    store = new_path(spark, "ids")
    for batch in range(9):
        assert idstore.insert(_chunks(spark, range(batch * 5, batch * 5 + 10)), store, "s", batch, fanout=2)
    assert not idstore.insert(_chunks(spark, range(900, 910)), store, "s", 4)  # done before
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS)) == list(range(50))
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS, "s", 3)) == list(range(20, 25))
    state = RunLog(spark, store).read()
    assert max(level for _, level in state.runs) >= 2 and len(state.runs) <= 4
    assert not idstore.read_store(spark, new_path(spark, "none"), ingest.CHUNKS).count()


def test_a_broken_batch_leaves_nothing(spark, monkeypatch):
    store = new_path(spark, "ids")
    idstore.insert(_chunks(spark, range(3)), store, "s", 0)
    with monkeypatch.context() as patch:
        patch.setattr(RunLog, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            idstore.insert(_chunks(spark, range(2, 6)), store, "s", 1)
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS)) == [0, 1, 2]
    assert idstore.insert(_chunks(spark, range(2, 7)), store, "s", 1)
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS)) == list(range(7))


def test_two_streams_at_the_same_time(spark, monkeypatch):
    """The second to commit looks again, so a chunk of both is stored once."""
    store = new_path(spark, "ids")
    commit, once = RunLog.commit, []

    def late(self, state):
        if not once:
            once.append(1)
            idstore.insert(_chunks(spark, range(0, 8)), store, "other", 0)
        return commit(self, state)

    monkeypatch.setattr(RunLog, "commit", late)
    assert idstore.insert(_chunks(spark, range(5, 12)), store, "first", 0)
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS)) == list(range(12))
    assert _ids(idstore.read_store(spark, store, ingest.CHUNKS, "first")) == list(range(8, 12))


def test_a_batch_reads_its_prefixes(spark):
    store = new_path(spark, "ids")
    idstore.insert(_chunks(spark, range(300)), store, "s", 0)
    wanted = stored(_chunks(spark, [0, 3, 900]), "wanted")  # all of prefix 00
    held = idstore.held_ids(spark, store, RunLog(spark, store).read(), wanted)
    assert "PartitionFilters: [prefix" in held._jdf.queryExecution().executedPlan().toString().replace("isnotnull(prefix#", "prefix#") or (
        "prefix" in held._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1][:60]
    )
    assert len(held.inputFiles()) and sorted(r[0] for r in held.collect()) == ["00000000", "00000003"]


def test_stream_into_a_store_with_others(spark, tmp_path):
    folder, store = tmp_path / "in", new_path(spark, "stream")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{j}" for j in range(7))) for i in range(6)], "doc_id long, text string")
    for n in range(3):
        docs.filter(F.col("doc_id") % 3 <= n).coalesce(1).write.mode("append").parquet(str(folder))
    for checkpoint in ("one", "two"):
        files = ingest.stream_documents(spark, str(folder), docs.schema, "*.parquet", files_per_batch=1)
        ingest.start_ingest(files, store, str(tmp_path / checkpoint), 3).awaitTermination()
    want = chunking.unique_chunks(ingest.document_chunks(docs, 3))
    got = ingest.read_store(spark, store)
    assert sorted(r.chunk_id for r in got.collect()) == sorted(r.chunk_id for r in want.collect())
    assert len(RunLog(spark, store).read().done) == 2


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_grown_graph_is_the_graph_of_all(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = stored(word_gazetteer(spark.read.parquet(f"{SF_DIR}/benchmark.parquet")), "words")
    found = stored(graph.mentions(corpus_chunks(docs, 100), words), "found")
    store = new_path(spark, "graph")
    cuts = [r[0] for r in docs.selectExpr("percentile_approx(doc_id, array(0.2, 0.5, 0.7))").collect()][0]
    low = -1
    for batch, high in enumerate([*cuts, 1 << 40]):
        part = docs.filter((F.col("doc_id") > low) & (F.col("doc_id") <= high))
        assert graphstore.add_documents(part, words, store, "s", batch, 100, fanout=2)
        low = high
    assert not graphstore.add_documents(docs, words, store, "s", 2, 100)
    assert max(level for _, level in RunLog(spark, f"{store}/graph").read().runs) >= 1
    assert _rows(graphstore.nodes(spark, store)) == _rows(graph.entity_merge(graph.entity_sources(found)))
    assert _rows(graphstore.edges(spark, store)) == _rows(graph.relation_merge(graph.relation_pairs(found)))


def test_relation_type_looks_at_all_keywords(spark):
    """The sixth keyword by frequency decides, though five are shown."""
    links = ["a", "b", "c", "d", "e", "reuses"]
    rows = [(f"c{i}", i, "x", "y", 1, links[: 6 - i]) for i in range(6)] + [("c9", 9, "x", "z", 2, None), ("c9", 9, "y", "z", 2, ['"q",r'])]
    pairs = spark.createDataFrame(rows, "chunk_id string, doc_id long, source string, target string, weight long, links array<string>")
    got = {(r.source, r.target): r for r in graph.relation_merge(pairs.withColumn("links", F.coalesce("links", F.array().cast("array<string>")))).collect()}
    edge = got["x", "y"]
    assert (edge.keywords, edge.rel_type, edge.weight, edge.n_sources, edge.source_id) == ("a,b,c,d,e", "uses", 6.0, 6, "0")
    assert (got["x", "z"].keywords, got["x", "z"].rel_type) == (None, None)
    assert got["y", "z"].rel_type == "q"


def _manifest(spark):
    return spark.createDataFrame(
        [("https://x.org/1", "url"), ("notes.txt", "file"), ("https://x.org/2", "url"), ("https://x.org/3", "url")], schemas.MANIFEST
    )


def _pages(spark):
    return spark.createDataFrame(
        [("https://x.org/1", "# A\none two\n## B\nthree"), ("https://x.org/2", "# A\none two"), ("notes.txt", "not taken")],
        "item STRING, text STRING",
    )


def test_a_run_appears_as_a_whole(spark, monkeypatch):
    store, when = new_path(spark, "runs"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    with monkeypatch.context() as patch:
        patch.setattr(RunLog, "commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):  # all is written, nothing named
            runs.process_run(_manifest(spark), _pages(spark), store, "one", when)
    assert runs.stored_chunks(spark, store).count() == runs.run_summaries(spark, store).count() == 0
    assert runs.process_run(_manifest(spark), _pages(spark), store, "one", when)
    assert not runs.process_run(_manifest(spark), _pages(spark), store, "one", when)
    got = {(r.source, r.seq, tuple(r.headings), r.text) for r in runs.stored_chunks(spark, store).collect()}
    assert got == {("https://x.org/1", 0, ("A",), "one two"), ("https://x.org/1", 1, ("A", "B"), "three")}
    row = runs.run_summaries(spark, store).first()
    assert (row.total_files, row.successful_files, row.failed_files, row.ok, row.run) == (4, 3, 1, False, "one")
    assert (row.successful_stores, row.failed_stores, row.total_chunks) == (2, 2, 3)
    # A second run adds what is new and leaves the first as it was.
    more = spark.createDataFrame([("https://x.org/3", "three\n\nfour")], "item STRING, text STRING")
    assert runs.process_run(_manifest(spark).filter("item LIKE '%3'"), more, store, "two", when)
    assert runs.stored_chunks(spark, store).count() == 3 and runs.run_summaries(spark, store).count() == 2
    assert spark.read.json(f"{store}/records/run=two").first().chunks == ["three\n\nfour"]
