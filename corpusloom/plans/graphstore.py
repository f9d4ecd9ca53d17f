"""An entity graph that grows by batches of documents.

    store/chunks/    the id store of the chunks
    store/graph/     log/, entities/<run>/, relations/<run>/

A batch adds the counts of the chunks no batch had before: mergeable rows of entities and of
relations with their keywords. Nodes and edges are the merged counts, worked out when they are
read; runs are merged by level, so a read adds up few of them. Both stores name their runs in
a commit log, so a batch that broke or is repeated leaves one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import graph
from corpusloom.plans.index import corpus_chunks
from corpusloom.session import stored
from corpusloom.sources import idstore
from corpusloom.sources.runlog import FANOUT, RunLog, State, read_runs

CHUNKS = "chunk_id string, doc_id long, seq long, lang string, n_tokens long, text string"
ENTITIES = "name string, entity_type string, n long, n_sources long, first_doc long"
RELATIONS = "source string, target string, keyword string, weight long, n_sources long, first_doc long, n_chunks long"
_KINDS = {"entities": (ENTITIES, graph.add_entity_counts), "relations": (RELATIONS, graph.add_relation_counts)}


def add_documents(
    docs: DataFrame,
    gazetteer: DataFrame,
    store: str,
    stream: str,
    batch: int,
    max_tokens: int,
    pair_window: int = graph.PAIR_WINDOW,
    fanout: int = FANOUT,
) -> bool:
    """Add ``docs(doc_id, lang, text)`` as batch number ``batch`` of ``stream``; false where the graph
    has it already.

    A chunk counts once: its document is the one of the batch that brought it first.
    """
    spark = docs.sparkSession
    log = RunLog(spark, f"{store}/graph")
    if log.read().is_done(stream, batch):
        return False
    idstore.insert(corpus_chunks(docs, max_tokens), f"{store}/chunks", stream, batch, fanout)
    new = idstore.read_store(spark, f"{store}/chunks", CHUNKS, stream, batch)
    found = stored(graph.mentions(new, gazetteer), "batch-mentions")

    def write(state: State, run: str) -> None:
        counts = {
            "entities": graph.entity_counts(graph.entity_sources(found)),
            "relations": graph.relation_counts(graph.relation_pairs(found, pair_window)),
        }
        for kind, rows in counts.items():
            rows.write.parquet(f"{store}/graph/{kind}/{run}")

    def merge(names: list[str], run: str) -> None:
        for kind, (schema, add) in _KINDS.items():
            add(read_runs(spark, f"{store}/graph/{kind}", names, schema)).write.parquet(f"{store}/graph/{kind}/{run}")

    return log.add(write, stream, batch, merge, fanout)


def _counts(spark: SparkSession, store: str, kind: str) -> DataFrame:
    schema, add = _KINDS[kind]
    names = RunLog(spark, f"{store}/graph").read().names()
    return add(read_runs(spark, f"{store}/graph/{kind}", names, schema))


def nodes(spark: SparkSession, store: str) -> DataFrame:
    return graph.entity_nodes(_counts(spark, store, "entities"))


def edges(spark: SparkSession, store: str) -> DataFrame:
    return graph.relation_edges(_counts(spark, store, "relations"))
