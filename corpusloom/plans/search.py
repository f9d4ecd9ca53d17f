"""Batches of questions against an index, in five modes.

The large tables are read by their lookup layouts: a batch opens only the shelves that hold
its terms, entities, relations and chunks. What a batch has found is small; it is stored
before it meets the next table, so its size is a fact: Catalyst broadcasts it below the
session's threshold and sort-merges with skew splitting above.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import context, postings, retrieval
from corpusloom.options import CONTEXT_LIMIT
from corpusloom.plans.index import Index
from corpusloom.session import stored

# Entities or relations of a batch whose chunks are looked up; those of larger batches are found in one pass.
FEW_KEYS = 16


def _largest_limit(queries: DataFrame) -> int:
    return queries.agg(F.coalesce(F.max("top_k"), F.lit(0))).first()[0]


def naive(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, part, item, score, rank`` of the best chunks by words, in one pass over all
    term vectors without a shuffle before the ranking: the way for large batches."""
    rows = retrieval.chunk_postings(index.vectors)
    weights = stored(
        retrieval.query_weights(retrieval.query_terms(queries), rows, index.total), "query-weights"
    )
    best = retrieval.rank_by_terms(retrieval.shares(index.vectors), "chunk_id", weights, _largest_limit(queries))
    return retrieval.part(best, "chunk")


def naive_by_index(index: Index, queries: DataFrame) -> DataFrame:
    """The same rows from the inverted index, which opens the shelves of the questions' terms
    only: the way for a few questions on a large corpus."""
    return retrieval.part(postings.rank(index.postings, queries, _largest_limit(queries)), "chunk")


def named(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, top_k, term, tf, n_sources``: the entities the questions name."""
    terms = retrieval.query_terms(queries).withColumnRenamed("term", "id")
    found = index.nodes_by_id.lookup(terms).withColumnRenamed("id", "term")
    return stored(found.select("query_id", "top_k", "term", "tf", "n_sources"), "query-names")


def touched(index: Index, scores: DataFrame) -> DataFrame:
    """The edges at the entities of ``scores(query_id, top_k, term, score)``."""
    met = index.edges_by_end.lookup(scores)
    return met.select("query_id", "top_k", "term", "score", "source", "target", "weight")


def _chunks(scores: DataFrame, items: DataFrame, shown: Callable[[], DataFrame], k: int) -> DataFrame:
    """Chunks by the scores of the entities or relations they show: ``scores(query_id, top_k, term, score)``,
    stored. A few are looked up; more would meet most chunks many times, so the chunks are passed over once."""
    if scores.count() <= FEW_KEYS:
        return retrieval.chunk_parts(shown(), k)
    weights = scores.select("query_id", "top_k", "term", F.col("score").alias("weight"))
    return retrieval.part(retrieval.rank_by_terms(items, "chunk_id", weights, k), "chunk")


def _local(index: Index, entities: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    scores = entities.select("query_id", "top_k", F.col("item").alias("term"), "score")
    return retrieval.union(
        [
            retrieval.part(entities, "entity"),
            retrieval.part(retrieval.rank_edges(edges, k), "relation"),
            _chunks(scores, index.entity_shares, lambda: index.sources_by_name.lookup(scores), k),
        ]
    )


def _global(index: Index, edges: DataFrame, k: int) -> DataFrame:
    relations = stored(retrieval.rank_edges(edges, k), "query-relations")
    asked = relations.select("query_id", "top_k", "source", "target", "score", retrieval.edge_name().alias("term"))
    return retrieval.union(
        [
            retrieval.end_parts(relations),
            retrieval.part(relations, "relation"),
            _chunks(asked, index.relation_shares, lambda: index.pairs_by_ends.lookup(asked.drop("term")), k),
        ]
    )


def _entities(index: Index, found: DataFrame, k: int) -> DataFrame:
    return stored(retrieval.match_entities(found, index.total, k), "query-entities")


def local(index: Index, queries: DataFrame) -> DataFrame:
    """Entities the query names, their relations and the chunks that mention them."""
    k = _largest_limit(queries)
    entities = _entities(index, named(index, queries), k)
    scores = entities.select("query_id", "top_k", F.col("item").alias("term"), "score")
    return _local(index, entities, touched(index, scores), k)


def global_(index: Index, queries: DataFrame) -> DataFrame:
    """Relations the query touches, their endpoints and the chunks that show them."""
    k = _largest_limit(queries)
    scores = stored(retrieval.term_scores(named(index, queries), index.total), "query-scores")
    return _global(index, touched(index, scores), k)


def local_and_global(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both, the entities looked up and their edges read once."""
    k = _largest_limit(queries)
    found = named(index, queries)
    entities = _entities(index, found, k)
    scores = stored(retrieval.term_scores(found, index.total), "query-scores")
    edges = stored(touched(index, scores), "query-edges")
    chosen = entities.select("query_id", F.col("item").alias("term"), F.col("score").alias("own"))
    own = edges.join(chosen, ["query_id", "term"]).withColumn("score", F.col("own"))
    return _local(index, entities, own, k), _global(index, edges, k)


def hybrid(index: Index, queries: DataFrame) -> DataFrame:
    return retrieval.merge_modes(list(local_and_global(index, queries)), queries)


def mix(index: Index, queries: DataFrame) -> DataFrame:
    return retrieval.mixed_chunks(hybrid(index, queries), naive(index, queries), queries)


def search(index: Index, queries: DataFrame, mode: str) -> DataFrame:
    """One mode for the whole batch: ``query_id, part, item, score, rank``.

    ``mix`` ranks its chunks by the sum of both scores.
    """
    retrieval.check_mode(mode)
    if mode == "mix":
        return _ranked_mix(mix(index, queries))
    return {"naive": naive, "local": local, "global": global_, "hybrid": hybrid}[mode](index, queries)


def _ranked_mix(mixed: DataFrame) -> DataFrame:
    return mixed.select("query_id", F.lit("chunk").alias("part"), "item", "score", "rank")


def all_modes(index: Index, queries: DataFrame) -> DataFrame:
    """Every query under every mode. Shared parts are worked out once and stored."""
    n = stored(naive(index, queries), "naive")
    lo, g = (stored(df, name) for df, name in zip(local_and_global(index, queries), ("local", "global")))
    h = stored(retrieval.merge_modes([lo, g], queries), "hybrid")
    m = _ranked_mix(retrieval.mixed_chunks(h, n, queries))
    named = {"naive": n, "local": lo, "global": g, "hybrid": h, "mix": m}
    return retrieval.union([df.withColumn("mode", F.lit(mode)) for mode, df in named.items()])


def by_mode(index: Index, queries: DataFrame) -> DataFrame:
    """Queries with a ``mode`` column, each answered in its own mode; an unknown mode fails."""
    checked = stored(
        queries.withColumn("mode", retrieval.checked_mode(F.col("mode"))), "queries"
    )
    return retrieval.union(
        [
            search(index, checked.filter(F.col("mode") == mode), mode).withColumn("mode", F.lit(mode))
            for mode in retrieval.SEARCH_MODES
        ]
    )


def context_lines(index: Index, queries: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """CSV lines of the first ``limit`` entities, relations and chunks of a hybrid search."""
    found = hybrid(index, queries).filter(F.col("rank") <= limit)
    found = stored(found, "context-hits")
    number = F.col("rank") - 1

    def of(name: str) -> DataFrame:
        return found.filter(F.col("part") == name)

    asked = of("entity").withColumnRenamed("item", "id")
    entity = index.nodes_by_id.lookup(asked).select(
        "query_id",
        "part",
        "rank",
        context.csv_line(number, F.col("id"), F.col("entity_type"), F.col("description")).alias("line"),
    )
    source, target = (F.split_part("item", F.lit(" | "), F.lit(i)) for i in (1, 2))
    ends = of("relation").select("query_id", "part", "rank", source.alias("term"), target.alias("_target"))
    met = index.edges_by_end.lookup(ends)
    relation = met.filter((F.col("source") == F.col("term")) & (F.col("target") == F.col("_target"))).select(
        "query_id",
        "part",
        "rank",
        F.concat_ws(
            ",",
            number.cast("string"),
            *[context.csv_cell(F.col(c)) for c in ("source", "target", "description", "keywords")],
            F.col("weight").cast("string"),
            context.csv_cell(F.col("source_id")),
        ).alias("line"),
    )
    texts = index.chunks.select(F.col("chunk_id").alias("item"), "text")
    chunk = texts.join(stored(of("chunk"), "context-chunks"), "item").select(
        "query_id", "part", "rank", context.csv_line(number, F.col("text")).alias("line")
    )
    return retrieval.union([entity, relation, chunk])


def contexts(index: Index, queries: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Context only, no answer: one text per query with at least one hit."""
    return context.assemble(context_lines(index, queries, limit))
