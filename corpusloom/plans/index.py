"""The stored corpus that searches read: chunks, term vectors and the entity graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, graph, postings, retrieval
from corpusloom.operators.shelves import Shelves, shelve
from corpusloom.session import buckets_for, stored


@dataclass(frozen=True)
class Index:
    """The corpus tables, and the same rows laid out for lookups. A layout is written when a
    search first asks for it and kept with the index."""

    chunks: DataFrame
    sources: DataFrame
    pairs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    buckets: int

    @property
    def total(self) -> Column:
        return self.chunks.agg(F.count("*")).scalar()

    @cached_property
    def vectors(self) -> DataFrame:
        """Term vectors, bucketed as the chunks are; what reads the graph alone never needs them."""
        vectors = retrieval.term_vectors(self.chunks, "chunk_id")
        return stored(vectors, "vectors", bucket_by="chunk_id", buckets=self.buckets)

    @property
    def entity_shares(self) -> DataFrame:
        """The entities of each chunk in one row, for a pass over all chunks."""
        return retrieval.whole_shares(self.sources, "chunk_id", F.col("name"))

    @property
    def relation_shares(self) -> DataFrame:
        """The relations of each chunk in one row, for a pass over all chunks."""
        return retrieval.whole_shares(self.pairs, "chunk_id", retrieval.edge_name())

    @cached_property
    def postings(self) -> postings.Postings:
        """Term to chunks."""
        return postings.build(self.vectors)

    @cached_property
    def nodes_by_id(self) -> Shelves:
        return shelve(self.nodes, ("id",), "nodes-by-id")

    @cached_property
    def edges_by_end(self) -> Shelves:
        """Each edge under both of its ends: ``term`` and the edge's columns."""
        ends = self.edges.withColumn("term", F.explode(F.array("source", "target")))
        return shelve(ends, ("term",), "edges-by-end")

    @cached_property
    def sources_by_name(self) -> Shelves:
        """Entity to chunks."""
        return shelve(self.sources.select(F.col("name").alias("term"), "chunk_id"), ("term",), "sources-by-name")

    @cached_property
    def pairs_by_ends(self) -> Shelves:
        """Relation to chunks."""
        return shelve(self.pairs.select("source", "target", "chunk_id"), ("source", "target"), "pairs-by-ends")

    @cached_property
    def chunks_by_id(self) -> Shelves:
        texts = self.chunks.select(F.col("chunk_id").alias("item"), "text")
        return shelve(texts, ("item",), "chunks-by-id", rows_per_shelf=16_384)

    def lay_out(self) -> None:
        """Write all layouts now."""
        for name in ("vectors", "postings", "nodes_by_id", "edges_by_end", "sources_by_name", "pairs_by_ends", "chunks_by_id"):
            getattr(self, name)


def corpus_chunks(docs: DataFrame, max_tokens: int) -> DataFrame:
    """Distinct token windows of all documents: ``chunk_id, doc_id, seq, lang, n_tokens, text``."""
    cut = chunking.token_windows(docs, ["doc_id", "lang"], max_tokens)
    return chunking.unique_chunks(chunking.with_chunk_id(cut))


def word_gazetteer(texts: DataFrame, min_letters: int = 6, text: str = "text") -> DataFrame:
    """Distinct words of at least ``min_letters`` letters: ``term``."""
    return (
        texts.select(F.explode(tx.words(F.col(text))).alias("term"))
        .filter(F.length("term") >= min_letters)
        .distinct()
    )


def phrase_gazetteer(texts: DataFrame, sizes: tuple[int, ...] = (2, 3), min_letters: int = 6, text: str = "text") -> DataFrame:
    """Distinct runs of ``sizes`` words of at least ``min_letters`` letters each: ``term``."""

    def runs(ws: Column) -> Column:
        def of(n: int) -> Column:
            cut = F.transform(ws, lambda w, i: F.slice(ws, i + 1, F.lit(n)))
            good = F.filter(cut, lambda r: (F.size(r) == n) & F.forall(r, lambda w: F.length(w) >= min_letters))
            return F.transform(good, lambda r: F.array_join(r, " "))

        return F.concat(*[of(n) for n in sizes])

    return texts.select(F.explode(runs(tx.words(F.col(text)))).alias("term")).distinct()


def build(
    docs: DataFrame, gazetteer: DataFrame, max_tokens: int, pair_window: int = graph.PAIR_WINDOW
) -> Index:
    """Write the corpus tables once; everything that is keyed by chunk is bucketed by it, in
    the same number of buckets, so relation building needs no further shuffle on ``chunk_id``.

    Relations are pairs of entities at most ``pair_window`` words apart in a chunk.
    """
    n = buckets_for(docs)

    def by_chunk(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, bucket_by="chunk_id", buckets=n)

    chunks = by_chunk(corpus_chunks(docs, max_tokens), "chunks")
    found = by_chunk(graph.mentions(chunks, stored(gazetteer, "gazetteer")), "mentions")
    sources = by_chunk(graph.entity_sources(found), "entity-sources")
    pairs = by_chunk(graph.relation_pairs(found, pair_window), "relation-pairs")
    nodes = stored(graph.entity_merge(sources), "nodes")
    edges = stored(graph.relation_merge(pairs), "edges")
    return Index(chunks, sources, pairs, nodes, edges, n)
