"""Ranked retrieval for a table of queries.

Text matching weighs items by ``(1 + ln tf) / norm`` and query terms by
``(1 + ln tf) * ln(N / df) / norm``. The item side has no corpus statistics in it,
so it is worked out inside the row; document frequencies are needed for the
queries' own terms only. Scores are rounded to six decimals before ranking and ties
go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.skew import HOT_ROWS, salted_join, top_k
from corpusloom.options import SEARCH_MODES
from corpusloom.session import new_path

# A task scores one batch of its items against this many questions at a time, and so many items at once.
QUERIES_AT_ONCE = 256
ITEMS_AT_ONCE = 64
# Scores are rounded to six decimals before they are compared.
ROUNDING = 2e-6

PARTS = ("entity", "relation", "chunk")


def check_mode(mode: str) -> str:
    if mode not in SEARCH_MODES:
        raise ValueError(f"Invalid search mode. Must be one of: {list(SEARCH_MODES)}")
    return mode


def checked_mode(mode: Column) -> Column:
    """The mode column; a row with an unknown mode fails the job."""
    message = F.concat(
        F.lit("Invalid search mode. Must be one of: " + ", ".join(SEARCH_MODES) + "; got "),
        F.coalesce(mode, F.lit("null")),
    )
    return F.when(mode.isin(*SEARCH_MODES), mode).otherwise(F.raise_error(message).cast("string"))


def with_modes(queries: DataFrame) -> DataFrame:
    """Each query once per mode."""
    return queries.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in SEARCH_MODES])))


def term_vectors(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, terms ARRAY<STRUCT<term, tf>>, norm``, without a shuffle."""
    square = lambda s, t: s + F.pow(1 + F.log(t["tf"]), 2)
    return items.select(key, tx.term_counts(tx.words(F.col(text))).alias("terms")).withColumn(
        "norm", F.sqrt(F.aggregate("terms", F.lit(0.0), square))
    )


def tfidf_weights(vectors: DataFrame, key: str) -> DataFrame:
    """Long form ``key, term, tf, df, weight = tf * ln(N / df)`` of ``term_vectors`` rows.

    Frequent words are hot keys of the join with the document frequencies; the
    frequencies themselves say which, so the salting costs no extra count.
    """
    postings = vectors.select(key, F.inline("terms"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    total = vectors.agg(F.count("*")).scalar()
    hot = df.filter(F.col("df") >= HOT_ROWS).select("term", F.ceil(F.col("df") / HOT_ROWS).cast("int").alias("salts"))
    return salted_join(postings, df, "term", hot=hot).select(
        key,
        "term",
        "tf",
        "df",
        F.round(F.col("tf") * F.log(total / F.col("df")), 6).alias("weight"),
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, top_k, term, tf``."""
    return queries.select(
        "query_id", "top_k", F.inline(tx.term_counts(tx.words(F.col("text"))))
    )


def query_weights(terms: DataFrame, postings: DataFrame, total: Column) -> DataFrame:
    """``query_id, top_k, term, weight`` for the terms that occur in ``postings(term)``.

    Counting is map-side combined, so a word in every item costs one row per task.
    """
    wanted = terms.select("term").distinct()
    df = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").withColumn(
        "w", (1 + F.log("tf")) * F.log(total / F.col("df"))
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return weighted.select(
        "query_id", "top_k", "term", F.try_divide(F.col("w"), norm).alias("weight")
    )


def rank_by_terms(
    items: DataFrame, key: str, weights: DataFrame, max_k: int | None = None
) -> DataFrame:
    """Top items per query by the sum of an item's shares times ``weights.weight``.

    ``items(key, term ARRAY<STRING>, share ARRAY<DOUBLE>)`` has one row per item and
    ``weights(query_id, top_k, term, weight)`` is a stored table. Every task passes over its own
    items once and reads the weights block by block; items and queries never meet as rows, and
    only ``max_k`` items per query and batch reach the ranking.
    """
    kind = {name: weights.schema[name].dataType.simpleString() for name in ("query_id", "top_k")}
    k = max_k if max_k is not None else weights.agg(F.coalesce(F.max("top_k"), F.lit(0))).first()[0]
    folder, blocks = weight_blocks(weights)
    schema = f"query_id {kind['query_id']}, {key} {items.schema[key].dataType.simpleString()}, top_k long, score double"
    rows = items.select(F.col(key).alias("_item"), "term", F.col("share").cast("array<double>").alias("share"))
    found = rows.mapInArrow(_leading(folder, blocks, k), schema)
    return ranked(found.withColumn("top_k", F.col("top_k").cast(kind["top_k"])), key, max_k)


def weight_blocks(weights: DataFrame, *keep: str) -> tuple[str, int]:
    """``weights`` written to a folder in blocks of about ``QUERIES_AT_ONCE`` whole queries, and their number."""
    n = 1 + weights.agg(F.count_distinct("query_id")).first()[0] // QUERIES_AT_ONCE
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    rows = weights.filter("weight IS NOT NULL AND term IS NOT NULL").select("query_id", "top_k", "term", "weight", *keep)
    folder = new_path(weights.sparkSession, "weight-blocks")
    rows.withColumn("block", block).repartition(n, "block").write.partitionBy("block").parquet(folder)
    return folder, n


@dataclass
class Block:
    """Weights of some queries as a matrix of terms and queries, and what holds for each query."""

    terms: pa.Array
    matrix: np.ndarray
    queries: pa.Array
    limits: dict[str, np.ndarray]


def _blocks(folder: str, n: int, least: tuple[str, ...] = ("top_k",)) -> Iterator[Block]:
    files, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    for number in range(n):
        at = f"{root}/block={number}"
        if files.get_file_info(at).type != fs.FileType.Directory:
            continue
        table = dataset.dataset(at, filesystem=files, format="parquet").to_table().combine_chunks()
        if not table.num_rows:
            continue
        coded = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "query_id")]
        coded = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in coded]
        term, query = (c.indices.to_numpy() for c in coded)
        matrix = np.zeros((len(coded[0].dictionary), len(coded[1].dictionary)))
        np.add.at(matrix, (term, query), table.column("weight").to_numpy())
        limits = {}
        for name in least:
            limits[name] = np.full(matrix.shape[1], np.inf)
            np.minimum.at(limits[name], query, table.column(name).to_numpy().astype(np.float64))
        yield Block(coded[0].dictionary, matrix, coded[1].dictionary, limits)


def _scored(batches: Iterator[pa.RecordBatch], folder: str, n: int, least: tuple[str, ...] = ("top_k",)):
    """``items, block, scores`` (queries by items) of every batch of items and block of queries; items
    come sorted."""
    once = list(_blocks(folder, n, least)) if n == 1 else None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.take(pc.sort_indices(batch.column("_item")))
        terms, shares = batch.column("term"), batch.column("share").flatten().to_numpy(zero_copy_only=False)
        offsets = terms.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        terms = terms.flatten()
        for block in once if once is not None else _blocks(folder, n, least):
            place = pc.fill_null(pc.index_in(terms, value_set=block.terms), -1).to_numpy()
            met = np.flatnonzero(place >= 0)
            at, of, share = place[met], row[met], shares[met]
            scores = np.zeros((batch.num_rows, block.matrix.shape[1]))
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.array([], np.int64)
            for i in range(0, len(heads), ITEMS_AT_ONCE):
                some = heads[i : i + ITEMS_AT_ONCE]
                end = heads[i + ITEMS_AT_ONCE] if i + ITEMS_AT_ONCE < len(heads) else len(of)
                shown = block.matrix[at[some[0] : end]] * share[some[0] : end, None]
                scores[of[some]] = np.add.reduceat(shown, some - some[0], axis=0)
            yield batch.column("_item"), block, np.ascontiguousarray(scores.T)


def _leading(folder: str, n: int, k: int):
    """A ``mapInArrow`` function: the ``k`` best of each batch of items for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items, block, scores in _scored(batches, folder, n) if k > 0 else ():
            rounded = np.rint(scores * 1e6).astype(np.int64)
            size = len(items)
            order = rounded * size + np.arange(size - 1, -1, -1)  # ties go to the smaller item
            if size > k:
                found = np.argpartition(order, size - k, axis=1)[:, size - k :]
            else:
                found = np.broadcast_to(np.arange(size), order.shape)
            q, at = np.nonzero(np.take_along_axis(rounded, found, 1) > 0)
            i = found[q, at]
            limits = pa.array(block.limits["top_k"][q].astype(np.int64))
            columns = [block.queries.take(pa.array(q)), items.take(pa.array(i)), limits, pa.array(rounded[q, i] / 1e6)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item", "top_k", "score"])

    return run


def reaching(items: DataFrame, weights: DataFrame, max_k: int) -> DataFrame:
    """``query_id, item`` of the pairs that can be among a query's best: ``items`` as for ``rank_by_terms``,
    ``weights(query_id, top_k, term, weight, floor, most)`` with what the query's best have at least and
    what an item can get besides. The ``max_k``-th score of a batch bounds the result from below too."""
    folder, n = weight_blocks(weights, "floor", "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, block, scores in _scored(batches, folder, n, ("floor", "most")) if max_k > 0 else ():
            least = block.limits["floor"]
            if len(found) > max_k:
                least = np.maximum(least, np.partition(scores, -max_k, axis=1)[:, -max_k] - ROUNDING)
            q, i = np.nonzero((scores > 0) & (scores + block.limits["most"][:, None] >= least[:, None]))
            yield pa.RecordBatch.from_arrays([block.queries.take(pa.array(q)), found.take(pa.array(i))], names=["query_id", "item"])

    kinds = f"query_id {weights.schema['query_id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}"
    return items.select(F.col("item").alias("_item"), "term", "share").mapInArrow(run, kinds)


def ranked(scored: DataFrame, key: str, max_k: int | None = None) -> DataFrame:
    """Cut ``scored(query_id, top_k, key, score, ...)`` to each query's ``top_k``.

    ``max_k``, the largest ``top_k`` of the batch, is a constant Spark can apply inside
    each task before the shuffle; each query's own limit follows. Without it the result
    is the same.
    """
    best = top_k(
        scored, ["query_id"], [F.desc("score"), F.col(key)], F.col("top_k"), most=max_k
    )
    return best.withColumnRenamed(key, "item")


def chunk_postings(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.select(key, F.inline("terms"), "norm").select(
        key, "term", ((1 + F.log("tf")) / F.col("norm")).alias("weight")
    )


def shares(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``term_vectors`` rows as the ``items`` of ``rank_by_terms``: ``key, term, share``."""
    share = F.transform("terms", lambda t: (1 + F.log(t["tf"])) / F.col("norm"))
    return vectors.select(key, F.col("terms.term").alias("term"), share.alias("share"))


def whole_shares(rows: DataFrame, key: str, term: Column) -> DataFrame:
    """Rows of ``key`` and a ``term`` as the ``items`` of ``rank_by_terms``, each term with share 1. Rows that
    come partitioned by ``key`` are not shuffled."""
    listed = rows.groupBy(key).agg(F.collect_list(term).alias("term"))
    return listed.withColumn("share", F.array_repeat(F.lit(1.0), F.size("term")))


def part(df: DataFrame, name: str) -> DataFrame:
    return df.select("query_id", F.lit(name).alias("part"), "item", "score", "rank")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def named(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, top_k, term, tf, n_sources`` of the query terms that are nodes."""
    return nodes.select(F.col("id").alias("term"), "n_sources").join(terms, "term")


def match_entities(found: DataFrame, total: Column, max_k: int | None = None) -> DataFrame:
    """``query_id, top_k, item, score, rank`` of the entities a query names, from ``named`` rows."""
    score = F.round((1 + F.log("tf")) * F.log(total / F.col("n_sources")), 6)
    scored = found.select("query_id", "top_k", "term", score.alias("score")).filter(F.col("score") > 0)
    return ranked(scored, "term", max_k)


def edge_name() -> Column:
    return F.concat(F.col("source"), F.lit(" | "), F.col("target"))


def term_scores(found: DataFrame, total: Column) -> DataFrame:
    """``query_id, top_k, term, score`` of ``named`` rows, not rounded."""
    weight = (1 + F.log("tf")) * F.log(total / F.col("n_sources"))
    return found.select("query_id", "top_k", "term", weight.alias("score"))


def rank_edges(touched: DataFrame, max_k: int | None = None) -> DataFrame:
    """Relations by (sum of the scores of their matched ends) times their strength,
    ``ln(1 + weight)``.

    ``touched(query_id, top_k, term, score, source, target, weight)`` has an edge once per matched
    end; keeps ``source`` and ``target``.
    """
    scored = (
        touched.groupBy("source", "target", "query_id", "top_k")
        .agg(F.round(F.sum("score") * F.log(1 + F.max("weight")), 6).alias("score"))
        .filter(F.col("score") > 0)
        .withColumn("name", edge_name())
    )
    return ranked(scored, "name", max_k)


def chunk_parts(shown: DataFrame, max_k: int | None = None) -> DataFrame:
    """Chunks by the scores of what they show: ``shown(query_id, top_k, chunk_id, score)``."""
    chunks = shown.groupBy("chunk_id", "query_id", "top_k").agg(F.round(F.sum("score"), 6).alias("score"))
    return part(ranked(chunks, "chunk_id", max_k), "chunk")


def end_parts(relations: DataFrame) -> DataFrame:
    """The endpoints of a query's relations, by their best relation."""
    ends = (
        relations.select("query_id", F.explode(F.array("source", "target")).alias("item"), "score")
        .groupBy("query_id", "item")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    limits = relations.groupBy("query_id").agg(F.min("top_k").alias("top_k"))
    ends = ends.withColumn("rank", F.row_number().over(order).cast("long")).join(limits, "query_id")
    return part(ends.filter(F.col("rank") <= F.col("top_k")), "entity")


def limits(queries: DataFrame) -> DataFrame:
    """``query_id, top_k`` of each query."""
    return queries.select("query_id", "top_k")


def merge_modes(parts: list[DataFrame], queries: DataFrame) -> DataFrame:
    """The first ``top_k`` of the union in each part, by the best score of each item."""
    best = union(parts).groupBy("query_id", "part", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(
        Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "item")
    )
    ranked_parts = best.withColumn("rank", rank.cast("long")).join(limits(queries), "query_id")
    return ranked_parts.filter(F.col("rank") <= F.col("top_k")).drop("top_k")


def mixed_chunks(hybrid: DataFrame, naive: DataFrame, queries: DataFrame) -> DataFrame:
    """The first ``top_k`` chunks of the graph search and the text search together, by the sum of
    their scores, each once, with where from."""
    graph = hybrid.filter(F.col("part") == "chunk").select(
        "query_id", "item", F.col("score").alias("graph_score")
    )
    text = naive.select("query_id", "item", F.col("score").alias("text_score"))
    zero = F.lit(0.0)
    score = F.round(F.coalesce("graph_score", zero) + F.coalesce("text_score", zero), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    both = graph.join(text, ["query_id", "item"], "full").withColumn("score", score)
    both = both.withColumn("rank", F.row_number().over(order).cast("long")).join(limits(queries), "query_id")
    return both.filter(F.col("rank") <= F.col("top_k")).select(
        "query_id",
        "item",
        "graph_score",
        "text_score",
        F.when(F.col("graph_score").isNull(), "vector")
        .when(F.col("text_score").isNull(), "graph")
        .otherwise("both")
        .alias("part"),
        "score",
        "rank",
    )


def no_hits(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Queries that found nothing."""
    return queries.join(results.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit("No results found").alias("message")
    )


def _best(scores: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int) -> pd.DataFrame:
    """The pairs that can be among the ``k`` best of their query, ties included."""
    if scores.shape[1] > k:
        limit = np.partition(scores, -k, axis=1)[:, -k]
    else:
        limit = np.full(len(ids), -np.inf)
    q, i = np.nonzero(scores >= limit[:, None])
    return pd.DataFrame({"query_id": ids[q], "item_id": items[i], "score": scores[q, i]})


def _questions(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the stored questions, a block at a time."""
    files, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    for batch in dataset.dataset(root, filesystem=files, format="parquet").to_batches(batch_size=QUERIES_AT_ONCE):
        rows = [(q, v) for q, v in zip(batch["query_id"].to_pylist(), batch["embedding"].to_pylist()) if v]
        if not rows:
            continue
        base = np.array([v for _, v in rows], dtype=np.float64)
        length = np.linalg.norm(base, axis=1)
        yield np.array([q for q, _ in rows], np.int64)[length > 0], base[length > 0] / length[length > 0, None]


def _local_top(folder: str, k: int):
    """A ``mapInPandas`` function: the ``k`` best of each batch of vectors for each question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(m, axis=1)
            items = pdf["item_id"].to_numpy()[size > 0]
            unit = (m[size > 0] / size[size > 0, None]).T
            for ids, base in _questions(folder):
                if len(ids) and len(items):
                    found = _best(np.round(base @ unit, 6), ids, items, k)
                    found = found.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
                    yield found.groupby("query_id").head(k)

    return run


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vec_id: str = "item_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Exact cosine top ``k`` of ``vectors`` for each row of ``queries(query_id, embedding)``.

    The questions are written once to the shared folder. Every task passes over its own
    vectors once and reads the questions block by block for each batch of them, so nothing
    passes through the driver and no task holds more than a block. ``k`` per question and
    batch reach the ranking. Zero vectors are not ranked.
    """
    asked = new_path(queries.sparkSession, "questions")
    queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).write.parquet(asked)
    source = vectors.select(
        F.col(vec_id).cast("long").alias("item_id"), F.col(embedding).alias("embedding")
    )
    found = source.mapInPandas(_local_top(asked, k), "query_id BIGINT, item_id BIGINT, score DOUBLE")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("item_id")], k)
