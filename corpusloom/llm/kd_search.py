"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards of bounded size. A shard's tree splits at the median of its
widest dimension and keeps a tight bounding box per node. The largest inner product of a
query with any point of a box bounds a node; nodes are visited best first until the bound
falls below the k-th score found. Every block of queries first asks one shard; the k-th
scores from there start the search of all shards. Trees and blocks are rows of stored
tables, so nothing passes through the driver and a lost task reads them again.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import record_batch
from corpusloom.session import new_path

SHARD_ROWS = 8_192
QUERY_ROWS = 1_024
LEAF = 128
_EXACT = float(1 << 53)
_LOWEST = -(1 << 63)


def _number(values: np.ndarray) -> np.ndarray:
    """Vectors in a type in which inner products are exact: floating point where they stay
    below 2 ** 53."""
    values = values.astype(np.int64)
    most = float(np.abs(values.astype(np.float64)).max(initial=0))
    return values.astype(np.float64) if most * most * max(1, values.shape[1]) < _EXACT else values


class KdTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        nodes: list[list[int]] = []  # begin, end, left, right; no children: -1
        stack = [(0, len(ids), -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            number = len(nodes)
            nodes.append([begin, end, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = number
            mine = vectors[order[begin:end]]
            spread = mine.max(axis=0) - mine.min(axis=0) if vectors.shape[1] else np.zeros(1)
            if end - begin <= leaf or not spread.max():
                continue
            middle = (end - begin) // 2
            part = np.argpartition(mine[:, spread.argmax()], middle, kind="introselect")
            order[begin:end] = order[begin:end][part]
            stack.append((begin, begin + middle, number, 0))
            stack.append((begin + middle, end, number, 1))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes = np.array(nodes)
        self.low = np.array([self.vectors[b:e].min(axis=0) for b, e, *_ in nodes])
        self.high = np.array([self.vectors[b:e].max(axis=0) for b, e, *_ in nodes])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product each query can have in each node's box."""
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        return positive @ self.high.T + negative @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of at least ``least``, by score, then id, the query's own id left out."""
        ids, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, number = heapq.heappop(heap)
            if -bound < least:
                break
            begin, end, left, right = self.nodes[number]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            found = self.vectors[begin:end] @ query
            wanted = (found >= least) & (self.ids[begin:end] != query_id)
            ids = np.concatenate([ids, self.ids[begin:end][wanted]])
            scores = np.concatenate([scores, found[wanted]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                least = max(least, scores[-1])
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best].astype(np.int64)


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) and len(values) else np.zeros((len(column), 0), np.int64)


def _tree(table: pa.Table) -> pa.Table:
    ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
    order = np.argsort(ids, kind="stable")
    tree = KdTree(ids[order], vectors[order])
    small = np.int16 if np.abs(vectors).max(initial=0) < 32_000 else np.int64
    saved = _saved(ids=tree.ids, vectors=tree.vectors.astype(small), nodes=tree.nodes, low=tree.low, high=tree.high)
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([saved], pa.binary())})


def _loaded(saved: bytes) -> KdTree:
    tree, found = KdTree.__new__(KdTree), np.load(io.BytesIO(saved))
    tree.ids, tree.nodes = found["ids"], found["nodes"]
    tree.vectors = _number(found["vectors"])
    tree.low, tree.high = found["low"].astype(tree.vectors.dtype), found["high"].astype(tree.vectors.dtype)
    return tree


def _block(table: pa.Table) -> pa.Table:
    ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
    order = np.argsort(ids, kind="stable")
    saved = _saved(ids=ids[order], vectors=vectors[order])
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "queries": pa.array([saved], pa.binary())})


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, asked = _loaded(row["tree"]), np.load(io.BytesIO(row["queries"]))
                ids, queries = asked["ids"], _number(asked["vectors"])
                if queries.dtype != tree.vectors.dtype:
                    queries = queries.astype(np.int64)
                    tree.vectors, tree.low, tree.high = (a.astype(np.int64) for a in (tree.vectors, tree.low, tree.high))
                least = dict(zip(row["known_ids"] or [], row["known"] or []))
                bounds = tree.bounds(queries)
                told = [tree.search(int(i), q, b, k, least.get(int(i), _LOWEST)) for i, q, b in zip(ids, queries, bounds)]
                yield record_batch(
                    query_id=np.repeat(ids, [len(t[0]) for t in told]),
                    vec_id=np.concatenate([t[0] for t in told]),
                    score=np.concatenate([t[1] for t in told]),
                )

    return run


def quantised(embedding: Column, scale: int = 64) -> Column:
    """Each component as ``floor(scale * x)``; null where the vector or a component is null or
    not finite."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(ok, whole)


def top_k(vectors: DataFrame, wanted: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row of ``vectors(vec_id, vector)`` where ``wanted`` holds, the ``k`` others with the
    highest inner product: ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``.

    ``vector`` is an array of longs. Rows with a null id or vector take no part; vectors of
    another dimension do not meet; all rows that carry the query's own id are left out, and
    queries that repeat an id are one query, the one with the smallest vector. Fewer than ``k``
    others give fewer rows; an empty table gives none. Inner products are exact as far as
    they fit a long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector"), wanted.alias("wanted")
    ).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.withColumn("dim", F.size("vector"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("wanted").alias("q")).first()
    shards, blocks = 1 + sizes["n"] // shard_rows, 1 + sizes["q"] // query_rows
    base = new_path(spark, "kd")

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    trees = rows.withColumn("shard", dealt(shards)).groupBy("dim", "shard").applyInArrow(_tree, "dim int, shard int, tree binary")
    trees.write.parquet(f"{base}/trees")
    queries = rows.filter("wanted").groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.withColumn("block", dealt(blocks)).groupBy("dim", "block")
    asked.applyInArrow(_block, "dim int, block int, queries binary").write.parquet(f"{base}/blocks")
    trees = spark.read.schema("dim int, shard int, tree binary").parquet(f"{base}/trees")
    asked = spark.read.schema("dim int, block int, queries binary").parquet(f"{base}/blocks")
    found = "query_id long, vec_id long, score long"
    none = F.array().cast("array<long>")

    # Every block asks one shard first: the k-th scores from there bound the rest.
    home = F.pmod(F.col("block"), F.lit(shards)).alias("shard")
    first = asked.select("*", home).join(trees, ["dim", "shard"])
    first = first.select("tree", "queries", none.alias("known_ids"), none.alias("known")).mapInArrow(_searcher(k), found)
    known = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    known = known.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    known = known.agg(F.collect_list("query_id").alias("known_ids"), F.collect_list("least").alias("known"))
    known.write.parquet(f"{base}/known")
    known = spark.read.schema("block int, known_ids array<long>, known array<long>").parquet(f"{base}/known")

    # All trees against all blocks, one pair a row.
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.join(asked.join(known, "block", "left"), ["dim", "block"])
    pairs = pairs.repartition(shards * blocks, "shard", "block").select("tree", "queries", "known_ids", "known")
    best = pairs.mapInArrow(_searcher(k), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
