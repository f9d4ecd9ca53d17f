"""A stored index of vectors: exact nearest neighbours of many questions without reading it all.

Space is cut by centres into cells, every vector lies in the cell of its nearest centre. A cell
is stored as blocks of unit vectors sorted by their distance from the centre, each block with the
range of its distances; cells are folders. For a question at distance ``d`` from a centre, the
triangle inequality says that a vector at distance ``r`` from that centre is at least ``|d - r|``
away: a block whose range cannot come as near as the question's ``k``-th neighbour so far is
passed over, and a cell whose blocks all are is not opened.

Questions first search the cells around them, which gives each a ``k``-th score, and then
every cell the bound leaves. With ``probes`` they search that many nearest cells only: fewer
reads, and most but not all of the neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import top_k
from corpusloom.session import new_path, power_of_two, stored

CELL = "cell"
BLOCK_ROWS = 2_048
QUESTIONS_AT_ONCE = 256
MOST_CELLS = 1_024
# The centres are fitted on the first vectors in hash order: at most so many for each, and in all
# no more than so many bytes; steps of the fit.
SAMPLE_PER_CENTRE = 32
SAMPLE_BYTES = 64 << 20
STEPS = 6
# Scores are rounded to six decimals before they are compared.
_ROUNDING = 1e-6

_BLOCKS = "cell int, nearest double, farthest double, ids array<long>, vectors binary"
_ASKED = "cell int, query_ids array<long>, queries binary, far array<double>, floors array<double>"
_FOUND = "query_id long, item_id long, score double"


@dataclass(frozen=True)
class VectorIndex:
    blocks: DataFrame
    centres: np.ndarray  # cells x dimension
    counts: np.ndarray  # vectors of each cell
    nearest: np.ndarray  # least and largest distance from the centre in each cell
    farthest: np.ndarray
    cells_read: list[int]  # of the last search, for reports and tests

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def _units(batch: pa.RecordBatch, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows of ``dim`` finite entries that are not all zero."""
    rows = [(i, v) for i, v in zip(batch.column(key).to_pylist(), batch.column("embedding").to_pylist()) if v is not None and len(v) == dim and None not in v]
    x = np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)
    length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    return np.array([i for i, _ in rows], np.int64)[good], x[good] / length[good, None]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(squares, 0))


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` cells, or fewer, by repeated means over the sample."""
    centres = np.unique(sample[:n], axis=0)
    for _ in range(STEPS):
        owner = _distances(sample, centres).argmin(axis=1)
        counts = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        centres = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _batch(columns: dict, schema: str, spark_types: dict) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], spark_types[n]) for n in names], names=names)


_TYPES = {
    "cell": pa.int32(),
    "nearest": pa.float64(),
    "farthest": pa.float64(),
    "ids": pa.list_(pa.int64()),
    "vectors": pa.binary(),
    "query_ids": pa.list_(pa.int64()),
    "queries": pa.binary(),
    "far": pa.list_(pa.float64()),
    "floors": pa.list_(pa.float64()),
}


def _placed(key: str, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _units(batch, key, centres.shape[1])
            if len(ids):
                distances = _distances(x, centres)
                cell = distances.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(distances[np.arange(len(x)), cell]), pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["cell", "distance", "item_id", "vector"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks out of rows sorted by cell and distance."""
    cell, held = None, []

    def told() -> pa.RecordBatch:
        distances, ids, vectors = zip(*held)
        columns = {"cell": [cell], "nearest": [distances[0]], "farthest": [distances[-1]], "ids": [list(ids)], "vectors": [b"".join(vectors)]}
        return _batch(columns, _BLOCKS, _TYPES)

    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (own != cell or len(held) >= BLOCK_ROWS):
                yield told()
                held = []
            cell = own
            held.append(row)
    if held:
        yield told()


def build(vectors: DataFrame, key: str = "item_id", cells: int | None = None) -> VectorIndex | None:
    """Index ``vectors(key, embedding)``; None where no vector can be ranked.

    Every vector of the commonest dimension with finite entries that are not all zero is
    indexed. The centres are fitted on a bounded sample and decide on speed only. A crowded
    cell is cut over several tasks and blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("item_id IS NOT NULL AND size(embedding) > 0")
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return None
    dim, n = common["dim"], common["count"]
    cells = cells or min(MOST_CELLS, power_of_two(n**0.5))
    wanted = max(cells, min(cells * SAMPLE_PER_CENTRE, SAMPLE_BYTES // (8 * dim)))
    same = rows.filter(F.size("embedding") == dim)
    first = same.orderBy(F.xxhash64("item_id"), "item_id").limit(wanted).toArrow()
    sample = np.concatenate([np.zeros((0, dim)), *(_units(b, "item_id", dim)[1] for b in first.to_batches())])
    if not len(sample):
        return None
    centres = _fit(sample, cells)
    placed = same.mapInArrow(_placed("item_id", centres), "cell int, distance double, item_id long, vector binary")
    path = new_path(spark, "vector-rows")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    spread = placed.repartitionByRange(1 + n * dim * 8 // (32 << 20), CELL, "distance", "item_id")
    path = new_path(spark, "vector-index")
    spread.sortWithinPartitions(CELL, "distance", "item_id").mapInArrow(_cut, _BLOCKS).write.partitionBy(CELL).parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    told = blocks.groupBy(CELL).agg(F.sum(F.size("ids")).alias("n"), F.min("nearest").alias("near"), F.max("farthest").alias("far")).collect()
    counts, near, far = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in told:
        counts[r[CELL]], near[r[CELL]], far[r[CELL]] = r["n"], r["near"], r["far"]
    return VectorIndex(blocks, centres, counts, near, far, [])


def _most(gap: np.ndarray) -> np.ndarray:
    """The largest cosine of unit vectors at least ``gap`` apart."""
    return 1 - np.maximum(gap, 0) ** 2 / 2


def _first_cells(far: np.ndarray, counts: np.ndarray, k: int, probes: int | None) -> np.ndarray:
    """Which cells each question searches first: ``probes`` nearest ones, or as many as hold ``k``."""
    far = np.where(counts > 0, far, np.inf)
    order = far.argsort(axis=1, kind="stable")
    if probes is None:
        before = np.cumsum(counts[order], axis=1) - counts[order]
        taken = before < k
    else:
        taken = np.broadcast_to(np.arange(far.shape[1]) < probes, far.shape)
    chosen = np.zeros(far.shape, bool)
    np.put_along_axis(chosen, order, taken, axis=1)
    return chosen & (counts > 0)


def _asker(centres, counts, nearest, farthest, k: int, probes: int | None, later: bool):
    """Questions under the cells they search: first, or later, when their floor is known."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUESTIONS_AT_ONCE):
                part = batch.slice(start, QUESTIONS_AT_ONCE)
                known = dict(zip(part.column("query_id").to_pylist(), part.column("floor").to_pylist()))
                ids, x = _units(part, "query_id", dim)
                floors = np.array([-2.0 if known[i] is None else known[i] for i in ids.tolist()])
                far = _distances(x, centres)
                chosen = _first_cells(far, counts, k, probes)
                if later:
                    able = _most(np.maximum(far - farthest, nearest - far)) >= floors[:, None] - _ROUNDING
                    chosen = able & ~chosen & (counts > 0)
                for cell in np.flatnonzero(chosen.any(axis=0)):
                    mine = np.flatnonzero(chosen[:, cell])
                    columns = {
                        "cell": [cell],
                        "query_ids": [ids[mine]],
                        "queries": [x[mine].tobytes()],
                        "far": [far[mine, cell]],
                        "floors": [floors[mine]],
                    }
                    yield _batch(columns, _ASKED, _TYPES)

    return run


def _scorer(k: int, dim: int):
    """The ``k`` best of a block for each of its questions that it can still serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                near, far_, ids, vectors, asked, queries, far, floors = (c[i].as_py() for c in batch.columns)
                far, floors = np.array(far), np.array(floors)
                able = _most(np.maximum(far - far_, near - far)) >= floors - _ROUNDING
                if not able.any():
                    continue
                queries = np.frombuffer(queries).reshape(-1, dim)[able]
                asked, floors, ids = np.array(asked)[able], floors[able], np.array(ids)
                scores = np.round(queries @ np.frombuffer(vectors).reshape(-1, dim).T, 6)
                least = np.maximum(floors - _ROUNDING, np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else -2)
                q, j = np.nonzero(scores >= least[:, None])
                order = np.lexsort((ids[j], -scores[q, j], q))
                q, j = q[order], j[order]
                begin = np.searchsorted(q, q, side="left")
                kept = np.arange(len(q)) - begin < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[q[kept]]), pa.array(ids[j[kept]]), pa.array(scores[q[kept], j[kept]])],
                    names=["query_id", "item_id", "score"],
                )

    return run


def _searched(index: VectorIndex, asked: DataFrame, k: int, name: str) -> DataFrame:
    """The neighbours in the cells of ``asked``; only their folders are read."""
    asked = stored(asked, name)
    cells = sorted(r[0] for r in asked.select(CELL).distinct().collect())
    index.cells_read[:] = sorted({*index.cells_read, *cells})
    here = index.blocks.filter(F.col(CELL).isin(cells) if cells else F.lit(False))
    met = here.join(asked, CELL).select("nearest", "farthest", "ids", "vectors", "query_ids", "queries", "far", "floors")
    return met.mapInArrow(_scorer(k, index.dim), _FOUND)


def nearest(index: VectorIndex | None, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` vectors of largest cosine for each of
    ``queries(query_id, embedding)``: rounded to six decimals, ties to the smaller id.

    Exact unless ``probes`` is given. Questions without a finite vector of the index's
    dimension that is not all zero find nothing; ids of questions must be distinct.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], f"{_FOUND}, rank long")
    index.cells_read.clear()
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("query_id IS NOT NULL")
    facts = (index.centres, index.counts, index.nearest, index.farthest, k, probes)
    order = [F.desc("score"), F.col("item_id")]
    open_ = rows.withColumn("floor", F.lit(None).cast("double"))
    found = _searched(index, open_.mapInArrow(_asker(*facts, False), _ASKED), k, "asked-first")
    if probes is not None:
        return top_k(found, ["query_id"], order, k)
    first = stored(top_k(found, ["query_id"], order, k), "neighbours-first")
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    known = rows.join(floors, "query_id", "left")
    more = _searched(index, known.mapInArrow(_asker(*facts, True), _ASKED), k, "asked-later")
    return top_k(first.drop("rank").unionByName(more), ["query_id"], order, k)
