"""An inverted index stored by term, and exact ranking that reads little of it.

A term's postings are cut into blocks of about ``BLOCK`` by where the item lies, each with its
largest weight; blocks lie on the shelves of their term, those of a frequent term on several.
A dictionary has each term's number of postings and largest weight. A posting is the number of
an item and how often it has the term, packed in two to four bytes in the task that reads
the item's vector; what an item is called and its norm are in a table of their own, once.

A batch of questions is ranked in three reads. The rarest terms of a question give scores to
some items, and the ``top_k``-th of them bounds the result from below. Terms whose largest
possible shares together stay below that bound cannot bring an item into the result on their
own: only the blocks of the other terms are read, and of these only blocks whose largest
weight can still reach the bound. A posting is read once for all questions and scored in the
task that has its item. The items found there that can still reach the bound are then looked
up in all terms of their questions, block by block. Nothing is approximate: every item that
could be among the first ``top_k``, ties included, gets its whole score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.shelves import PART, SHELF, Shelves, shelve
from corpusloom.session import new_path, stored

# Postings of a block, and blocks of one part of a term.
BLOCK = 512
BLOCKS_PER_PART = 64
# Postings a map task groups by term at a time, about how many of them it packs at a time, and bytes of
# packed ones unpacked at a time.
FLUSH = 1_500_000
PACKED = 1 << 18
UNPACKED = 1 << 20
# Places the items are spread over until they are stored on their own.
SPREAD = 4_096
# The first read takes the rarest terms until they have this many postings per wanted item.
FIRST = 4
_ROUNDING = retrieval.ROUNDING


@dataclass(frozen=True)
class Postings:
    terms: Shelves  # term, df, largest, pieces
    blocks: Shelves  # term, piece, pieces, largest, n, entries ARRAY<BINARY>, packed: no, tf
    items: DataFrame  # no, item, norm
    total: int
    per_task: int
    blocks_per_part: int


def _place(no: Column, per_task: int) -> Column:
    """Where an item lies among all, given the most rows of a task; its number is one of Spark's row ids."""
    return F.shiftright(no, 33) * F.lit(per_task) + no.bitwiseAND(F.lit((1 << 33) - 1))


def _piece(place: Column, pieces: Column, total: int) -> Column:
    """The piece an item is in: items in a row are in one, so that a task has few pieces of a term."""
    span = F.greatest(F.lit(1), F.floor(F.lit(total) / pieces))
    return F.pmod(F.floor(place / span), pieces).cast("int")


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, lowest first, the last one below 128; and how many bytes each has."""
    width = np.ones(len(values), np.uint8)
    for i in range(1, 10):
        more = values >= np.uint64(1 << 7 * i)
        if not more.any():
            break
        width += more
    start = np.cumsum(width, dtype=np.int64) - width
    out = np.empty(int(width.sum(dtype=np.int64)), np.uint8)
    for i in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > i)
        group = ((values[some] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8)
        out[start[some] + i] = group | ((width[some] > i + 1).astype(np.uint8) << 7)
    return out, width


def _numbers(data: np.ndarray) -> np.ndarray:
    """The numbers of ``_packed`` bytes."""
    last = np.flatnonzero(data < 128)
    start = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of the groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _pieces(terms: pa.Array, folder: str) -> np.ndarray:
    """The number of blocks of each term; ``folder`` has those of more than one, read a part at a time."""
    pieces = np.ones(len(terms), np.int64)
    files, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    for batch in dataset.dataset(root, filesystem=files, format="parquet").to_batches(columns=["term", "pieces"]):
        at = pc.fill_null(pc.index_in(terms, value_set=batch.column("term")), -1).to_numpy()
        pieces[at >= 0] = batch.column("pieces").to_numpy()[at[at >= 0]]
    return pieces


# A packed run of a term's postings.
_RUN = [("term", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("part", pa.int32())]
_RUN += [("largest", pa.float32()), ("n", pa.int64()), ("payload", pa.binary())]


def _runs(folder: str, total: int, blocks_per_part: int):
    """A ``mapInArrow`` function: the items of ``no, place, item, norm, term ARRAY, tf ARRAY``, and their postings
    by term and piece. A row is an item or a packed run, first the steps from item to item, then the counts."""

    def grouped(held: list[dict], items: dict) -> Iterator[dict]:
        codes = pa.chunked_array([h["term"] for h in held]).unify_dictionaries().chunks
        terms, code = codes[0].dictionary, np.concatenate([c.indices.to_numpy() for c in codes])
        tf, sizes = (np.concatenate([h[c] for h in held]) for c in ("tf", "sizes"))
        no, place, norm = (items[c].to_numpy() for c in ("no", "place", "norm"))
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pieces = _pieces(terms, folder)
        base = np.cumsum(pieces) - pieces
        at = place[row]
        at //= np.maximum(1, total // pieces)[code]
        at %= pieces[code]
        at += base[code]
        order = np.argsort(at, kind="stable")
        at = at[order]
        heads = _heads(at)
        of = code[order[heads]]
        piece = at[heads] - base[of]
        del at, code
        row, tf = row[order], tf[order]
        del order
        ends = np.r_[heads[1:], len(row)]
        cuts = 1 + np.flatnonzero(np.diff(heads // PACKED))
        for i, j in zip([0, *cuts], [*cuts, len(heads)]):
            start, end = heads[i], ends[j - 1]
            head, n, r = heads[i:j] - start, ends[i:j] - heads[i:j], row[start:end]
            largest = np.maximum.reduceat((1 + np.log(tf[start:end])) / norm[r], head).astype(np.float32)
            step = np.diff(no[r], prepend=0)
            step[head] = no[r[head]]
            where = np.repeat(2 * head, n) + _within(n)
            values = np.empty(2 * len(r), np.uint64)
            values[where], values[where + np.repeat(n, n)] = step, tf[start:end]
            data, width = _packed(values)
            offsets = np.r_[0, np.cumsum(np.add.reduceat(width, 2 * head, dtype=np.int64))].astype(np.int32)
            yield {
                "term": terms.take(pa.array(of[i:j])),
                "piece": piece[i:j],
                "pieces": pieces[of[i:j]],
                "part": piece[i:j] // blocks_per_part,
                "largest": np.nextafter(largest, np.float32(np.inf)),  # not below any of them
                "n": n,
                "payload": pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
            }

    def flushed(held: list[dict]) -> Iterator[pa.RecordBatch]:
        items = {c: pa.concat_arrays([h[c] for h in held]) for c in ("no", "place", "item", "norm")}
        items["part"] = pc.bit_wise_and(items["no"], SPREAD - 1)
        schema = pa.schema(_RUN + [(c, items[c].type) for c in ("no", "item", "norm")])
        found = grouped(held, items) if any(len(h["tf"]) for h in held) else ()
        for columns in chain([items], found):
            size = len(columns["part"])
            arrays = [pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.list_value_length(batch.column("term")), 0).to_numpy()
            cuts = 1 + np.flatnonzero(np.diff(np.cumsum(sizes) // FLUSH))
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                some = batch.take(pa.array(np.arange(start, end)))
                term, tf = (some.column(c).flatten() for c in ("term", "tf"))
                own = {"term": term.dictionary_encode(), "tf": tf.to_numpy().astype(np.uint32), "sizes": sizes[start:end]}
                held.append(own | {c: some.column(c) for c in ("no", "place", "item", "norm")})
                n += len(tf)
                if n >= FLUSH:
                    yield from flushed(held)
                    held, n = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from flushed(held)

    return run


def build(vectors: DataFrame, key: str = "chunk_id", block: int = BLOCK, blocks_per_part: int = BLOCKS_PER_PART) -> Postings:
    """The stored index of ``retrieval.term_vectors`` rows, a stored table of one row per key.

    Items are numbered and postings are grouped and packed in the task that reads them, so a posting
    is never a row; a frequent term's are dealt to its blocks there, so no task holds a term.
    Its number of blocks is a power of two; the table that says so has at most one row per
    ``block`` postings.
    """
    rows = retrieval.chunk_postings(vectors, key)
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("largest"))
    pieces = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / block)))).cast("int")
    terms = stored(counts.withColumn("pieces", pieces), "term-counts")
    hubs = terms.filter(F.col("pieces") > blocks_per_part)
    hubs = hubs.select("term", F.ceil(F.col("pieces") / blocks_per_part).cast("int").alias("parts"))
    often = new_path(vectors.sparkSession, "frequent-terms")
    terms.filter(F.col("pieces") > 1).select("term", "pieces").write.parquet(often)

    sizes = vectors.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    total, per_task = sizes.agg(*[F.coalesce(f("n"), F.lit(0)) for f in (F.sum, F.max)]).first()
    numbered = vectors.withColumn("no", F.monotonically_increasing_id()).withColumn("place", _place(F.col("no"), per_task))
    numbered = numbered.select("no", "place", F.col(key).alias("item"), "norm", F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf"))
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"term string, piece int, pieces int, part int, largest float, n long, payload binary, no long, item {kind}, norm double"
    runs = numbered.mapInArrow(_runs(often, total, blocks_per_part), schema).withColumnRenamed("part", PART)

    def blocks(placed: DataFrame) -> DataFrame:
        return placed.groupBy(SHELF, PART, "term", "piece", "pieces", "no").agg(
            F.max("largest").alias("largest"),
            F.sum("n").alias("n"),
            F.collect_list("payload").alias("entries"),
            F.first("item").alias("item"),
            F.first("norm").alias("norm"),
        )

    # Items go with their postings, so that both have the same numbers, without a key: no term finds them.
    n_blocks = terms.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0]
    shelved = shelve(runs, ("term",), "postings", rows_per_shelf=4_096, hubs=hubs, n_rows=n_blocks, gather=blocks)
    items = stored(shelved.rows.filter("no IS NOT NULL").select("no", "item", "norm"), "posting-items")
    shelved = replace(shelved, rows=shelved.rows.drop("no", "item", "norm"))
    return Postings(shelve(terms, ("term",), "terms"), shelved, items, total, per_task, blocks_per_part)


def weigh(index: Postings, queries: DataFrame) -> DataFrame:
    """``query_id, top_k, term, weight, df, pieces, bound`` of the terms of ``queries`` the index has;
    ``bound`` is the largest share of a score the term can have."""
    found = index.terms.lookup(retrieval.query_terms(queries))
    weighted = found.withColumn("w", (1 + F.log("tf")) * F.log(F.lit(index.total) / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    weighted = weighted.withColumn("weight", F.try_divide(F.col("w"), norm))
    kept = weighted.filter(F.col("weight") > 0)
    return kept.select("query_id", "top_k", "term", "weight", "df", "pieces", (F.col("weight") * F.col("largest")).alias("bound"))


def _unpacked(blocks: DataFrame, *keep: str) -> DataFrame:
    """The postings of ``blocks``: ``keep, no, tf``."""
    rows = blocks.select(*keep, F.explode("entries").alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("entries")).to_numpy()
            cuts = 1 + np.flatnonzero(np.diff(np.cumsum(sizes) // UNPACKED))
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]) if len(sizes) else ():
                data = np.frombuffer(b"".join(batch.column("entries")[start:end].to_pylist()), np.uint8)
                first = np.cumsum(sizes[start:end]) - sizes[start:end]
                n = np.add.reduceat(data < 128, first, dtype=np.int64) // 2
                values, head = _numbers(data), np.cumsum(n) - n
                where = np.repeat(2 * head, n) + _within(n)
                no = np.cumsum(values[where])
                no -= np.repeat(no[head] - values[2 * head], n)
                row = pa.array(np.repeat(np.arange(start, end), n))
                columns = [batch.column(c).take(row) for c in keep]
                columns += [pa.array(x.view(np.int64)) for x in (no, values[where + np.repeat(n, n)])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "no", "tf"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "no long", "tf long"]))


def _entries(index: Postings, asked: DataFrame, *keep: str) -> DataFrame:
    """The postings of the blocks of ``asked(query_id, term, weight, ...)``: an item's share."""
    met = _unpacked(index.blocks.lookup(asked), "query_id", *keep, "weight").join(index.items, "no")
    share = F.col("weight") * ((1 + F.log("tf")) / F.col("norm"))
    return met.select("query_id", *keep, "no", share.alias("share"))


def floors(index: Postings, weights: DataFrame) -> DataFrame:
    """``query_id, floor``: a bound from below on the ``top_k``-th score, from the rarest terms."""
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = weights.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0)))
    rare = rare.filter(F.col("before") < FIRST * F.col("top_k")).select("query_id", "top_k", "term", "weight")
    scored = _entries(index, stored(rare, "rare-terms"), "top_k").groupBy("query_id", "top_k", "no")
    scored = scored.agg(F.sum("share").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    last = scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("top_k"))
    last = last.groupBy("query_id", "top_k").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    return last.filter(F.col("n") == F.col("top_k")).select("query_id", "floor")


def plan(weights: DataFrame, bounds: DataFrame) -> DataFrame:
    """``weights`` with the question's ``floor``, whether the term is ``needed``, and ``others``, the most
    that all other terms of the question can give.

    Terms are taken by rising ``bound``: those that stay below the floor together are not
    needed to find items.
    """
    so_far = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    joined = weights.join(bounds, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _ROUNDING)
    joined = joined.withColumn("needed", F.sum("bound").over(so_far) >= F.col("floor"))
    return joined.withColumn("others", F.sum("bound").over(Window.partitionBy("query_id")) - F.col("bound"))


def rank(index: Postings, queries: DataFrame, max_k: int | None = None) -> DataFrame:
    """``query_id, item, score, rank`` of the ``top_k`` best items of each of ``queries(query_id, text,
    top_k)``: cosine of the log-weighted terms, rounded to six decimals, ties to the smaller item."""
    weights = stored(weigh(index, queries), "query-weights")
    planned = stored(plan(weights, stored(floors(index, weights), "query-floors")), "query-plan")

    # Items with a needed term, out of the blocks that can reach the floor of one of the questions.
    needed = planned.filter("needed")
    rest = planned.filter("NOT needed").groupBy("query_id").agg(F.sum("bound").alias("most"))
    asked = needed.groupBy("term").agg(F.min((F.col("floor") - F.col("others")) / F.col("weight")).alias("least"))
    able = index.blocks.lookup(stored(asked, "needed-terms")).filter(F.col("largest") >= F.col("least") - _ROUNDING)
    bounds = needed.join(rest, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(0.0)))
    k = max_k if max_k is not None else queries.agg(F.coalesce(F.max("top_k"), F.lit(0))).first()[0]
    found = retrieval.reaching(_items(index, able, F.col("no")), stored(bounds, "query-bounds"), k)
    found = stored(found.withColumnRenamed("item", "no"), "query-items")

    # Their whole scores, from the one block of each term of their questions that an item can be in.
    open_ = found.join(planned.select("query_id", "term", "pieces"), "query_id")
    place = _place(F.col("no"), index.per_task)
    open_ = open_.select("term", _piece(place, F.col("pieces"), index.total).alias("piece"))
    at = open_.withColumn(PART, F.floor(F.col("piece") / index.blocks_per_part).cast("int")).distinct()
    at = stored(at, "open-blocks")
    met = index.blocks.at(at).join(at, ["term", "piece", PART], "left_semi")
    items = _items(index, met, F.col("item"), stored(found.select("no").distinct(), "found-items"))
    best = retrieval.rank_by_terms(items, "item", planned.select("query_id", "top_k", "term", "weight"), k)
    return best.select("query_id", "item", "score", "rank", "top_k")


def _items(index: Postings, blocks: DataFrame, name: Column, wanted: DataFrame | None = None) -> DataFrame:
    """The postings of ``blocks`` by item, each once however many questions ask for them: ``name`` as
    ``item, term, share``, of the ``wanted(no)`` items only."""
    rows = _unpacked(blocks, "term")
    rows = rows if wanted is None else rows.join(wanted, "no", "left_semi")
    listed = rows.groupBy("no").agg(F.collect_list(F.struct("term", "tf")).alias("e")).join(index.items, "no")
    share = F.transform("e", lambda t: (1 + F.log(t["tf"])) / F.col("norm"))
    return listed.select(name.alias("item"), F.col("e.term").alias("term"), share.alias("share"))
