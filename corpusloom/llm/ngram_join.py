"""Near-duplicate documents: an exact n-gram Jaccard join by prefixes under several orders.

1. Every document becomes the set of its different word n-grams. Documents with equal sets are
   one class, and the smallest document stands for it.
2. An inverted index of the representatives gives each n-gram's document frequency. N-grams of
   one document only are never listed: a document at least 80 % of whose n-grams occur
   elsewhere is the only kind that can have a link, and few do.
3. A global order of all n-grams that begins with the unlisted ones puts them first in every
   document's prefix, the ``n - ceil(0.8 n) + 1`` first n-grams. Two linked documents share a
   prefix n-gram under each such order. Three are used: by rising frequency, and by two
   different hashes. Pairs come from the first and must pass the others before they are
   verified on the listed n-grams, which hold the whole intersection.
4. Lists are first walked from one document to the next, each list in an order of its own.
   Verified steps join documents into components; then only pairs of the same list that lie in
   different components are left, and all of those are tested whose sizes and places in the
   order allow a link. So every link between different components is found, without the
   pairs inside a group of near copies.

N-grams are 48-bit hashes in the index (64-bit in the sets): a pair with 1,000 n-grams each
has one chance in 280 million to count one too many in common.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import grams, mix, record_batch, release, slices, word_hashes, words
from corpusloom.llm.components import components
from corpusloom.session import new_path, write_once

N = 5
PERCENT = 80
# Postings a map task sorts at a time, and postings of one part of the index.
FLUSH = 1_000_000
PART = 1_000_000
# Bytes of text whose sets are made at a time.
SLICE_BYTES = 2 << 20
# An n-gram in more documents than this of one flush sends a count to its part and its
# documents as a row of their own.
OFTEN = 64
# Frequencies that the order of n-grams tells apart.
MOST_DF = (1 << 15) - 1
# Members of a list that are walked as one chain; how many of those before it in a list, and
# how many in all, a document tries first.
CHAIN = 100_000
STEPS = 6
EARLIER = 16
TRIES = 24
_BITS = np.uint64(48)
_SHORT = np.uint64(0xA24BAED4963EE407)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The n-gram set of each text, as ascending 64-bit hashes. Fewer than ``n`` words are one
    n-gram together."""
    coded, bounds = words(batch.column("text"), lower=True)
    hashes = word_hashes(coded)
    shingles = grams(hashes, n)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= n:
            found = np.sort(shingles[begin : end - n + 1])
            yield found[np.r_[True, found[1:] != found[:-1]]]
        elif end > begin:
            yield grams(hashes[begin:end], end - begin) ^ mix(np.array([end - begin], np.uint64) * _SHORT)
        else:
            yield np.empty(0, np.uint64)


def _key(found: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(found.tobytes()))


def shingle_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """``doc_id, n_shingles, k1, k2``: size and 128-bit key of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            sizes, keys = [], []
            for found in _sets(batch, n):
                sizes.append(len(found))
                keys.append(_key(found))
            k1, k2 = zip(*keys)
            yield record_batch(doc_id=batch.column("doc_id"), n_shingles=sizes, k1=k1, k2=k2)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes needed per value, and the values byte by byte, lowest first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _write_postings(tokens: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    often = np.flatnonzero(counts > 1)
    token_width, token_bytes = _planes(np.diff(tokens, prepend=np.uint64(0)))
    doc_width, doc_bytes = _planes(docs.view(np.uint64))
    head = struct.pack("<IIBB", len(tokens), len(often), token_width, doc_width)
    return head + token_bytes + doc_bytes + often.astype("<u4").tobytes() + counts[often].astype("<u8").tobytes()


def _read_postings(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, often, token_width, doc_width = struct.unpack_from("<IIBB", data)
    at = struct.calcsize("<IIBB")
    tokens = np.cumsum(_from_planes(data, at, n, token_width))
    at += n * token_width
    docs = _from_planes(data, at, n, doc_width).view(np.int64)
    at += n * doc_width
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, "<u4", often, at)] = np.frombuffer(data, "<u8", often, at + often * 4)
    return tokens, docs, counts


def _parts_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def _flushed(tokens: list[np.ndarray], docs: list[np.ndarray], parts: int) -> pa.RecordBatch:
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[begin, len(token)])
    hot = length > OFTEN
    part, frequent, payload = [], [], []
    for b, n in zip(begin[hot], length[hot]):
        part.append(int(_parts_of(token[b : b + 1], parts)[0]))
        frequent.append(True)
        payload.append(_write_postings(np.repeat(token[b], n), np.sort(doc[b : b + n]), np.ones(n, np.int64)))
    kept = np.repeat(~hot, length)
    kept[begin[hot]] = True
    counts = np.ones(len(token), np.int64)
    counts[begin[hot]] = length[hot]
    token, doc, counts = token[kept], doc[kept], counts[kept]
    where = _parts_of(token, parts)
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    for b, e in zip(cuts, [*cuts[1:], len(token)]):
        part.append(int(where[b]))
        frequent.append(False)
        payload.append(_write_postings(token[b:e], doc[b:e], counts[b:e]))
    return record_batch(part=pa.array(part, pa.int32()), often=frequent, payload=pa.array(payload, pa.binary()))


def _postings(chosen: DataFrame, n: int, parts: int) -> DataFrame:
    """Sorted runs of postings of the documents whose set is the one they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, docs, held, last = [], [], 0, None
        for batch in slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), _sets(batch, n))
            for doc_id, k1, k2, found in rows:
                if doc_id == last or _key(found) != (k1, k2):
                    continue
                last = doc_id
                tokens.append(found >> (np.uint64(64) - _BITS))
                docs.append(np.full(len(found), doc_id, np.int64))
                held += len(found)
            if held >= FLUSH:
                yield _flushed(tokens, docs, parts)
                tokens, docs, held = [], [], 0
        if held:
            yield _flushed(tokens, docs, parts)
        del tokens, docs
        release()

    return chosen.mapInArrow(run, "part int, often boolean, payload binary")


def _copies(docs: DataFrame, n: int) -> DataFrame:
    """One row of each ``doc_id`` whose set is the one it stands for, wherever its copies lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            yield batch.filter(pa.array([_key(found) == key for key, found in zip(keys, _sets(batch, n))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).dropDuplicates(["doc_id"])


def _shared(postings: DataFrame) -> DataFrame:
    """``doc_id, token, df`` of all n-grams in two documents or more. A part's runs are merged in
    memory; documents of an n-gram that is frequent in one flush pass by a flush at a time."""

    def merged(runs: list[bytes]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        read = [_read_postings(r) for r in runs]
        token, doc, count = (np.concatenate(c) for c in zip(*read))
        order = np.argsort(token, kind="stable")
        token, doc, count = token[order], doc[order], count[order]
        begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.add.reduceat(count, begin)
        per_posting = np.repeat(df, np.diff(np.r_[begin, len(token)]))
        listed = (per_posting > 1) & (count == 1)
        out = record_batch(doc_id=doc[listed], token=token[listed].astype(np.int64), df=per_posting[listed])
        return out, token[begin[df > 1]], df[df > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, tokens, dfs = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and runs:
                    yield merged(runs)[0]
                    runs = []
                part = row["part"]
                if not row["often"]:
                    runs.append(row["payload"])
                    continue
                if runs:
                    out, tokens, dfs = merged(runs)
                    yield out
                    runs = []
                token, doc, _ = _read_postings(row["payload"])
                df = dfs[np.searchsorted(tokens, token[0])]
                yield record_batch(doc_id=doc, token=token.astype(np.int64), df=np.repeat(df, len(doc)))
        if runs:
            yield merged(runs)[0]
        del runs, tokens, dfs
        release()

    return postings.mapInArrow(run, "doc_id long, token long, df long")


def _stored(df: DataFrame, name: str) -> DataFrame:
    return write_once(df, new_path(df.sparkSession, name))


def _packed(df: Column, token: Column) -> Column:
    """Frequency and token as one number, which sorts by both. From ``MOST_DF`` on all frequencies sort as
    one, which only orders n-grams; a list of numbers is a quarter of a list of structs when it moves."""
    return F.shiftleft(F.least(df, F.lit(MOST_DF)), int(_BITS)).bitwiseOR(token)


def _token(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << int(_BITS)) - 1))


def _prefix(order: Column, room: Column) -> Column:
    """The first ``room`` of the packed ``tokens`` under an order (a function of each)."""
    ordered = F.array_sort(F.transform("tokens", lambda t: F.struct(order(t).alias("o"), _token(t).alias("token"))))
    return F.transform(F.slice(ordered, 1, room), lambda t: t["token"])


def _survivors(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Documents that can have a link: size, listed n-grams, and a prefix per order."""
    least = F.ceil(F.col("n") * percent / 100)
    listed = shared.groupBy("doc_id").agg(F.collect_list(_packed(F.col("df"), F.col("token"))).alias("tokens"))
    kept = listed.join(sets, "doc_id").filter(F.size("tokens") >= least)
    room = (F.size("tokens") - least + 1).cast("int")
    orders = {
        "by_df": lambda t: t,
        "by_hash": lambda t: F.xxhash64(F.lit(1), _token(t)),
        "by_other_hash": lambda t: F.xxhash64(F.lit(2), _token(t)),
    }
    prefixes = [_prefix(order, room).alias(name) for name, order in orders.items()]
    return kept.select("doc_id", "n", *prefixes, F.transform("tokens", _token).alias("tokens"))


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first common n-gram stands at these places of the
    order can have the similarity: by their sizes, and by what is left from there on."""
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & ((100 + percent) * F.least(n_a - at_a, n_b - at_b) >= percent * (n_a + n_b))


def _verified(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that pass all prefix filters and have the similarity."""
    sides = [survivors.select(*[F.col(c).alias(f"{c}_{side}") for c in survivors.columns]) for side in "ab"]
    full = pairs.join(sides[0], pairs["a"] == F.col("doc_id_a")).join(sides[1], pairs["b"] == F.col("doc_id_b"))
    filters = [F.arrays_overlap(f"{o}_a", f"{o}_b") for o in ("by_hash", "by_other_hash")]
    full = full.filter(reduce(lambda x, y: x & y, filters))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return full.filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _chained(lists: DataFrame, percent: int) -> DataFrame:
    """First pairs to try: each list's members in an order of its own, every one with the few
    before that are of about its size. Long lists are walked in several chains. A document
    tries ``TRIES`` partners; what is not tried here is left to ``_across``."""
    size, at = F.col("n"), F.col("at")
    lists = lists.drop("earlier").filter(_possible(size, at, size, at, percent))  # others may pair with smaller ones only
    hot = lists.groupBy("token").count().filter(F.col("count") > CHAIN)
    chains = F.ceil(F.col("count") / CHAIN)
    salted = lists.join(hot, "token", "left").select(
        *lists.columns,
        F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), chains)).cast("int").alias("chain"),
        F.floor(F.log("n") / F.log(F.lit(1.1))).alias("size"),
        F.xxhash64("token", "doc_id").alias("turn"),
    )
    walk = Window.partitionBy("token", "chain").orderBy("size", "turn", "doc_id").rowsBetween(-STEPS, -1)
    before = F.collect_list(F.struct("doc_id", "n", "at")).over(walk)
    steps = salted.select("doc_id", "n", "at", before.alias("lasts")).select("doc_id", "n", "at", F.explode("lasts").alias("last"))
    steps = steps.filter(_possible(F.col("n"), F.col("at"), F.col("last.n"), F.col("last.at"), percent))
    tries = steps.groupBy("doc_id", F.col("last.doc_id").alias("last")).count()
    turn = Window.partitionBy("doc_id").orderBy(F.desc("count"), F.xxhash64("doc_id", "last"), "last")
    tries = tries.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= TRIES)
    return tries.select(F.least("doc_id", "last").alias("a"), F.greatest("doc_id", "last").alias("b")).distinct()


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that lie in different components. Members of the list's largest
    component meet the others only. A pair that has one of its ``EARLIER`` n-grams before this one
    in common is left to that n-gram's list, where it is at least as possible."""
    sizes = lists.groupBy("token", "component").count()
    most = sizes.groupBy("token").agg(
        F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("different")
    )
    mixed = lists.join(most.filter("different > 1").drop("different"), "token")
    mixed = _stored(mixed, "mixed-lists")
    small = mixed.filter("component <> largest").select(
        "token",
        F.col("doc_id").alias("a"),
        F.col("n").alias("n_a"),
        F.col("at").alias("at_a"),
        F.col("earlier").alias("earlier_a"),
        F.col("component").alias("component_a"),
    )
    other = mixed.select(
        "token",
        F.col("doc_id").alias("b"),
        F.col("n").alias("n_b"),
        F.col("at").alias("at_b"),
        F.col("earlier").alias("earlier_b"),
        "component",
        "largest",
    )
    once = (F.col("component") == F.col("largest")) | (F.col("a") < F.col("b"))
    near = _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), percent)
    first = ~F.arrays_overlap("earlier_a", "earlier_b")
    pairs = small.join(other, "token").filter((F.col("component_a") != F.col("component")) & once & near & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``vertex, component`` of all representatives that have a link.

    ``sets`` are the stored ``shingle_sets`` of ``docs``.
    """
    classes = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    classes = classes.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("c")).select("doc_id", "c.*")
    classes = _stored(classes, "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    parts = 1 + total // PART
    texts = docs.join(classes.select("doc_id", "k1", "k2"), "doc_id").select("doc_id", "text", "k1", "k2")
    repeated = _stored(sets.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        # An n-gram counts once per document: copies may lie in different tasks.
        copies = _copies(texts.join(repeated, "doc_id", "left_semi"), n)
        texts = texts.join(repeated, "doc_id", "left_anti").unionAll(copies)
    postings = _postings(texts.sortWithinPartitions("doc_id"), n, parts)
    dealt = postings.repartition(parts, "part").sortWithinPartitions("part", "often")
    sizes = classes.select("doc_id", F.col("n_shingles").alias("n"))
    # Stored first: the shuffles of texts and of postings are gone before the listed ones move.
    shared = _stored(_shared(dealt), "shared")
    survivors = _stored(_survivors(shared, sizes, percent), "survivors")
    unlisted = F.greatest(F.col("n") - F.size("tokens"), F.lit(0))
    earlier = F.transform("by_df", lambda t, i: F.slice("by_df", F.greatest(i - EARLIER + 1, F.lit(1)), F.least(i, F.lit(EARLIER))))
    placed = F.arrays_zip(F.col("by_df").alias("token"), earlier.alias("earlier"))
    lists = survivors.select("doc_id", "n", unlisted.alias("before"), F.posexplode(placed).alias("place", "p"))
    lists = lists.select("doc_id", "n", "p.token", "p.earlier", (F.col("before") + F.col("place")).alias("at"))
    shared_lists = lists.groupBy("token").count().filter("count > 1").select("token")
    lists = _stored(lists.join(shared_lists, "token", "left_semi"), "lists")
    edges = _stored(_verified(_chained(lists, percent), survivors, percent), "edges")
    first = _stored(components(edges), "first-components")
    placed = lists.join(first, lists["doc_id"] == first["vertex"], "left").select(
        "token", "doc_id", "n", "at", "earlier", F.coalesce("component", "doc_id").alias("component")
    )
    more = _stored(_verified(_across(placed, percent), survivors, percent), "more-edges")
    if more.isEmpty():
        return first
    return components(first.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionAll(more))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Words are what stands between ASCII white space, A-Z lower-cased. A document's set holds
    its different n-grams of ``n`` words, or all its words as one where there are fewer. Two
    documents link where ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest document reachable.

    A null text, or one without words, has an empty set and is linked with nothing. A null
    ``doc_id`` has a null component, unless it is a copy of a document with an id. Rows that repeat a ``doc_id`` with
    another text keep their own set size; links are those of one of its texts (the one with the
    smallest key). Other columns are not looked at; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = _stored(shingle_sets(rows, n), "shingle-sets")
    found = links(rows, sets, n, percent)
    classes = sets.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("first"))
    classes = classes.join(found, classes["first"] == found["vertex"], "left")
    classes = classes.select("k1", "k2", "n_shingles", F.coalesce("component", "first").alias("component_id"))
    joined = sets.join(classes, ["k1", "k2", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the smallest; all columns stay."""
    found = near_duplicates(docs, n, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    found = _stored(found, "left-out")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
