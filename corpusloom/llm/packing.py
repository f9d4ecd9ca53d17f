"""Packing documents into token windows by lexical retrieval.

Documents are taken in the order they come, in shards of bounded size. A document longer
than a window gives whole windows first; what is left of it is a unit of its shard. Each
shard has a BM25 inverted index over its units. The next unused unit seeds a window; the
index returns its unused neighbours by score, and they fill the window greedily. The last
one is cut where the window ends, and its rest stays in the shard. What does not fill a
window at the end of a shard is cut into sequences whose lengths are powers of two, which
need no padding. Nothing is shuffled, so documents that stand together, as after mixing,
are packed together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.llm.batches import record_batch, release, slices

WINDOW = 1024
END_ID = 0
# Units per shard: bounds the memory of a shard and the length of its postings.
SHARD_UNITS = 512
K1, B = 1.2, 0.75
# Where workers keep no words: bytes of text encoded at a time, and words kept within a task.
FEW_BYTES = 2 << 20
FEW_WORDS = 200_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Bm25:
    """Inverted index of one shard. Terms in half of the units or more have no weight
    (the idf of Robertson and Spärck Jones, not below zero)."""

    def __init__(self, units: list[np.ndarray]):
        self.n = n = len(units)
        lengths = np.array([len(u) for u in units], np.float64)
        tokens = np.concatenate(units).astype(np.int64)
        pairs, tf = np.unique(tokens * n + np.repeat(np.arange(n), lengths.astype(np.int64)), return_counts=True)
        token, unit = np.divmod(pairs, n)
        begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.diff(np.r_[begins, len(token)])
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit] / lengths.mean()))
        weight *= np.repeat(idf, df)
        kept = np.repeat(idf > 0, df)
        self.unit, self.weight = unit[kept], weight[kept]
        self.df = df[idf > 0]
        self.begin = np.cumsum(self.df) - self.df
        # The terms of each unit, as numbers of posting lists.
        lists = np.repeat(np.arange(len(self.df)), self.df)
        order = np.argsort(self.unit, kind="stable")
        self.terms = lists[order]
        self.term_bounds = np.r_[0, np.cumsum(np.bincount(self.unit, minlength=n))]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused units by falling score, ties and units without a common term in order."""
        terms = self.terms[self.term_bounds[seed] : self.term_bounds[seed + 1]]
        df = self.df[terms]
        after = np.cumsum(df)
        places = np.repeat(self.begin[terms] - after + df, df) + np.arange(after[-1] if len(after) else 0)
        scores = np.bincount(self.unit[places], self.weight[places], minlength=self.n)
        candidates = np.flatnonzero(unused)
        return candidates[np.argsort(-scores[candidates], kind="stable")]


class Packer:
    """Packs the documents of one task; rows of pieces come out by shard."""

    def __init__(self, window: int, task: int):
        self.window = window
        self.next_sequence = task << 36
        self.rows: list[tuple] = []
        self.units: list[tuple[int | None, int, int, np.ndarray]] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        """One sequence of ``(doc_id, start, doc_tokens, ids)``."""
        offset = 0
        for doc_id, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._sequence([(doc_id, start, total, ids[start : start + self.window])])
        if whole < total:
            self.units.append((doc_id, whole, total, ids[whole:]))
        if len(self.units) >= SHARD_UNITS:
            self.shard()

    def shard(self) -> None:
        """Pack all units that wait."""
        units, self.units = self.units, []
        if not units:
            return
        index = Bm25([u[3] for u in units])
        taken = np.zeros(len(units), np.int64)
        unused = np.ones(len(units), bool)

        def take(unit: int, room: int) -> tuple:
            doc_id, start, total, ids = units[unit]
            at = taken[unit]
            piece = ids[at : at + room]
            taken[unit] += len(piece)
            unused[unit] = taken[unit] < len(ids)
            return doc_id, start + int(at), total, piece

        for seed in range(len(units)):
            if not unused[seed]:
                continue
            pieces = [take(seed, self.window)]
            room = self.window - len(pieces[0][3])
            for unit in index.neighbours(seed, unused) if room else ():
                pieces.append(take(unit, room))
                room -= len(pieces[-1][3])
                if not room:
                    break
            if room:
                self._powers_of_two(pieces, self.window - room)
            else:
                self._sequence(pieces)

    def _powers_of_two(self, pieces: list[tuple], total: int) -> None:
        while total:
            length = room = 1 << (total.bit_length() - 1)
            part = []
            while room:
                doc_id, start, tokens, ids = pieces[0]
                part.append((doc_id, start, tokens, ids[:room]))
                rest = ids[room:]
                room -= len(part[-1][3])
                pieces = [(doc_id, start + len(part[-1][3]), tokens, rest), *pieces[1:]] if len(rest) else pieces[1:]
            self._sequence(part)
            total -= length


def frugal(batches: Iterator[pa.RecordBatch], encoder: bpe.Encoder) -> Iterator[pa.RecordBatch]:
    """Slices for a worker that shares its memory with other stages: small ones, fewer words kept,
    and what is freed goes back after each."""
    for batch in slices(batches, size=FEW_BYTES):
        if len(encoder.known) > FEW_WORDS:
            encoder.known.clear()
        yield batch
        del batch
        release()
    encoder.known.clear()


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences of at most ``window`` ids.

    A document is its text's ids and the end id 0; a null or empty text is that id alone.
    Every id lies in one piece. Returns per piece ``doc_id, start`` (ids of the document
    before it) ``, length, ids_crc32`` (unsigned, of the ids as little-endian 32-bit
    integers) ``, doc_tokens, sequence_id, offset`` (in the sequence, gapless). All sequences
    have ``window`` ids or a power of two, so none needs padding if ``window`` is one.
    ``with_ids`` adds the ids themselves. Without ``keep_words`` a worker takes smaller portions and
    forgets after each task the words it has learnt: other stages run in the same workers, and
    what it holds is memory they lack.

    Repeated rows are packed each, a null ``doc_id`` stays null, other columns are not looked
    at, an empty table gives no rows.
    """
    path = vocabulary or bpe.default_vocabulary()
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = (PackerWithIds if with_ids else Packer)(window, TaskContext.get().partitionId())
        encoder = bpe.encoder(path)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            told = {n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}
            return record_batch(**told, **({"ids": pa.array(columns[-1], pa.list_(pa.int64()))} if with_ids else {}))

        for batch in slices(batches) if keep_words else frugal(batches, encoder):
            ids, lengths = encoder.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, END_ID).astype(np.uint32)
            ends += np.arange(1, len(ends) + 1)
            for doc_id, end, length in zip(batch.column("doc_id").to_pylist(), ends.tolist(), lengths.tolist()):
                packer.add(doc_id, ids[end - length - 1 : end].copy())
            if packer.rows:
                yield out()
        release()
        packer.shard()
        if packer.rows:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))


class PackerWithIds(Packer):
    """A packer whose rows carry the ids of their piece."""

    def _sequence(self, pieces: list[tuple]) -> None:
        first = len(self.rows)
        super()._sequence(pieces)
        self.rows[first:] = [(*row, piece[3].astype(np.int64)) for row, piece in zip(self.rows[first:], pieces)]
