"""Token files in patched frame-of-reference blocks.

Ids are cut into blocks of ``BLOCK`` values. A block stores its minimum, a bit width chosen so
that at least ``PERCENTILE`` percent of its values fit after the minimum is taken off, the
packed differences, and the values that do not fit as a list of exceptions (place, value).
A file is

    magic | segments | footer | length of the footer (8 bytes) | magic

A segment holds up to ``SEGMENT`` blocks: packed 64-bit words of all of them, then the places
(1 byte) and the values (4 bytes) of their exceptions. The footer indexes every block (where
its words start, minimum, width, number of exceptions) and every document (id, number of
ids), so any block or document is read without the ones before it. All numbers are
little-endian.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.llm.batches import record_batch, release, slices

BLOCK = 256
PERCENTILE = 90
SEGMENT = 4096
MAGIC = b"PFORIDS1"
END_ID = 2
# Bytes of text per file, and of text encoded at a time.
FILE_BYTES = 32 << 20
SLICE_BYTES = 4 << 20

_WORDS_PER_BIT = BLOCK // 64


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``2 ** width`` as rows of 64-bit words, lowest bits first."""
    columns = np.ascontiguousarray(values.reshape(-1, 64).T, dtype=np.uint64)
    words = np.zeros((width, columns.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return words.T.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return out.T.reshape(rows, BLOCK)


class Writer:
    """Writes one file; ids come in any portions."""

    def __init__(self, sink):
        self.sink = sink
        self.sink.write(MAGIC)
        self.at = len(MAGIC)
        self.rest = np.empty(0, np.uint32)
        self.index: dict[str, list[np.ndarray]] = {k: [] for k in ("starts", "minima", "widths", "exceptions")}
        self.segments: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.doc_lengths: list[int] = []
        self.n_ids = 0

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.doc_lengths += lengths.tolist()
        self.n_ids += len(ids)
        pending = np.concatenate([self.rest, ids.astype(np.uint32)])
        step = SEGMENT * BLOCK
        while len(pending) >= step:
            self._segment(pending[:step])
            pending = pending[step:]
        self.rest = pending

    def _segment(self, ids: np.ndarray) -> None:
        short = -len(ids) % BLOCK
        values = np.concatenate([ids, np.repeat(ids[-1:], short)]).reshape(-1, BLOCK)
        minima = values.min(axis=1)
        rest = values - minima[:, None]
        bits = _bit_lengths(rest)
        place = -(-BLOCK * PERCENTILE // 100) - 1
        widths = np.partition(bits, place, axis=1)[:, place]
        outside = bits > widths[:, None]
        rows, places = np.nonzero(outside)
        packed_at = np.r_[0, np.cumsum(widths.astype(np.int64) * _WORDS_PER_BIT)]
        words = np.zeros(packed_at[-1], np.uint64)
        for width in np.unique(widths):
            if width:
                mine = np.flatnonzero(widths == width)
                low = rest[mine].astype(np.uint64) & np.uint64((1 << int(width)) - 1)
                span = np.arange(int(width) * _WORDS_PER_BIT)
                words[packed_at[mine][:, None] + span] = _pack(low, int(width))
        self.segments.append((sum(map(len, self.index["starts"])), len(values), self.at))
        self.index["starts"].append(self.at + packed_at[:-1] * 8)
        self.index["minima"].append(minima)
        self.index["widths"].append(widths)
        self.index["exceptions"].append(outside.sum(axis=1).astype(np.uint16))
        for part in (words.astype("<u8"), places.astype(np.uint8), rest[rows, places].astype("<u4")):
            data = part.tobytes()
            self.sink.write(data)
            self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._segment(self.rest)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        arrays = {
            "starts": (self.index["starts"], "<i8"),
            "minima": (self.index["minima"], "<u4"),
            "widths": (self.index["widths"], "<u1"),
            "exceptions": (self.index["exceptions"], "<u2"),
            "segments": ([np.array(self.segments).reshape(-1, 3)], "<i8"),
            "doc_ids": ([np.array([d or 0 for d in self.doc_ids])], "<i8"),
            "doc_known": ([known], "<u1"),
            "doc_lengths": ([np.array(self.doc_lengths)], "<i8"),
        }
        told, body = {"n_ids": self.n_ids, "block": BLOCK, "arrays": {}}, io.BytesIO()
        for name, (parts, kind) in arrays.items():
            data = np.concatenate(parts).astype(kind).tobytes() if parts else b""
            told["arrays"][name] = (kind, body.tell(), len(data))
            body.write(data)
        head = json.dumps(told).encode()
        footer = len(head).to_bytes(8, "little") + head + body.getvalue()
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class Reader:
    """Reads one file: all of it, or single documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        length = int.from_bytes(tail[:8], "little")
        footer = source.read_at(length, size - 16 - length)
        head = int.from_bytes(footer[:8], "little")
        told = json.loads(footer[8 : 8 + head])
        body = footer[8 + head :]
        self.n_ids = told["n_ids"]
        for name, (kind, start, size) in told["arrays"].items():
            setattr(self, name, np.frombuffer(body, kind, size // np.dtype(kind).itemsize, start))
        self.segments = self.segments.reshape(-1, 3)
        self.doc_starts = np.r_[0, np.cumsum(self.doc_lengths)]

    def _words(self, first: int, n: int, start: int) -> tuple[np.ndarray, int]:
        n_words = self.widths[first : first + n].astype(np.int64).sum() * _WORDS_PER_BIT
        return np.frombuffer(self.source.read_at(int(n_words) * 8, start), "<u8"), int(n_words)

    def _blocks(self, segment: int, low: int, high: int) -> np.ndarray:
        """Values of the blocks ``low`` to ``high`` (counted in the file) of one segment."""
        first, n, start = map(int, self.segments[segment])
        words, _ = self._words(low, high - low, int(self.starts[low]))
        widths = self.widths[low:high]
        packed_at = np.r_[0, np.cumsum(widths.astype(np.int64) * _WORDS_PER_BIT)]
        out = np.zeros((high - low, BLOCK), np.uint64)
        for width in np.unique(widths):
            if width:
                mine = np.flatnonzero(widths == width)
                span = np.arange(int(width) * _WORDS_PER_BIT)
                out[mine] = _unpack(words[packed_at[mine][:, None] + span], int(width))
        counts = self.exceptions[first : first + n].astype(np.int64)
        lists_at = start + int(self.widths[first : first + n].astype(np.int64).sum()) * _WORDS_PER_BIT * 8
        skip, take = int(counts[: low - first].sum()), counts[low - first : high - first]
        if take.sum():
            places = np.frombuffer(self.source.read_at(int(take.sum()), lists_at + skip), np.uint8)
            values = np.frombuffer(self.source.read_at(int(take.sum()) * 4, lists_at + int(counts.sum()) + skip * 4), "<u4")
            out[np.repeat(np.arange(high - low), take), places] = values
        return (out + self.minima[low:high, None]).astype(np.uint32).ravel()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from place ``start`` to ``end`` of the file; only their blocks are read."""
        parts, low, last = [], start // BLOCK, -(-end // BLOCK)
        if end <= start:
            return np.empty(0, np.uint32)
        begin = low * BLOCK
        while low < last:
            segment = int(np.searchsorted(self.segments[:, 0], low, side="right")) - 1
            high = min(last, int(self.segments[segment, 0] + self.segments[segment, 1]))
            parts.append(self._blocks(segment, low, high))
            low = high
        return np.concatenate(parts)[start - begin : end - begin]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[number]), int(self.doc_starts[number + 1]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and ids of every document, a segment's ids in memory at a time."""
        step = SEGMENT * BLOCK
        held, begin, read = np.empty(0, np.uint32), 0, 0
        for number in range(len(self.doc_lengths)):
            start, end = int(self.doc_starts[number]), int(self.doc_starts[number + 1])
            if read < end:
                parts = [held[start - begin :]]
                while read < end:
                    upto = min(self.n_ids, read + step)
                    parts.append(self.ids(read, upto))
                    read = upto
                held, begin = np.concatenate(parts), start
            yield number, held[start - begin : end - begin]


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


MANIFEST = "part int, file string, n_docs long, n_ids long"


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids below ``folder`` in ascending ``doc_id`` order.

    Each document's ids end with ``end_id``; a null or empty text is that id alone. A null
    ``doc_id`` comes first; rows that repeat one follow each other, by text; an empty table
    gives no file. ``folder`` must be shared by all executors. A task that is run again
    writes a file of another name; the manifest, written last, names the files that count.

    Returns the manifest: ``part, file, n_docs, n_ids``, files in the order of ``part``.
    """
    spark = docs.sparkSession
    path = vocabulary or bpe.default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_files = 1 + n_bytes // file_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, name, n_docs = TaskContext.get().partitionId(), None, "", 0
        encoder = bpe.encoder(path)
        for batch in slices(batches, size=SLICE_BYTES):
            if writer is None:
                files, root = _file_system(folder)
                files.create_dir(root, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.pfor"
                writer = Writer(files.open_output_stream(f"{root}/{name}"))
            ids, lengths = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            writer.add(batch.column("doc_id").to_pylist(), lengths + 1, ids)
            n_docs += batch.num_rows
        release()
        if writer:
            writer.close()
            yield record_batch(part=pa.array([part], pa.int32()), file=[name], n_docs=[n_docs], n_ids=[writer.n_ids])

    ordered = rows.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _placed(manifest: DataFrame) -> DataFrame:
    """Files with ``base``, the ids of all files before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Documents read back from the files of ``folder``.

    ``doc_id, start`` (ids of all documents before it) ``, n_tokens`` (with the end id) and
    ``ids``, or with ``digest`` instead of them ``ids_crc32``: the unsigned CRC-32 of the ids
    as little-endian 32-bit integers.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_files = max(1, manifest.count())
    last = "ids_crc32 long" if digest else "ids array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{row['file']}") as source:
                    yield from _told(Reader(source), row["base"], digest)

    placed = _placed(manifest).repartition(n_files, "file")
    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")


def _told(reader: Reader, base: int, digest: bool) -> Iterator[pa.RecordBatch]:
    ids: list = []
    first = held = 0

    def out(upto: int) -> pa.RecordBatch:
        known = reader.doc_known[first:upto] == 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[first:upto], mask=known),
                pa.array(reader.doc_starts[first:upto] + base),
                pa.array(reader.doc_lengths[first:upto]),
                pa.array(ids, pa.int64() if digest else pa.list_(pa.int64())),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
        )

    for number, found in reader.documents():
        ids.append(zlib.crc32(found.astype("<u4").tobytes()) if digest else found.astype(np.int64))
        held += 1 if digest else len(found)
        if held >= 1 << 20:
            yield out(number + 1)
            first, held, ids = number + 1, 0, []
    if ids:
        yield out(len(reader.doc_lengths))
