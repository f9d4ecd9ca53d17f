"""Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of ``column``; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.take(pa.array(np.arange(start, end)))  # a copy: kernels misread some slices


def release() -> None:
    """Hand freed memory back to the system: workers stay, and an idle one should hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as an empty one."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def words(column: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none) as one dictionary-encoded array, and
    where each text's words begin, with the total at the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    filled = pc.not_equal(flat, "")
    kept = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
    return flat.filter(filled).dictionary_encode(), kept[offsets - offsets[0]]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(coded: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of each word."""
    hashes = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    return np.array(hashes, np.uint64)[coded.indices.to_numpy()]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` words, regardless of where texts end."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for i in range(1, n):
        out = out * _BASE + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def starts_of_grams(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places where a window of ``n`` words lies in one text, given where texts begin."""
    inside = np.ones(bounds[-1], bool)
    for i in range(1, n):
        inside[np.maximum(bounds[1:] - i, bounds[:-1])[bounds[1:] > bounds[:-1]]] = False
    return np.flatnonzero(inside)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
