"""Token counts, token files and packing against the library itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, packing, token_counts, token_files
from tests.llm.fixtures import by_id, clashing, documents, empty, table

PATH = bpe.default_vocabulary()
PIECES = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", "'s", "'ll", ",", "!!", "<|endoftext|>", "<|", "hello", "\r\n", "漢字", "😀", "\x1c", "\x85", "\xa0", "_"]


def library(text: str | None) -> list[int]:
    return bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=20))
def test_ids_and_counts_are_the_library_s(texts):
    ids, lengths = bpe.encoder(PATH).encode(pa.array(texts))
    got = [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [library(t) for t in texts]
    assert bpe.counter(PATH).count(pa.array(texts)).tolist() == [len(g) for g in got]


def test_whole_tokens_are_proven():
    whole = bpe.whole_tokens(PATH)
    assert len(whole) > 40_000
    for piece in list(whole)[::997]:
        assert library(piece) == [whole[piece]]


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    encoder = bpe.Encoder(PATH)
    for text in ("one two three four", "five six", "one two three four"):
        assert encoder.encode(pa.array([text]))[0].tolist() == library(text)


def test_counts(spark):
    rows = documents()
    want = sorted(((d, len((t or "").encode()), n := len(library(t)), n > 20) for d, t, *_ in rows), key=repr)
    got = token_counts.token_counts(clashing(table(spark, rows)), limit=20)
    assert by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def expected_files(rows) -> list[tuple]:
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(text), 2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [1, 1 << 30])
def test_token_files(spark, tmp_path, file_bytes):
    rows = documents() + documents()[:5]
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(clashing(table(spark, rows)), folder, file_bytes=file_bytes)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    back = token_files.read_token_files(spark, folder, digest=True)
    assert by_id(back, "doc_id", "start", "n_tokens", "ids_crc32") == expected_files(rows)
    ids = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, folder).collect()}
    assert ids[1003] == [*library(rows[123][1]), 2] and ids[1000] == [2]


def test_empty_token_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write_token_files(empty(spark), folder).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


@settings(max_examples=40, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from([1, 2, 300, 50_257, 2**32 - 1]), st.integers(0, 3_000), st.integers(0, 2**31)),
        min_size=1,
        max_size=12,
    )
)
def test_blocks_round_trip(shapes):
    docs = [np.random.default_rng(seed).integers(0, top, n).astype(np.uint32) for top, n, seed in shapes]

    class Sink(list):
        write = list.append

        def close(self):
            pass

    sink = Sink()
    writer = token_files.Writer(sink)
    for number, doc in enumerate(docs):
        writer.add([number], np.array([len(doc)]), doc)
    writer.close()
    reader = token_files.Reader(pa.BufferReader(b"".join(sink)))
    for (number, got), want in zip(reader.documents(), docs, strict=True):
        assert got.tolist() == want.tolist() == reader.document(number).tolist()


def check_pieces(rows: list[tuple], pieces: list, window: int) -> None:
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert len(docs) == len(rows)
    for doc_id, text, *_ in rows:
        ids, at = [*library(text), 0], 0
        for p in sorted(docs[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids"] == ids[p["start"] : at] and p["ids_crc32"] == crc(p["ids"])
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window and at & (at - 1) == 0


@pytest.mark.parametrize(("window", "units"), [(1024, 512), (64, 7)])
def test_packing(spark, monkeypatch, window, units):
    monkeypatch.setattr(packing, "SHARD_UNITS", units)
    rows = documents()
    pieces = packing.pack(clashing(table(spark, rows)), window=window, with_ids=True).collect()
    check_pieces(rows, pieces, window)


def test_packing_takes_the_nearest_first():
    near, far = np.arange(100, 130), np.arange(500, 530)
    filler = [np.arange(1000 + 40 * i, 1030 + 40 * i) for i in range(6)]
    units = [near, *filler, far, near[5:]]
    index = packing.Bm25([u.astype(np.uint32) for u in units])
    unused = np.ones(len(units), bool)
    unused[0] = False
    assert index.neighbours(0, unused)[0] == len(units) - 1


def test_packing_nothing(spark):
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), window=1000)


def test_a_word_is_merged_once_whatever_marks_it_has():
    encoder, merged = bpe.Encoder(PATH), []
    merge = encoder.merge
    encoder.merge = lambda letters: merged.append(letters) or merge(letters)
    text = "first zyxwvqk zyxwvqk, zyxwvqk.\nzyxwvqk (zyxwvqk) zyxwvqk; 2zyxwvqk zyxwvqk's\nZyxwvqk \xe9zyxwvqk"
    for _ in range(2):
        assert encoder.encode(pa.array([text]))[0].tolist() == library(text)
    assert len(merged) == len(set(merged))
    assert all(key.lstrip(" ").isalpha() for key in encoder.known)
