"""What a packing worker holds after its task."""

from __future__ import annotations

import shutil

import pyarrow as pa
import pytest

from corpusloom.llm import bpe, packing


@pytest.mark.parametrize("keep_words", [True, False])
def test_words_are_forgotten_when_asked(spark, tmp_path, keep_words):
    """A vocabulary file of its own, so no other test's words count."""
    path = str(shutil.copy(bpe.default_vocabulary(), tmp_path / f"vocabulary-{keep_words}.json"))
    docs = spark.createDataFrame([(i, f"unheard{i}of wordlike{i}things") for i in range(32)], "doc_id long, text string")
    assert packing.pack(docs.repartition(8), path, keep_words=keep_words).agg({"length": "sum"}).first()[0] > 32

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.encoder(path).known)] * batch.num_rows)], names=["n"])

    most = spark.range(0, 8, 1, 8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0]
    assert (most > 0) == keep_words


def test_small_portions_where_words_are_not_kept():
    class Learning:
        known: dict = {}

    batches = [pa.record_batch({"text": [f"{i:07d}" * 30_000 for i in range(40)]}) for _ in range(2)]
    texts, most = [], 0
    for n, batch in enumerate(packing.frugal(iter(batches), Learning)):
        assert sum(map(len, batch["text"].to_pylist())) < packing.FEW_BYTES + 210_000
        texts += batch["text"].to_pylist()
        most = max(most, len(Learning.known))
        Learning.known |= {(n, i): b"" for i in range(packing.FEW_WORDS // 2 + 1)}
    assert texts == [t for b in batches for t in b["text"].to_pylist()]
    assert 0 < most <= packing.FEW_WORDS and not Learning.known
