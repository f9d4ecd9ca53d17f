"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven beforehand
(``bpe.whole_tokens``). A pre-token that is such a string counts one; only the others are
merged. The count equals the library's ``encode(text, add_special_tokens=False)``, special
tokens' texts inside a text included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.llm.batches import record_batch, slices

MAX_TOKENS = 1024


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give a row each, a null
    ``doc_id`` stays null, other columns are not looked at, an empty table gives no rows.
    ``limit`` only sets the flag; whole texts are counted. No shuffle.
    """
    path = vocabulary or bpe.default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.counter(path)
        for batch in slices(batches):
            n_tokens = counter.count(batch.column("text"))
            yield record_batch(
                doc_id=batch.column("doc_id"),
                n_bytes=pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64()),
                n_tokens=n_tokens,
                over_limit=n_tokens > limit,
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
