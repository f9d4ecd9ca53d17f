"""Where a caller's own model, embedding or tokenizer plugs in.

Each hook takes a ``load`` function without arguments that returns the callable to
use. It runs once per task, not per row or batch, so a model is loaded where it is
used. No model ships with this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Count = Callable[[str], int]
Extract = Callable[[pd.DataFrame], pd.DataFrame]


def embed(text: Column, load: Callable[[], Embed]) -> Column:
    """``ARRAY<FLOAT>`` of each text; the callable gets a whole Arrow batch of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(list(texts))])

    return run(text)


def count_tokens(text: Column, load: Callable[[], Count]) -> Column:
    """Exact token counts by the caller's tokenizer."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield texts.map(count).astype("int64")

    return run(text)


def map_batches(df: DataFrame, load: Callable[[], Extract], schema: str) -> DataFrame:
    """Rows made from rows by a caller's model, batch by batch: extracting entities and
    relations from chunks, or writing an answer for each context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)
