"""Language identification with string kernels.

The kernel of two texts is the blended spectrum: how many different character n-grams of
length 2 to 4 (lower-cased, hashed to ``BUCKETS``) they share, cosine-normalised. A Nyström map
over landmark texts of all languages makes it finite, one-versus-rest kernel ridge
regression is fitted on the mapped training texts, and whole blocks of documents are scored
by one matrix product: presence matrix times (landmark presences times the fitted weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import mix, record_batch, release, slices
from corpusloom.session import stored

LENGTHS = (2, 3, 4)
BUCKETS = 1 << 15
# Bounds on the sample of labelled rows the classifier is fitted on: the first rows of each
# language in hash order, evenly over the languages. The landmarks are the first of them.
TRAINING_ROWS = 2_000
LANDMARKS = 240
RIDGE = 1e-3
UNKNOWN = "und"
# ``accepted`` turns documents away whose best language scores below this.
LEAST_SCORE = 0.05

_BLOCK = 128
# Places of the hash order, and how many times the wanted ids are looked at.
_PLACES = 1 << 30
_SPARE = 4


def held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """The different n-gram buckets of each text, ascending."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    seen = np.zeros(BUCKETS, bool)
    for text in lowered.to_pylist():
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        rolled = points
        seen[:] = False
        for n in range(2, max(LENGTHS) + 1):
            if len(points) < n:
                break
            rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
            if n in LENGTHS:
                seen[mix(rolled) >> np.uint64(64 - 15)] = True
        yield np.flatnonzero(seen)


def _rows(presences: list[np.ndarray]) -> np.ndarray:
    matrix = np.zeros((len(presences), BUCKETS), np.float32)
    for row, found in zip(matrix, presences):
        row[found] = 1
    return matrix


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages

    def scores(self, presences: list[np.ndarray]) -> np.ndarray:
        """Regression values, a row per text."""
        out = np.zeros((len(presences), len(self.languages)), np.float32)
        for i in range(0, len(presences), _BLOCK):
            part = presences[i : i + _BLOCK]
            norms = np.sqrt(np.maximum(1, [len(p) for p in part]))
            out[i : i + _BLOCK] = (_rows(part) @ self.weights) / norms[:, None]
        return out


def solve(presences: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström map over the first ``landmarks`` texts and ridge regression on all of them."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    norms = np.sqrt(np.maximum(1, np.array([len(p) for p in presences], np.float64)))
    marks = _rows(presences[:landmarks]) / norms[:landmarks, None].astype(np.float32)
    to_marks = np.concatenate(
        [_rows(presences[i : i + _BLOCK]) @ marks.T for i in range(0, len(presences), _BLOCK)]
    ) / norms[:, None]
    among = to_marks[: len(marks)].astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = to_marks @ root
    target = (np.array(labels)[:, None] == np.array(languages)).astype(np.float64)
    gram = mapped.T @ mapped + ridge * len(labels) * np.eye(mapped.shape[1])
    fitted = np.linalg.solve(gram, mapped.T @ target)
    return Model(languages, (marks.T @ (root @ fitted).astype(np.float32)).astype(np.float32))


def training_sample(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` rows that may be learnt from: ``doc_id, text, lang, turn``."""
    allowed = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES))
    # The ids of a language are cut by a bound on their order, worked out from their number, so
    # that no task sorts a language; the bound leaves several times the ids that are wanted.
    counts = stored(allowed.groupBy("lang").count(), "language-counts")
    bound = F.greatest(F.lit(1.0), F.lit(float(_SPARE * rows)) * _PLACES / F.col("count"))
    keys = allowed.select("doc_id", "lang", order.alias("order")).join(counts, "lang").filter(F.col("order") < bound)
    keys = keys.select("doc_id", "lang", "order").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = keys.withColumn("turn", turn).filter(F.col("turn") <= rows)
    chosen = chosen.orderBy("turn", "order", "doc_id").limit(rows).select("doc_id", "lang", "turn")
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])
    # Of rows that repeat an id one is learnt from.
    return found.groupBy("doc_id", "lang", "turn").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on the sample. Only presences of its texts, bounded in number and length, come to
    the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [p.astype(np.uint16).tobytes() for p in _presence(batch.column("text"))]
            yield record_batch(turn=batch.column("turn"), lang=batch.column("lang"), doc_id=batch.column("doc_id"), found=found)

    sample = training_sample(docs, rows)
    found = sample.mapInArrow(features, "turn int, lang string, doc_id long, found binary").collect()
    found.sort(key=lambda r: (r["turn"], r["lang"], r["doc_id"], bytes(r["found"])))
    return solve([np.frombuffer(bytes(r["found"]), np.uint16).astype(np.int64) for r in found], [r["lang"] for r in found])


def _best(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The language of each text and its score."""
    known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, best = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
    if model.languages and known.any():
        values = model.scores(list(_presence(text.filter(pa.array(known)))))
        names[known] = np.array(model.languages, object)[values.argmax(axis=1)]
        best[known] = np.clip(values.max(axis=1), 0, 1)
    return names, best


def predict(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The language of every row of ``docs(doc_id, text, lang)``: ``doc_id, held_out, lang_pred, score``.

    Learns from text and non-null ``lang`` of rows whose id is not held out (``held_out``); a
    prediction looks at the text alone. ``lang_pred`` is a learnt language, ``und`` for a text
    that is null or has no letter, or where nothing could be learnt, with score 0. ``score``
    is the winning regression value, cut to 0 to 1; ties go to the first language by name.
    Repeated rows are predicted each; a null ``doc_id`` stays null, is not held out and not learnt from.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    model = fit(rows, training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, best = _best(model, batch.column("text"))
            yield record_batch(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=names, score=best)

    marked = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return marked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST_SCORE, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the rows no language is found for, or none with a score of ``least``. All
    columns stay as they are. Rows are judged in place, without a join; only texts reach the
    Python workers."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    model = fit(rows, training_rows)

    @F.arrow_udf("boolean")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            told = [np.zeros(0, bool)]
            for batch in slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
                names, best = _best(model, batch.column("text"))
                told.append((names != UNKNOWN) & (best >= least))
            yield pa.array(np.concatenate(told))
        release()

    return docs.filter(good(F.col("text").cast("string")))
