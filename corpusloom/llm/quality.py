"""Quality rules: plain rules on words and lines, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials are counted
over them: the raw corpus, from every document, and the trusted target, from documents
labelled good. A document's score is the sum of ``log p_target - log p_raw`` over its n-grams,
divided by their number. It is kept where the score reaches a threshold; there is no
sampling, so the same document always gets the same verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import grams, mix, record_batch, slices, starts_of_grams, word_hashes, words
from corpusloom.session import new_path, stored, write_once

BUCKET_BITS = 16
MIN_WORDS = 50
# One in so many of the trusted documents is left out of the target model; their scores
# set the threshold: so many times the distance between this low share of them and their
# median, below the median.
CALIBRATION = 4
LOW_SHARE = 0.02
SLACK = 3.0
# Bins of the scores in which the threshold is looked for, in one unit of score.
BINS = 1 << 14

_SYMBOLS = r"[#*$%&|<>]"
_BLANK = r"[\x{20}\x{09}-\x{0d}]"


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, and which row each belongs to."""
    coded, bounds = words(batch.column("text"))
    hashes = word_hashes(coded)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = starts_of_grams(bounds, 2)
    buckets = np.concatenate([mix(hashes), grams(hashes, 2)[pairs]]) >> np.uint64(64 - BUCKET_BITS)
    return buckets.astype(np.int64), np.concatenate([row, row[pairs]])


def _sum_by(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n)


def base_metrics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    n = len(text)
    coded, bounds = words(text)
    starts = starts_of_grams(bounds, 3)
    row = np.repeat(np.arange(n), np.diff(bounds))
    codes = mix(coded.indices.to_numpy().astype(np.uint64))
    windows = mix(grams(codes, 3)[starts] + row[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1]
    repeated = np.zeros(len(coded), bool)
    for i in range(3):
        repeated[again + i] = True
    lists = pc.split_pattern(text, "\n")
    lines = lists.flatten()
    line_row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    full = pc.match_substring_regex(lines, r"[^\x{20}\x{09}-\x{0d}]").to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    line_row = line_row[full]
    different = np.unique(line_row * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1)
    return {
        "n_words": np.diff(bounds),
        "word_chars": (pc.utf8_length(text).to_numpy() - pc.count_substring_regex(text, _BLANK).to_numpy()).astype(np.int64),
        "n_symbols": pc.count_substring_regex(text, _SYMBOLS).to_numpy().astype(np.int64),
        "n_dup_lines": _sum_by(line_row, n) - _sum_by(different, n),
        "n_repeat_words": _sum_by(row[repeated], n),
    }


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of all documents of quality 1."""
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long")).dropna().distinct()


def fit(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, float]:
    """The log-ratio of each bucket and the threshold.

    Both models count every document they are of. ``trusted(doc_id)`` grows with the corpus, so it is
    not broadcast: texts move to their ids. A hash of the id says which documents set the threshold, so
    these move in a pass of their own and the others in the first; a pass's shuffle files go with it.
    What comes to the driver is two counts per bucket and counts of scores.
    """
    spark = docs.sparkSession
    trusted = stored(trusted, "trusted-documents").hint("merge")
    spared = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATION)) == 0
    apart = F.col("doc_id").isNull() | spared
    alone = docs.filter(apart).select("text", F.lit(False).alias("trusted"))
    met = docs.filter(~apart).join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
    marked = alone.union(met.select("text", F.coalesce("trusted", F.lit(False))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in slices(batches):
            buckets, rows = _features(batch)
            raw += np.bincount(buckets, minlength=size)
            mine = batch.column("trusted").to_numpy(zero_copy_only=False)[rows]
            target += np.bincount(buckets[mine], minlength=size)
        seen = np.flatnonzero(raw)
        yield record_batch(bucket=seen.astype(np.int32), raw=raw[seen], target=target[seen])

    counts = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket")
    counts = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = write_once(counts, new_path(spark, "bucket-counts")).toPandas()
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    raw[table["bucket"]], target[table["bucket"]] = table["raw"], table["target"]
    if not target.sum():
        return np.zeros(len(raw)), 0.0
    # Add-one smoothing in proportion to the raw model, so buckets the target has not seen
    # are judged by how much of the target there is.
    p_raw = (raw + 1) / (raw + 1).sum()
    p_target = (target + 1) / (target + 1).sum()
    ratio = np.log(p_target) - np.log(p_raw)
    known = docs.filter(spared).join(trusted, "doc_id", "left_semi").select("text")
    known = known.mapInArrow(_scorer(ratio), "score double")
    low, middle = _quantiles(write_once(known, new_path(spark, "spared-scores")), LOW_SHARE, 0.5)
    return ratio, float(middle - SLACK * (middle - low))


def _quantiles(scores: DataFrame, *shares: float) -> list[float]:
    """The exact values of ``scores(score)``, a stored table, at these shares; 0 if it is empty.

    Bins are counted first, then the values of the one bin that a share lies in.
    """
    binned = scores.withColumn("bin", F.floor(F.col("score") * BINS))
    bins = binned.groupBy("bin").count().toPandas().sort_values("bin")
    ends, found = bins["count"].cumsum().to_numpy(), []
    for share in shares if len(ends) else ():
        rank = max(1, math.ceil(share * int(ends[-1])))
        at = int(np.searchsorted(ends, rank))
        values = binned.filter(F.col("bin") == int(bins["bin"].iloc[at])).groupBy("score").count().toPandas().sort_values("score")
        before = int(ends[at - 1]) if at else 0
        found.append(float(values["score"].iloc[int(np.searchsorted(values["count"].cumsum(), rank - before))]))
    return found or [0.0] * len(shares)


def _scores(batch: pa.RecordBatch, ratio: np.ndarray) -> np.ndarray:
    buckets, rows = _features(batch)
    n = batch.num_rows
    return _sum_by(rows, n, ratio[buckets]) / np.maximum(1, _sum_by(rows, n))


def _scorer(ratio: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record_batch(score=_scores(batch, ratio))

    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``.

    ``doc_id, n_words, word_chars`` (code points in words) ``, n_symbols, n_dup_lines``
    (non-blank lines equal to an earlier one) ``, n_repeat_words`` (words in three-word windows
    found twice or more in the text) ``, base_failed, kept, score``. ``base_failed``: fewer than
    50 words, or more than half of them repeated. ``kept``: not ``base_failed`` and a score of at
    least the threshold.

    A null or empty text has no words and fails. Without a trusted document every score is
    0 and only the base rules decide. Repeated rows are judged each (and counted each); a
    null ``doc_id`` stays null and is never trusted; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio, threshold = fit(rows, trusted_documents(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = base_metrics(batch)
            failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            score = _scores(batch, ratio)
            yield record_batch(
                doc_id=batch.column("doc_id"),
                **found,
                base_failed=failed,
                kept=~failed & (score >= threshold),
                score=score,
            )

    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, score double",
    )
