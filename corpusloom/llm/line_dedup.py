"""Line deduplication over levelled sorted runs of line hashes.

A store keeps one row per line key it has ever seen, in sorted runs bucketed by hash. A new
batch of documents is reduced to its own run (key, number of documents, largest
document). That run is merge-anti-joined with all runs of the store: keys that were never
seen become a new run on level 0, keys that were seen go to the store's list of repeats.
When a level holds ``FANOUT`` runs they are compacted into one run of the next level, so a
store of n batches has about log n runs. All of it is DataFrame work; runs are bucketed
by the whole key and sorted, and a batch's run is stored the same way before it is compared,
so these joins exchange nothing, however many shuffle partitions the session has.

Keys are two independent 64-bit hashes of the stripped line with A-Z lower-cased.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import new_path

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 4
# Documents of a batch at most, besides the batches that any input is cut into.
BATCH_DOCS = 4_000_000
# Rows of a run per bucket.
BUCKET_ROWS = 4_000_000

_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased and other letters as they are."""
    bare = F.trim(line, F.lit(_BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _keys(text: Column, min_chars: int) -> Column:
    """Hashes of the different keys of a text that are long enough."""
    keys = F.transform(lines_of(text), line_key)
    kept = F.filter(keys, lambda key: F.char_length(key) >= min_chars)
    return F.array_distinct(F.transform(kept, _hashed))


def _doc_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("doc_id IS NOT NULL").select("doc_id", F.inline(_keys(F.col("text"), min_chars)))


def batch_runs(docs: DataFrame, batch: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """One run per value of ``batch`` (an expression over ``doc_id``): ``batch, h1, h2, n_docs, last_doc``.

    Copies of a line merge in the map task before the shuffle. Rows that repeat a ``doc_id``
    count as one document.
    """
    keys = _doc_keys(docs, min_chars).groupBy("doc_id", *_HASH).count() if _repeats_ids(docs) else _doc_keys(docs, min_chars)
    return keys.groupBy(batch.alias("batch"), *_HASH).agg(
        F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")
    )


def _repeats_ids(docs: DataFrame) -> bool:
    found = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).count().filter("count > 1").limit(1)
    return bool(found.count())


class LineStore:
    """Levelled runs of line hashes below a folder all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.folder = folder or new_path(spark, "line-store")
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self.buckets: int | None = None

    def _save(self, run: DataFrame, dealt: bool = False) -> str:
        """Write a run as a table of one file per bucket. What joins of the store's tables give is ``dealt``
        by bucket already and stays where it is; anything else moves once, straight to its bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        if not dealt:
            run = run.repartitionById(self.buckets, F.pmod(F.hash(*_HASH), F.lit(self.buckets)).cast("int"))
        (
            run.sortWithinPartitions(*_HASH)
            .write.bucketBy(self.buckets, *_HASH)
            .sortBy(*_HASH)
            .option("path", f"{self.folder}/{name}")
            .saveAsTable(name)
        )
        return name

    def _union(self, names: list[str]) -> DataFrame | None:
        runs = None
        for name in names:
            run = self.spark.table(name)
            runs = run if runs is None else runs.unionAll(run)
        return runs

    def runs(self) -> DataFrame | None:
        return self._union([name for level in self.levels for name in level])

    def add(self, run: DataFrame, rows: int) -> None:
        """Take in the run of one batch (``h1, h2, n_docs, last_doc``) of about ``rows`` rows."""
        if self.buckets is None:
            self.buckets = 8 + rows // BUCKET_ROWS
        arrived = self._save(run.select(*_HASH, "n_docs", "last_doc"))
        stored = [name for level in self.levels for name in level]
        if not stored:
            self._push(0, arrived)
            return
        run = fresh = self.spark.table(arrived)
        for name in stored:
            fresh = fresh.join(self.spark.table(name), _HASH, "left_anti")
        new = self._save(fresh, dealt=True)
        self.repeats.append(self._save(run.join(self.spark.table(new), _HASH, "left_anti"), dealt=True))
        self._drop([arrived])
        self._push(0, new)

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._save(self._union(self.levels[level]))
            self._drop(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys found in ``min_docs`` documents or more, with the largest document."""
        first, later = self.runs(), self._union(self.repeats)
        if first is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, last_doc long")
        if later is None:
            return first.filter(F.col("n_docs") >= min_docs).select(*_HASH, "last_doc")
        later = later.groupBy(*_HASH).agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later_doc"))
        joined = first.join(later, _HASH, "left")
        total = F.col("n_docs") + F.coalesce("more", F.lit(0))
        return joined.filter(total >= min_docs).select(*_HASH, F.greatest("last_doc", "later_doc").alias("last_doc"))

    def forget(self) -> None:
        """Take the store's tables out of the session catalog; the files stay."""
        self._drop([*self.repeats, *(name for level in self.levels for name in level)])


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of ``frequent`` keys left out, except in each key's ``last_doc``.

    Adds ``n_lines`` (before) and ``n_dropped``; other columns stay. Only the hashes of
    lines meet ``frequent``; texts move once, to meet what their document has to lose.
    """
    lost = (
        _doc_keys(docs, min_chars)
        .join(frequent, _HASH)
        .filter(F.col("doc_id") < F.col("last_doc"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct(*_HASH)).alias("lost"))
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # One struct keeps the columns of the input apart from those of the work.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*columns).alias("row"))
    joined = rows.join(lost, "doc_id", "left")
    lines = lines_of(F.col("row.text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains(F.col("lost"), _hashed(key))

    kept = F.when(F.col("lost").isNull(), lines).otherwise(F.filter(lines, stays))
    joined = joined.withColumn("lines", F.size(lines).cast("long")).withColumn("kept", kept)
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns],
        F.col("lines").alias("n_lines"),
        (F.col("lines") - F.size("kept")).alias("n_dropped"),
    )


def dedup_lines(
    docs: DataFrame,
    batches: int | None = None,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """All of ``docs`` through a fresh store, in ``batches`` batches, and the repeated lines left out.

    A line's key is the stripped line with A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose their lines in all documents
    but the one with the largest ``doc_id``. The result does not depend on ``batches``; by default there
    are more than ``FANOUT``, so runs are compacted and later batches meet runs of several levels, and
    one more for every ``BATCH_DOCS`` documents.

    A null or empty text is one empty line and keeps as it is; rows with a null ``doc_id``
    neither count nor lose lines; rows that repeat a ``doc_id`` are one document; other
    columns stay, but for ``n_lines`` and ``n_dropped``, which are set anew.
    """
    spark = docs.sparkSession
    staged = new_path(spark, "line-batches")
    if batches is None:
        batches = FANOUT + 2 + docs.count() // BATCH_DOCS
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    batch_runs(docs, batch, min_chars).write.partitionBy("batch").parquet(staged)
    runs = spark.read.schema("h1 long, h2 long, n_docs long, last_doc long, batch int").parquet(staged)
    rows = runs.count()
    store = LineStore(spark)
    for number in range(batches):
        store.add(runs.filter(F.col("batch") == number), rows)
    path = new_path(spark, "frequent-lines")
    store.frequent(min_docs).write.parquet(path)
    store.forget()
    frequent = spark.read.schema("h1 long, h2 long, last_doc long").parquet(path)
    return drop_lines(docs, frequent, min_chars)
