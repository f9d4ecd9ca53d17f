"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are sorted into cells of equal length and equal numbers of letters of each of a few
letter groups, and cells are cut into blocks. An edit moves a word to the same cell or to a
neighbouring one: a replaced letter takes one from a group and gives one to another, an
inserted letter lengthens the word by one. So a block meets only the blocks of its own and
of neighbouring cells, of its own length and of the next shorter one. The squared distances
of the letter counts of two blocks come out of one matrix product; pairs at most two apart
are held against the letters themselves. Every pair of near words meets exactly once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import record_batch
from corpusloom.session import new_path

LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form has so many times the occurrences of its variant.
FORM_TIMES = 10
# Of so many runs one loses a letter.
DAMAGED = 31
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK_WORDS = 1_024
BLOCK_BYTES = 64 << 10
# Visiting words held against a block at a time, and bytes of letters compared at a time.
VISITORS = 4_096
COMPARED = 8 << 20

_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))

_BLOCKS = "cell string, length int, groups array<int>, block long, words binary, counts binary"
_PAIRS = "word string, near string, near_n long"


def word_counts(docs: DataFrame, damaged: int = DAMAGED, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n`` of the words of ``docs(doc_id, text)`` with at least ``least_length`` letters.

    Words are maximal runs of Latin letters, A-Z lower-cased. With h the CRC-32 of
    ``<doc_id>:<run>``, a run loses its letter number ``h % length`` where ``damaged`` divides h.
    A null id counts as an empty one, a null text has no words.
    """
    text = F.col("text").cast("string")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _groups(n_words: int) -> int:
    """Number of letter groups: cells keep a few hundred words as the vocabulary grows."""
    return max(1, round(math.log2(max(2, n_words)) / 2.5) - 3)


def _cell(length: Column, groups: Column) -> Column:
    return F.concat_ws(",", length.cast("string"), F.concat_ws(",", F.transform(groups, lambda x: x.cast("string"))))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of words of one cell out of sorted rows, letters as Latin-1 bytes."""
    number = TaskContext.get().partitionId() << 32
    cell, length, groups, words, counts = None, 0, [], [], []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([cell]),
                pa.array([length], pa.int32()),
                pa.array([groups], pa.list_(pa.int32())),
                pa.array([number], pa.int64()),
                pa.array(["".join(words).encode("latin-1")], pa.binary()),
                pa.array([np.array(counts, "<i8").tobytes()], pa.binary()),
            ],
            names=["cell", "length", "groups", "block", "words", "counts"],
        )

    for batch in batches:
        for own, mine, word, n in zip(*(batch.column(c).to_pylist() for c in ("cell", "groups", "word", "n"))):
            if words and (own != cell or len(words) >= BLOCK_WORDS or len(words) * length >= BLOCK_BYTES):
                yield told()
                number, words, counts = number + 1, [], []
            cell, length, groups = own, len(word), mine
            words.append(word)
            counts.append(n)
    if words:
        yield told()


def _blocks(words: DataFrame, n_words: int) -> DataFrame:
    k = _groups(n_words)
    of_group = ["".join(c for c in LETTERS if ord(c) % k == i) for i in range(k)]
    groups = F.array(*[(F.char_length("word") - F.char_length(F.translate("word", g, ""))).cast("int") for g in of_group])
    placed = words.select("word", "n", groups.alias("groups"))
    placed = placed.select(_cell(F.char_length("word"), F.col("groups")).alias("cell"), "groups", "word", "n")
    # Range bounds go by cell and word, so a crowded cell is cut over several tasks.
    spread = placed.repartitionByRange(1 + n_words // 50_000, "cell", "word").sortWithinPartitions("cell", "word")
    path = new_path(words.sparkSession, "spelling-blocks")
    spread.mapInArrow(_cut, _BLOCKS).write.parquet(path)
    return words.sparkSession.read.schema(_BLOCKS).parquet(path)


def _meetings(blocks: DataFrame, k: int) -> DataFrame:
    """Each block with every block that may hold near words, one pair a row."""
    # (group that gains a letter, group that loses one), -1 for none.
    moves = [(-1, -1)] + list(itertools.combinations(range(k), 2)) + [(i, -1) for i in range(k)]
    listed = F.array(*[F.struct(F.lit(a).alias("gains"), F.lit(b).alias("loses")) for a, b in moves])
    visits = blocks.select("length", "groups", "block", "words", "counts", F.explode(listed).alias("move"))
    gains, loses = F.col("move.gains"), F.col("move.loses")
    moved = F.transform("groups", lambda x, i: x + (i == gains).cast("int") - (i == loses).cast("int"))
    longer = ((gains >= 0) & (loses < 0)).cast("int")
    visits = visits.withColumn("moved", moved).filter(F.forall("moved", lambda x: x >= 0))
    visits = visits.select(
        _cell(F.col("length") + longer, F.col("moved")).alias("cell"),
        (gains < 0).alias("own"),
        F.col("length").alias("visitor_length"),
        F.col("block").alias("visitor"),
        F.col("words").alias("visitor_words"),
        F.col("counts").alias("visitor_counts"),
    )
    met = blocks.drop("groups").join(visits, "cell").filter("NOT own OR visitor >= block")
    return met.select("length", "block", "words", "counts", "visitor_length", "visitor", "visitor_words", "visitor_counts")


class _Words:
    """A block's words: letters as a matrix of bytes, letter counts and their squares."""

    def __init__(self, words: bytes, length: int, counts: bytes):
        self.letters = np.frombuffer(words, np.uint8).reshape(-1, length)
        self.n = np.frombuffer(counts, "<i8")
        # Squares stay exact: whole numbers below 2 ** 24 or 2 ** 53.
        kind = np.float32 if length < 2_000 else np.float64
        rows, width = len(self.letters), len(LETTERS)
        cells = _DIMENSION[self.letters] + np.arange(rows)[:, None] * width
        self.bag = np.bincount(cells.ravel(), minlength=rows * width).reshape(rows, width).astype(kind)
        self.square = np.einsum("ij,ij->i", self.bag, self.bag)

    def spelled(self, rows: np.ndarray) -> list[str]:
        return [row.tobytes().decode("latin-1") for row in self.letters[rows]]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` differ by one replaced letter, or, where ``b`` is shorter by
    one, by one letter that ``a`` has more."""
    length = b.shape[1]
    if a.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    head = np.c_[a[:, :length] != b, np.ones(len(a), bool)].argmax(axis=1)  # first place that differs
    tail = np.c_[(a[:, 1:] != b)[:, ::-1], np.ones(len(a), bool)].argmax(axis=1)  # the same from the end
    return head + tail >= length


def _near(home: _Words, visitor: _Words, same: bool) -> Iterator[pa.RecordBatch]:
    distances = home.bag @ visitor.bag.T
    distances *= -2
    distances += home.square[:, None]
    distances += visitor.square
    rows, columns = np.nonzero(distances <= 2)
    if same:
        rows, columns = rows[rows < columns], columns[rows < columns]
    step = max(1, COMPARED // home.letters.shape[1])
    for start in range(0, len(rows), step):
        i, j = rows[start : start + step], columns[start : start + step]
        good = _one_edit(home.letters[i], visitor.letters[j])
        i, j = i[good], j[good]
        if len(i):
            a, b = home.spelled(i), visitor.spelled(j)
            yield record_batch(word=a + b, near=b + a, near_n=np.r_[visitor.n[j], home.n[i]])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the pairs of blocks, both ways; visitors of the same block that follow
    each other are held against it together."""
    home, number = None, None
    waiting: dict[int, list] = {}

    def told(length: int) -> Iterator[pa.RecordBatch]:
        parts = waiting.pop(length)
        visitor = _Words(b"".join(w for w, _ in parts), length, b"".join(c for _, c in parts))
        yield from _near(home, visitor, False)

    for batch in batches:
        for i in range(batch.num_rows):
            length, block, words, counts, other, visitor, visitor_words, visitor_counts = (c[i].as_py() for c in batch.columns)
            if block != number:
                for kept in list(waiting):
                    yield from told(kept)
                home, number = _Words(words, length, counts), block
            if visitor == block and other == length:
                yield from _near(home, home, True)
                continue
            waiting.setdefault(other, []).append((visitor_words, visitor_counts))
            if sum(len(c) for _, c in waiting[other]) >= 8 * VISITORS:
                yield from told(other)
    for kept in list(waiting):
        yield from told(kept)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of all words of ``words(word, n)`` that differ by exactly one inserted,
    deleted or replaced letter, each pair both ways. Words must be distinct, of the letters
    of ``LETTERS`` and not empty."""
    n_words = words.count()
    blocks = _blocks(words, n_words)
    return _meetings(blocks, _groups(n_words)).mapInArrow(_verified, _PAIRS)


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """Words of ``docs(doc_id, text)`` and the form each is a variant of.

    Returns one row per word with ``least_count`` occurrences or more: ``word, n, n_near`` (near
    words, see ``near_words``), ``form`` (the near word with most occurrences, the first in
    code-point order of several, if it has ``times`` as many as the word), ``form_n`` and ``root``
    (following forms to the last; the word itself if it has none). Rows that repeat a
    ``doc_id`` count one by one; no words give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "spelling-words")
    word_counts(docs).filter(F.col("n") >= least_count).write.parquet(path)
    words = spark.read.schema("word string, n long").parquet(path)
    best = F.min(F.struct(-F.col("near_n"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    formed = -F.col("best.col1") >= times * F.col("n")
    path = new_path(spark, "spelling-forms")
    joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, -F.col("best.col1")).alias("form_n"),
    ).write.parquet(path)
    told = spark.read.schema("word string, n long, n_near long, form string, form_n long").parquet(path)

    # Occurrences grow ``times``-fold with every step, so the longest way is known beforehand.
    most = told.agg(F.max("form_n")).first()[0]
    ways = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = ways.select(F.col("word").alias("at"), F.col("root").alias("next"))
    length, reached = 0, least_count
    while most and reached * times <= most:
        length, reached = length + 1, reached * times
    for _ in range(1, length):
        ways = ways.join(steps, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"))
    out = told.join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
