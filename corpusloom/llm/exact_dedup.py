"""Exact copies by Patricia tries that own the texts.

Every task first puts the texts of its own rows into a compressed radix trie, so that copies
within a task travel once, with the row that stays among them and their number. What is left
is dealt by length and content hash; a trie per partition takes the full byte strings, and
its terminal nodes hold the owner of the text and the number of rows. Equality is decided by
the bytes alone; the hash only deals.

A trie that outgrows its memory gives its largest subtree back as rows, and so does
everything that would enter that subtree later; those rows are dealt anew in the next round.
A text that came from very many tasks is first settled in salted pieces, whose winners meet
in the next round. Rounds are written tables, so a lost executor costs a re-read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import slices
from corpusloom.session import new_path

# Bytes of labels and nodes that a trie may hold, and of texts per partition.
TRIE_BYTES = 48 << 20
PART_BYTES = 24 << 20
# Rows of a task settled at a time, and pieces of one text that meet in one task.
TASK_ROWS = 200_000
PIECES = 64
_NODE_BYTES = 300

_SPILLED: dict = {}

CLAIMS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("ref", pa.int64()),
        ("length", pa.int64()),
        ("hash", pa.int64()),
        ("best_id", pa.int64()),
        ("best_row", pa.int64()),
        ("n", pa.int64()),
        ("text", pa.binary()),
    ]
)
SETTLED = pa.schema(
    [
        ("ref", pa.int64()),
        ("class", pa.int64()),
        ("length", pa.int64()),
        ("hash", pa.int64()),
        ("best_id", pa.int64()),
        ("best_row", pa.int64()),
        ("n", pa.int64()),
        ("text", pa.binary()),
    ]
)
_ROWS = "row long, doc_id long, text_sha256 string, ref long, length long, hash long, best_id long, best_row long, n long, text binary"
_SETTLED = "ref long, class long, length long, hash long, best_id long, best_row long, n long, text binary"


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes ``label`` shares with ``key`` from place ``at``: by halves, so that long
    labels are compared in blocks of memory."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings. Nodes are ``[label, children, terminal]``;
    terminals are numbered as they come."""

    def __init__(self):
        self.root: list = [b"", {}, -1]
        self.n = 0
        self.size = 0

    def insert(self, key: bytes) -> int | None:
        """The number of ``key``'s terminal, a new one where it was not there; None where the
        key belongs to a subtree that was given back."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[1] is _SPILLED:
                    return None
                if node[2] < 0:
                    node[2] = self._next()
                return node[2]
            if node[1] is _SPILLED:
                return None
            child = node[1].get(key[at])
            if child is None:
                leaf = [key[at:], {}, self._next()]
                node[1][key[at]] = leaf
                self.size += _NODE_BYTES + len(leaf[0])
                return leaf[2]
            label = child[0]
            if not key.startswith(label, at):
                shared = _shared(label, key, at)
                upper = [label[:shared], {label[shared]: child}, -1]
                child[0] = label[shared:]
                node[1][key[at]] = upper
                self.size += _NODE_BYTES
                child = upper
                label = child[0]
            node, at = child, at + len(label)

    def _next(self) -> int:
        self.n += 1
        return self.n - 1

    def _sizes(self) -> dict[int, int]:
        """Bytes below each node, by the node's identity; what was given back counts nothing."""
        sizes: dict[int, int] = {}
        stack = [(self.root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                own = 0 if node[1] is _SPILLED else _NODE_BYTES + len(node[0])
                sizes[id(node)] = own + sum(sizes[id(c)] for c in node[1].values())
            else:
                stack.append((node, True))
                stack += [(c, False) for c in node[1].values()]
        return sizes

    @staticmethod
    def keys(node: list, before: bytes) -> Iterator[tuple[int, bytes]]:
        """Terminals below ``node`` and their byte strings."""
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] >= 0:
                yield node[2], key
            stack += [(c, key) for c in node[1].values()]

    def spill(self) -> list[tuple[int, bytes]]:
        """Give back the largest subtree, or the largest one below it while that is over half of
        the trie, and remember that it is gone. Of two terminals or more one stays."""
        sizes = self._sizes()
        node, before = self.root, b""
        while True:
            open_ = [c for c in node[1].values() if c[1] is not _SPILLED]
            if not open_:
                return []
            child = max(open_, key=lambda c: sizes[id(c)])
            inner = [c for c in child[1].values() if c[1] is not _SPILLED]
            if inner and sizes[id(child)] > sizes[id(self.root)] // 2:
                node, before = child, before + child[0]
                continue
            gone = list(self.keys(child, before))
            self.size -= sizes[id(child)] - _NODE_BYTES - len(child[0])
            child[1], child[2] = _SPILLED, -1
            return gone


def _better(largest: bool):
    """Whether the first (doc_id, row) stays rather than the second; a null id never does
    against another one, and of equal ids the first row does."""

    def better(a: tuple, b: tuple) -> bool:
        if a[0] is None or b[0] is None:
            return a[1] < b[1] if a[0] is b[0] else b[0] is None
        if a[0] == b[0]:
            return a[1] < b[1]
        return (a[0] > b[0]) == largest

    return better


def _claimer(largest: bool, trie_bytes: int, task_rows: int):
    """Rows of a task with their text's first row in the task (``ref``), which alone carries
    the text, the best row of the task's copies and their number."""
    better = _better(largest)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        trie, rows, owners = Trie(), [], []

        def told() -> Iterator[pa.RecordBatch]:
            out = []
            for number, doc_id, t in rows:
                first, digest, length, hashed, best, n, text = owners[t]
                if first == number:
                    out.append((number, doc_id, digest, first, length, hashed, *best, n, text))
                else:
                    out.append((number, doc_id, digest, first, *[None] * 6))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CLAIMS)], schema=CLAIMS)

        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, text in zip(ids, texts):
                t = trie.insert(text)
                if t == len(owners):
                    hashed = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    owners.append([row, hashlib.sha256(text).hexdigest(), len(text), hashed, (doc_id, row), 1, text])
                else:
                    owner = owners[t]
                    owner[5] += 1
                    if better((doc_id, row), owner[4]):
                        owner[4] = (doc_id, row)
                rows.append((row, doc_id, t))
                row += 1
                if trie.size > trie_bytes or len(rows) >= task_rows:
                    yield from told()
                    trie, rows, owners = Trie(), [], []
        yield from told()

    return claim


def _settler(largest: bool, trie_bytes: int):
    """One row per incoming row: a text's first row in the partition holds what is known of
    it (with the text where it has to go on), every other one names that row as its class."""
    better = _better(largest)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, owners, live, out, held = Trie(), [], 0, [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SETTLED)], schema=SETTLED)

        def pending(owner: list, text: bytes) -> tuple:
            ref, length, hashed, best, n, _ = owner
            return (ref, ref, length, hashed, *best, n, text)

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("ref", "length", "hash", "best_id", "best_row", "n", "hot", "text")]
            for ref, length, hashed, best_id, best_row, n, hot, text in zip(*columns):
                t = trie.insert(text)
                if t is None:
                    out.append((ref, ref, length, hashed, best_id, best_row, n, text))
                    held += length
                elif t == len(owners):
                    owners.append([ref, length, hashed, (best_id, best_row), n, hot])
                    live += 1
                else:
                    owner = owners[t]
                    owner[4] += n
                    if better((best_id, best_row), owner[3]):
                        owner[3] = (best_id, best_row)
                    out.append((ref, owner[0], *[None] * 6))
                if trie.size > trie_bytes and live > 1:
                    for gone, key in trie.spill():
                        out.append(pending(owners[gone], key))
                        owners[gone] = None
                        live -= 1
                        held += len(key)
                if held > trie_bytes or len(out) >= 100_000:
                    yield told()
                    out, held = [], 0
        for t, key in trie.keys(trie.root, b""):
            owner = owners[t]
            out.append(pending(owner, key if owner[5] else None))
            if len(out) >= 100_000:
                yield told()
                out = []
        if out:
            yield told()

    return settle


def _round(rows: DataFrame, number: int, largest: bool, trie_bytes: int, part_bytes: int) -> DataFrame:
    """Settle ``rows`` by the tries of one round; the result is written. Every further round deals
    what is left to twice as many tasks for its size, so rounds stay few."""
    spark = rows.sparkSession
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(count, (1 + total // part_bytes) << number))
    dealt = F.xxhash64(F.lit(number), "length", "hash", "salt")
    settled = rows.repartition(parts, dealt).drop("salt").mapInArrow(_settler(largest, trie_bytes), _SETTLED)
    path = new_path(spark, f"exact-round-{number}")
    settled.write.parquet(path)
    return spark.read.schema(_SETTLED).parquet(path)


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    trie_bytes: int = TRIE_BYTES,
    part_bytes: int = PART_BYTES,
    task_rows: int = TASK_ROWS,
    pieces: int = PIECES,
) -> DataFrame:
    """Groups of rows of ``docs(doc_id, text)`` whose texts are equal byte for byte.

    Returns one row per row of ``docs``: ``doc_id, keep_id`` (id of the row that stays: the
    ``smallest`` or the ``largest``), ``group_size, kept, text_sha256``. A null text counts as
    an empty one and is a text like others. Rows that repeat a ``doc_id`` count one by one;
    where they share a text, one of them stays. A null ``doc_id`` stays only in a group
    without other ids. An empty table gives no rows; other columns are not read. The limits
    bound memory and do not change the result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark, largest = docs.sparkSession, keep == "largest"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = new_path(spark, "exact-claims")
    texts.mapInArrow(_claimer(largest, trie_bytes, task_rows), _ROWS).write.parquet(path)
    claims = spark.read.schema(_ROWS).parquet(path)

    # Texts that came from many tasks get as many salts as their number asks for.
    firsts = claims.filter("text IS NOT NULL")
    many = firsts.groupBy("length", "hash").count().filter(F.col("count") > pieces)
    many = many.select("length", "hash", F.ceil(F.col("count") / pieces).alias("salts"))
    path = new_path(spark, "exact-many")
    many.write.parquet(path)
    many = spark.read.schema("length long, hash long, salts long").parquet(path)
    salt = F.coalesce(F.pmod(F.xxhash64("ref"), "salts"), F.lit(0)).alias("salt")
    columns = ["ref", "length", "hash", "best_id", "best_row", "n", "text"]
    rows = firsts.join(many, ["length", "hash"], "left").select(*columns, salt, F.col("salts").isNotNull().alias("hot"))

    rounds = []
    while True:
        rounds.append(_round(rows, len(rounds), largest, trie_bytes, part_bytes))
        rest = rounds[-1].filter("text IS NOT NULL")
        if rest.isEmpty():
            break
        rows = rest.select(*columns, F.lit(0).alias("salt"), F.lit(False).alias("hot"))

    found = None
    for settled in reversed(rounds):
        own = settled.filter("class = ref")
        known = own.filter("text IS NULL").select("class", "best_id", "best_row", "n")
        if found is not None:
            later = own.filter("text IS NOT NULL").select(F.col("class").alias("ref")).join(found, "ref")
            known = known.unionAll(later.select(F.col("ref").alias("class"), "best_id", "best_row", "n"))
        found = settled.select("ref", "class").join(known, "class").select("ref", "best_id", "best_row", "n")
    members = claims.select("row", "doc_id", "text_sha256", "ref").join(found, "ref")
    return members.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"),
        "text_sha256",
    )
