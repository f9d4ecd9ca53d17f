"""Exact copies by Patricia tries against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from corpusloom.llm import exact_dedup
from tests.llm.fixtures import by_id, clashing, documents, empty, table

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows, largest=True):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        digest, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in sorted(ids, key=repr):
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, digest))
    return sorted(out, key=repr)


def test_trie_is_a_map():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(900)] + [b"", b"a" * 5_000, b"a" * 4_999 + b"b"]
    trie, known = exact_dedup.Trie(), {}
    for key in keys:
        assert trie.insert(key) == known.setdefault(key, len(known))
    assert dict(trie.keys(trie.root, b"")) == {n: k for k, n in known.items()}


def test_trie_spills_a_subtree():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    rng.shuffle(keys)
    trie = exact_dedup.Trie()
    numbers = {trie.insert(k): k for k in keys}
    before, gone = trie.size, {}
    for _ in range(3):
        gone |= dict(trie.spill())
    assert gone and trie.size < before and all(numbers[n] == k for n, k in gone.items())
    stays = dict(trie.keys(trie.root, b""))
    assert not stays.keys() & gone.keys() and len(stays) + len(gone) == len(keys) and stays
    for n, k in numbers.items():
        assert trie.insert(k) == (None if n in gone else n)
    assert trie.insert(next(iter(gone.values())) + b"zz") is None


@pytest.mark.parametrize(
    "limits",
    [{}, {"trie_bytes": 3_000, "part_bytes": 20_000, "task_rows": 9, "pieces": 2}, {"trie_bytes": 1, "part_bytes": 4_000, "task_rows": 40}],
)
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups(spark, limits, keep):
    """The limits, also ones that spill all but one text of a trie, do not change the result."""
    rows = documents(seed=4, n=200)
    rows += [(i, "the same long text " * 40, "en", "hot", 9) for i in range(2000, 2150)]
    rows += [(7, rows[3][1], "en", "s0", 1), (7, rows[3][1], "en", "s0", 1), (None, None, None, None, None), (None, "alone", None, None, None)]
    rows += [(3000 + i, "the same long text " * i, "en", "s1", 1) for i in range(60)]
    got = exact_dedup.exact_duplicates(clashing(table(spark, rows, 12)), keep=keep, **limits)
    assert by_id(got, *COLUMNS) == brute(rows, keep == "largest")


def test_salted_and_spilled_rounds(spark, monkeypatch):
    """A text from many tasks takes a second round; without one the result would differ."""
    rows = [(i, f"shared {i % 3}", "en", "s", 1) for i in range(400)]
    calls = []
    run = exact_dedup._round
    monkeypatch.setattr(exact_dedup, "_round", lambda *a: calls.append(a[1]) or run(*a))
    got = exact_dedup.exact_duplicates(table(spark, rows, 20), "largest", pieces=4)
    assert by_id(got, *COLUMNS) == brute(rows) and calls == [0, 1]


def test_unequal_texts_of_one_hash(spark, monkeypatch):
    """Bytes decide, not the hash that deals the texts."""
    rows = [(1, "ab", "", "", 0), (2, "cd", "", "", 0), (3, "ab", "", "", 0), (4, "ce", "", "", 0)]
    docs = table(spark, rows, 1)
    rows_of = exact_dedup._round
    same = lambda df, *a: rows_of(df.withColumn("hash", df["length"]), *a)
    monkeypatch.setattr(exact_dedup, "_round", same)
    assert by_id(exact_dedup.exact_duplicates(docs, "largest"), *COLUMNS) == brute(rows)


def test_no_rows_and_bad_rule(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="smallest"):
        exact_dedup.exact_duplicates(empty(spark), keep="first")
