"""Spelling variants by Gram matrices against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import spelling
from tests.llm.fixtures import by_id, clashing, documents, empty, table

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7}


def brute(rows):
    words = {w: n for w, n in brute_words(rows).items() if n >= 2}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def texts(seed=0, n=60):
    """Words in falling frequency with many misspellings, also of misspellings; other letters."""
    rng = random.Random(seed)
    stems = ["Because", "thought", "Überraschung", "Élection", "straße÷ßend", "received", "recieved", "aaaaaaaa", "committee", "comittee"]
    out = []
    for i in range(n):
        words = []
        for stem, times in zip(stems, (400, 40, 40, 30, 20, 200, 12, 3, 300, 30)):
            for _ in range(rng.randint(0, 1 + times // 8)):
                word = stem
                while rng.random() < 0.12:
                    at = rng.randrange(len(word))
                    word = word[:at] + rng.choice(["", "e", "xé", word[at] * 2]) + word[at + 1 :]
                words.append(word)
        # A way of two steps: 2, about 30 and over 300 occurrences.
        words += ["qwertyu"] * 7 + ["qwertyx"] * (i % 2) + ["qwertzx"] * (i in (10, 20))
        rng.shuffle(words)
        out.append((i, "-1 ".join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("groups", [1, 2, 4])
def test_variants(spark, monkeypatch, groups):
    rows = texts() + documents(seed=2, n=40) + [(5, "w" * 70_000 + " " + "w" * 69_999, "en", "s", 1)] * 2
    monkeypatch.setattr(spelling, "_groups", lambda n: groups)
    got = spelling.variants(clashing(table(spark, rows)))
    want = brute(rows)
    assert by_id(got, *COLUMNS) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a way of several steps


def test_word_counts(spark):
    rows = documents(seed=3, n=150) + texts(1, 20)
    assert by_id(spelling.word_counts(table(spark, rows)), "word", "n") == sorted(brute_words(rows).items(), key=repr)


def test_edits():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 5, 6) for _ in range(30)]
    for a in words:
        for b in words:
            if len(a) - len(b) in (0, 1):
                rows = [np.frombuffer(w.encode(), np.uint8)[None] for w in (a, b)]
                assert bool(spelling._one_edit(*rows)[0]) == one_edit(a, b), (a, b)


def test_blocks_of_a_crowded_cell(spark):
    """More words in one cell than a block takes: every pair of blocks meets."""
    rng = random.Random(6)
    words = sorted({"".join(rng.sample("abcdefghij", 10)) for _ in range(3_000)})
    words += sorted({w[:i] + w[i + 1 :] for w in words[:50] for i in (0, 4)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    kept = set(words)
    want = set()
    for w in words:
        for i in range(len(w)):
            for v in [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in "abcdefghij" if c != w[i]]:
                if v in kept:
                    want |= {(w, v), (v, w)}
    got = by_id(spelling.near_words(df), "word", "near")
    assert got == sorted(want, key=repr)


def test_no_words(spark):
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(table(spark, [(1, "few short words", "", "", 0), (2, None, "", "", 0)])).count() == 0
    assert spelling.variants(table(spark, [(1, "letters letters", "", "", 0)])).count() == 1
