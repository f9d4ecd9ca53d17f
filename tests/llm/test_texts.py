"""Near copies, languages, quality rules, line dedup and secrets against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import langid, line_dedup, ngram_join, quality, secret_scan
from tests.llm.fixtures import by_id, clashing, documents, empty, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# ------------------------------------------------------------------ near copies


def brute_components(rows, percent=80):
    sets = {}
    for doc_id, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 30, 80]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += passage
        rows.append((i * 7 % 1009, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE")]


def test_near_copies(spark, monkeypatch):
    """Small limits, so that counts of frequent n-grams, several parts and cut chains are used."""
    for name, value in (("OFTEN", 5), ("CHAIN", 30), ("FLUSH", 3_000), ("PART", 3_000)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(3)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_copies_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (5, "A  b c d e\nf"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (5, 2, 1), (6, 0, 6)], key=repr)
    assert by_id(ngram_join.one_of_each(docs.filter("doc_id IS NOT NULL")), "doc_id") == [(1,), (1,), (6,)]
    assert ngram_join.near_duplicates(docs.filter("doc_id > 99")).count() == 0


def test_near_copies_of_rows_repeated_over_partitions(spark):
    """Copies of one row in several tasks count each n-gram of the document once."""
    common = [f"c{i}" for i in range(96)]
    a, b = " ".join([*(f"a{i}" for i in range(8)), *common]), " ".join([*common, *(f"b{i}" for i in range(8))])
    parts = [spark.createDataFrame([row], "doc_id long, text string") for row in [(1, a), (2, b), (1, a), (1, a), (2, b)]]
    docs = reduce(DataFrame.unionAll, parts)
    assert docs.rdd.getNumPartitions() >= 5
    got = by_id(ngram_join.near_duplicates(docs), "doc_id", "component_id")
    assert got == [(1, 1)] * 3 + [(2, 1)] * 2
    assert by_id(ngram_join.one_of_each(docs), "doc_id") == [(1,)] * 3


# ------------------------------------------------------------------ languages


def speech(rng, lang):
    stems = {"en": ["the", "thing", "with", "sh"], "fr": ["le", "eau", "été", "que"], "de": ["der", "sch", "über", "und"]}
    return " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, l := rng.choice(["en", "fr", "de"])), l) for i in range(300)]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 !? 34", "xx"), (903, "a" * 50_000, None), (None, rows[0][1], "en")]
    docs = clashing(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    for doc_id, _, lang in rows:
        r = got[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert r["lang_pred"] == lang and 0 <= r["score"] <= 1
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert not got[None]["held_out"] and len(got) == len(rows) + len(odd)
    kept = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert {900, 901, 902}.isdisjoint(kept) and {r[0] for r in rows} <= kept
    assert langid.accepted(docs).columns == docs.columns


def test_held_out_labels_are_not_learnt(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, "en"), "en") for i in range(60)]
    held = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows += [(i, speech(rng, "fr"), "only held out") for i in held]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in got.collect()} == {"en"}


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert by_id(langid.predict(docs), "lang_pred", "score") == [("und", 0.0)]
    assert langid.predict(docs.filter("doc_id > 5")).count() == 0


# ------------------------------------------------------------------ quality rules


def brute_quality(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, again = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            again |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed


def test_quality_metrics(spark):
    rows = documents() + [(5000, "a | b & <c> ## " * 30, "en", "s", 1)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:40] if r[0]] + [(None, 1, None), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(clashing(table(spark, rows)), labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_id(out, "doc_id", *names) == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    assert out.filter("kept AND base_failed").count() == 0
    assert by_id(out, "doc_id", "kept", "score") == by_id(quality.judge(table(spark, rows, 5), labels), "doc_id", "kept", "score")


def test_quality_verdicts(spark):
    rng = random.Random(1)
    clean = [f"clean{i}" for i in range(400)]
    junk = [f"JUNK{i}!!" for i in range(400)]
    rows = [(i, " ".join(rng.choice(clean if i % 4 else junk) for _ in range(120))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).filter("kept").collect()}
    assert kept == {i for i, _ in rows if i % 4}
    none = quality.judge(docs, labels.filter("quality > 5"))
    assert {r["score"] for r in none.collect()} == {0.0} and none.filter("kept").count() == 400
    assert quality.judge(docs.filter("doc_id > 999"), labels).count() == 0


def test_every_good_document_is_in_the_target(spark):
    """More of them than one model once took (20,000), with and without a broadcast, null ids and copies."""
    n = 20_600
    id_ = F.when(F.col("id") % 103 > 0, F.col("id") - F.col("id") % 2)
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(40))) for i in range(5)])
    docs = spark.range(n).select(id_.alias("doc_id"), text.alias("text"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_documents(docs, labels).count() == 2 * n

    spared = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(quality.CALIBRATION)) == 0
    rows = docs.withColumn("spared", spared & F.col("doc_id").isNotNull()).toPandas()
    buckets, row = quality._features(pa.RecordBatch.from_pandas(rows[["text"]]))
    trusted = (rows["doc_id"].notna() & ~rows["spared"]).to_numpy()[row]
    raw, target = (1 + np.bincount(b, minlength=1 << quality.BUCKET_BITS) for b in (buckets, buckets[trusted]))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    known = np.sort((np.bincount(row, ratio[buckets]) / np.bincount(row))[rows["spared"]])
    low, middle = (known[math.ceil(share * len(known)) - 1] for share in (quality.LOW_SHARE, 0.5))
    for most in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            got, threshold = quality.fit(docs, quality.trusted_documents(docs, labels))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert np.allclose(got, ratio, atol=1e-12)
        assert threshold == pytest.approx(middle - quality.SLACK * (middle - low), abs=1e-12)


@pytest.mark.parametrize("values", [[], [0.5], [1.0, -2.0], [-0.25] * 7 + [3.0], [math.sin(i) for i in range(999)]])
def test_quantiles_are_exact(spark, values):
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    want = scores.agg(F.percentile_approx("score", [0.02, 0.5], 10_000)).first()[0] or [0.0, 0.0]
    assert quality._quantiles(scores, 0.02, 0.5) == list(want)


# ------------------------------------------------------------------ line dedup


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows):
    found = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(line_key(line)) >= 20:
                found[line_key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(found[line_key(x)]) < 3 or max(found[line_key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 6])
def test_line_dedup(spark, batches):
    rows = documents(n=200) + documents(n=200)[:3] + [(9, "ÉCOLE des Fées et des Rois " * 2 + "\n" + "x" * 19, None, None, 0)]
    docs = clashing(table(spark, rows))
    out = line_dedup.dedup_lines(docs, batches)
    got = by_id(out, "doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))
    assert got == brute_lines(rows)
    assert any(g[2] for g in got) and set(docs.columns) <= set(out.columns)


def test_line_store_levels(spark):
    """Runs are compacted, later sightings counted, whatever the batches."""
    store = line_dedup.LineStore(spark, fanout=2)
    for number in range(5):
        docs = spark.createDataFrame([(number, f"a line of its own number {number}\na line that all documents have")], "doc_id long, text string")
        store.add(line_dedup.batch_runs(docs, F.lit(0)), 2)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert store.runs().count() == 6
    assert [r["last_doc"] for r in store.frequent(3).collect()] == [4]
    store.forget()


def test_line_dedup_nothing(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_plan_is_native(spark):
    plan = line_dedup.dedup_lines(table(spark, documents(n=20)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!EvalPython)|Cartesian|NestedLoop", plan.replace("ArrowToColumnar", ""))


# ------------------------------------------------------------------ secrets

KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
}


def brute_spans(text):
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


SECRETS = [
    "Password: hunter2hunter token=abc secret=token:abcdefgh api_key = 'AKIA1234' APIKEY=\"zzzzzzz\"",
    "😀 token 😀 token:😀 token: abcdef😀 " + "a" * 23 + " " + "b" * 24 + " AKIA" + "Z" * 15 + " AKIA" + "Z" * 16,
    "AKIA" * 9 + "x" + "deadbeef" * 40 + "-----BEGIN RSA PRIVATE KEY-----",
    "token=" + "k" * 40_000,
    None,
    "",
]


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS * 2)] + [(r[0], r[1]) for r in documents()]
    versions = clashing(spark.createDataFrame(rows, "path long, text string"))
    out = secret_scan.summaries(versions, secret_scan.Ledger(spark))
    got = by_id(out, "path", "blob", "n_assign", "n_access", "n_hex", "base_spans", "spans")
    want = []
    for path, text in rows:
        spans = brute_spans(text)
        base = [s for s in spans if not s.startswith("pem")]
        counts = [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        want.append((path, hashlib.sha256((text or "").encode()).hexdigest(), *counts, ",".join(base), ",".join(spans)))
    assert got == sorted(want, key=repr)


def test_ledger_is_incremental(spark):
    ledger = secret_scan.Ledger(spark)
    first = spark.createDataFrame([(1, SECRETS[0]), (2, SECRETS[0])], "path long, text string")
    secret_scan.scan(first, ledger)
    assert ledger.scanned().count() == len(secret_scan.RULES)
    more = spark.createDataFrame([(3, SECRETS[0]), (4, SECRETS[2])], "path long, text string")
    newer = (*secret_scan.RULES, secret_scan.Rule("ip", 1, r"\d+\.\d+\.\d+\.\d+"))
    found = secret_scan.scan(more, ledger, newer)
    assert ledger.scanned().groupBy("blob", "kind", "version").count().filter("count > 1").isEmpty()
    assert ledger.scanned().count() == 2 * len(newer)
    spans = [f"{r['kind']}:{r['start']}:{r['end']}" for r in found.filter("path = 3").orderBy("start").collect()]
    assert spans == brute_spans(SECRETS[0])


def test_no_secrets(spark):
    none = spark.createDataFrame([], "path long, text string")
    assert secret_scan.scan(none, secret_scan.Ledger(spark)).count() == 0
    assert secret_scan.summaries(none, secret_scan.Ledger(spark)).count() == 0


def test_sample_takes_an_id_once(spark):
    """Rows that repeat an id do not multiply, and the sample keeps its bound."""
    learnable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learnable[0], f"text {i}", "en", "s", 1) for i in range(300)]
    rows += [(i, f"text {i}", "en" if i % 2 else "de", "s", 1) for i in learnable]
    docs = table(spark, rows, 5).select("doc_id", "text", "lang")
    whole = langid.training_sample(docs, 2_000).collect()
    assert sorted(r.doc_id for r in whole if r.doc_id != learnable[0]) == learnable[1:]
    assert sum(r.doc_id == learnable[0] for r in whole) <= 2  # once for each language it stands under
    few = langid.training_sample(docs, 10).collect()
    assert len(few) == 10 and {r.lang for r in few} == {"en", "de"}
