"""Secret scan over an incremental ledger of blobs.

Every version of every file is content-addressed by the SHA-256 of its text. The ledger
remembers which (blob, rule, rule version) have been scanned and what was found, as
Parquet below one folder. A scan reads only texts of pairs the ledger does not hold, one
copy of each, then joins the findings back to all paths. Only DataFrame functions.

Positions are code points, end exclusive. They come from the lengths of the matches and of
the stretches between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusloom.session import new_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # A match that is too short ends where its run of letters ends, so asking for the
    # length in the pattern finds the same spans.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
MORE = (Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),)
RULES = BASE + MORE

_SCANNED = "blob string, kind string, version int"
_FOUND = "blob string, kind string, version int, start long, end long"


class Ledger:
    """What has been scanned and found so far, below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_path(spark, "blob-ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def found(self) -> DataFrame:
        return self._read("found", _FOUND)

    def empty(self) -> bool:
        return self.scanned().isEmpty()


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _matches(rule: Rule) -> Column:
    """Per match: its number, the characters before it since the last match, its own, its group's."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.char_length(s))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.char_length(s))
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.char_length(s))
    zipped = F.transform(
        whole,
        lambda n, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            i.alias("number"),
            F.get(gaps, i).alias("gap"),
            n.alias("length"),
            F.get(part, i).alias("part"),
        ),
    )
    wanted = F.array_contains(F.col("kinds"), rule.kind) & F.rlike(text, pattern)
    none = "array<struct<kind:string,version:int,number:int,gap:int,length:int,part:int>>"
    return F.when(wanted, zipped).otherwise(F.array().cast(none))


def _spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of ``texts(blob, text, kinds)``: ``blob, kind, version, start, end``."""
    rows = texts.select("blob", F.inline(F.concat(*[_matches(r) for r in rules])))
    rows = rows.dropDuplicates(["blob", "kind", "number"])  # copies of one row of the input
    before = Window.partitionBy("blob", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("length")).cast("long")).over(before)
    least = reduce(lambda c, r: F.when(F.col("kind") == r.kind, r.least).otherwise(c), rules, F.lit(0))
    return (
        rows.withColumn("end", end)
        .filter(F.col("part") >= least)
        .select("blob", "kind", "version", (F.col("end") - F.col("length")).alias("start"), "end")
    )


def _addressed(versions: DataFrame) -> DataFrame:
    rows = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("blob", blob_of(F.col("text")))


def scan_blobs(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger does not hold of ``versions(path, text)``, add it to the ledger and
    return all it holds of ``rules``: ``blob, kind, version, start, end``.

    A run that ends between the two writes leaves findings without their mark; the next
    run scans those blobs again and the findings are told apart by their content.
    """
    rows = _addressed(versions)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    blobs = rows.groupBy("blob").agg(F.min("path").alias("first_path"))
    pairs = blobs.select("blob", "first_path", F.inline(wanted))
    if not ledger.empty():
        pairs = pairs.join(ledger.scanned(), ["blob", "kind", "version"], "left_anti")
    unseen = pairs.groupBy("blob").agg(F.first("first_path").alias("first_path"), F.collect_set("kind").alias("kinds"))
    unseen = unseen.withColumnRenamed("blob", "unseen_blob")
    same = (F.col("blob") == F.col("unseen_blob")) & F.col("path").eqNullSafe(F.col("first_path"))
    texts = rows.join(unseen, same).select("blob", "text", "kinds")
    _spans(texts, rules).write.mode("append").parquet(f"{ledger.folder}/found")
    pairs.select("blob", "kind", "version").write.mode("append").parquet(f"{ledger.folder}/scanned")
    current = reduce(
        lambda c, r: c | ((F.col("kind") == r.kind) & (F.col("version") == r.version)), rules, F.lit(False)
    )
    return ledger.found().filter(current).dropDuplicates()


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_blobs``, joined back to all paths: ``path, blob, kind, version, start, end``.

    Every version has a row per finding of its blob (repeated rows included), or one row with
    nulls. A null text counts as an empty one, a null path stays null, an empty table gives
    no rows, other columns are not looked at.
    """
    found = scan_blobs(versions, ledger, rules)
    paths = _addressed(versions).select("path", "blob")
    return paths.join(found, "blob", "left").select("path", "blob", "kind", "version", "start", "end")


def summaries(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: ``path, n_<kind>`` of each rule, ``base_spans`` and ``spans``.

    Spans are ``kind:start:end`` by start, then by the rules' order, comma-joined.
    """
    order = reduce(lambda c, x: F.when(F.col("kind") == x[1].kind, x[0]).otherwise(c), enumerate(rules), F.lit(-1))
    base = [r.kind for r in BASE]
    span = F.struct("start", order.alias("order"), "kind", "end")

    def joined(spans: Column) -> Column:
        written = F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(written, ",")

    found = scan_blobs(versions, ledger, rules)
    per_blob = found.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules],
        joined(F.collect_list(F.when(F.col("kind").isin(base), span))).alias("base_spans"),
        joined(F.collect_list(span)).alias("spans"),
    )
    out = _addressed(versions).select("path", "blob").join(per_blob, "blob", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")]
    return out.select("path", "blob", *counts, *texts)
