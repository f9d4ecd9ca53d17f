"""Documents with the cases every operator has to bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def documents(seed: int = 5, n: int = 120) -> list[tuple]:
    """Random texts, near copies, copies, repeated lines, secrets, odd white space."""
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = []
    for i in range(n):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 11 == 0:
            text += f" token = 'k{i}9999999' AKIA{'ABCDEFGH12' * 2} {'0af' * 9}"
        if i % 13 == 0:
            text = text.replace(" ", "  \t", 3) + "\r\n "
        rows.append((i * 3, text, rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 1, 2])}", len(text)))
    rows += [
        (1000, None, "en", None, None),
        (1001, "", "en", "", 0),
        (1002, " \n\t", "de", "s1", 3),
        (1003, "x" * 30_000 + " end", "en", "s0", 30_004),
        (1004, "<|endoftext|> a <|endoftext|>", None, "s0", 29),
        (1005, "1234 !? 99", "en", "s9", 10),
        (None, "no id here at all", "en", "s0", 17),
    ]
    return rows


def table(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(docs: DataFrame) -> DataFrame:
    """Extra columns named like what operators use or return."""
    names = ["n_tokens", "start", "token", "k1", "h1", "component_id", "kept", "score", "_source", "batch", "part", "count", "vertex"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names], F.array(F.lit(1)).alias("_lost"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def by_id(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
