"""Column functions on text: tokens, words, names. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Without it an expression used inside a lambda is worked out per element.
    """
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens; empty text gives an empty array."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Token count by whitespace; exact model counts need a caller's tokenizer."""
    return F.size(tokens(text)).cast("long")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def term_counts(word_array: Column) -> Column:
    """``ARRAY<STRUCT<term, tf>>`` of one row's words.

    Sort the row's words and measure each run, so counting needs no shuffle.
    """

    def runs(a: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, j: F.struct(
                F.get(a, s).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(a)) - s).cast("long").alias("tf"),
            ),
        )

    def count(a: Column) -> Column:
        counted = let(
            F.filter(
                F.sequence(F.lit(0), F.size(a) - 1),
                lambda i: ~F.get(a, i).eqNullSafe(F.get(a, i - 1)),
            ),
            lambda starts: runs(a, starts),
        )
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return F.when(F.size(a) > 0, counted).otherwise(none)

    return let(F.sort_array(word_array), count)


def not_blank(text: Column) -> Column:
    return text.rlike(r"\S")


def strip(text: Column) -> Column:
    """Trim whitespace of every kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Last dotted suffix of the file name, dot included; '' when there is none."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"([^.])\.[^.]+$", "$1")


def safe_name(path: Column) -> Column:
    """File stem with every character but letters and digits turned into ``_``."""
    return F.regexp_replace(stem(path), r"[^\p{L}\p{N}]", "_")


def export_name(path: Column, run_at: Column) -> Column:
    """Name of the chunk file; the run time is an argument, so reruns repeat it."""
    return F.concat(safe_name(path), F.lit("_"), F.date_format(run_at, "yyyyMMdd_HHmmss"), F.lit(".json"))
