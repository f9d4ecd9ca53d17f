"""Run summaries: counts by aggregates, long lists kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def process_summary(results: DataFrame) -> DataFrame:
    """One row of totals; ``ok`` is the exit status as a flag."""
    failed = F.count_if(~F.col("success"))
    return results.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("success")).alias("successful_files"),
        failed.alias("failed_files"),
        F.count_if(~F.col("success") & (F.col("error") != "")).alias("n_errors"),
        (failed == 0).alias("ok"),
    )


def process_errors(results: DataFrame) -> DataFrame:
    """The error list, one row each; failures without a message are left out."""
    return results.filter(~F.col("success") & (F.col("error") != "")).select("item", "error")


def store_summary(results: DataFrame, files: DataFrame) -> DataFrame:
    """Totals of storing. Successes count files; failures count failed results, files
    without chunks and failed inserts; ``total_chunks`` counts inserted chunks only,
    ``saved_chunks`` every chunk written to a chunk file."""
    stored = (F.col("n_chunks") > 0) & F.col("insert_ok")
    rows = results.filter(~F.col("success")).select(
        F.lit(0).cast("long").alias("success"),
        F.lit(1).cast("long").alias("failure"),
        F.lit(0).cast("long").alias("inserted"),
        F.lit(0).cast("long").alias("saved"),
    ).unionByName(
        files.select(
            stored.cast("long").alias("success"),
            (~stored).cast("long").alias("failure"),
            F.when(stored, F.col("n_chunks")).otherwise(0).cast("long").alias("inserted"),
            F.col("n_chunks").cast("long").alias("saved"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.agg(
        F.coalesce(F.sum("success"), zero).alias("successful_stores"),
        F.coalesce(F.sum("failure"), zero).alias("failed_stores"),
        F.coalesce(F.sum("inserted"), zero).alias("total_chunks"),
        F.coalesce(F.sum("saved"), zero).alias("saved_chunks"),
    )


def chunk_counts(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Chunks per source and, with a null source, in all."""
    return chunks.rollup(source).agg(F.count("*").alias("num_chunks"))


def counts_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Row counts per key: URLs per sitemap, files per repository."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "n").unionByName(
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n")
    )
