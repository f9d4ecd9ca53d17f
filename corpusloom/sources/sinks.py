"""Writers: chunk files, stores, graph exports and converted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import graph, summaries
from corpusloom.options import EDGE_BATCH, NODE_BATCH


def chunk_records(
    docs: DataFrame, chunks: Column, source_file: Column, run_at: Column
) -> DataFrame:
    """One record per source with its ordered chunks.

    ``chunks`` is an ``ARRAY<STRUCT<..., text>>`` column worked out in the document's
    own row, so nothing is gathered from other tasks.
    """
    texts = F.transform(chunks, lambda c: c["text"])
    return docs.select(
        tx.export_name(source_file, run_at).alias("chunks_file"),
        source_file.alias("source_file"),
        run_at.alias("timestamp"),
        F.size(texts).cast("long").alias("num_chunks"),
        texts.alias("chunks"),
    ).filter(F.col("num_chunks") > 0)


def write_chunk_records(records: DataFrame, path: str) -> None:
    """One folder per run, named by its timestamp; a repeated run replaces its own."""
    run = F.date_format("timestamp", "yyyyMMddHHmmss")
    (
        records.withColumn("run", run)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .json(path)
    )


def chunk_summary(records: DataFrame) -> DataFrame:
    """``source_file, chunks_file, num_chunks`` per file and, with null names, the total."""
    files = records.select("source_file", "chunks_file", "num_chunks")
    total = files.agg(F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("num_chunks")).select(
        F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("string").alias("chunks_file"),
        "num_chunks",
    )
    return files.unionByName(total)


def write_chunk_summary(records: DataFrame, path: str) -> None:
    """Rewritten on every run."""
    chunk_summary(records).write.mode("overwrite").json(path)


def unseen(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose id the store does not hold; only its id column is read, and copies of
    one id are merged before they move."""
    return chunks.join(store.select("chunk_id").distinct(), "chunk_id", "left_anti")


def insert_chunks(chunks: DataFrame, store: DataFrame | None, path: str) -> None:
    """Append the chunks a store does not have yet; a repeated insert adds nothing."""
    new = chunks if store is None else unseen(chunks, store)
    new.write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write both lists as JSON and return their counts; a dry run only counts."""
    if not dry_run:
        nodes.write.mode("overwrite").json(f"{path}/nodes")
        edges.write.mode("overwrite").json(f"{path}/edges")
    return summaries.graph_counts(nodes, edges)


def write_graph_batches(
    nodes: DataFrame,
    edges: DataFrame,
    path: str,
    node_batch: int = NODE_BATCH,
    edge_batch: int = EDGE_BATCH,
    dry_run: bool = False,
) -> DataFrame:
    """Export in files of at most a batch of rows each."""
    checked = graph.edges_with_endpoints(edges, nodes)
    if not dry_run:
        labelled = graph.with_label(nodes).withColumn("display_name", F.col("id"))
        typed = graph.with_relation_type(checked)
        for df, n, name in ((labelled, node_batch, "nodes"), (typed, edge_batch, "edges")):
            df.write.mode("overwrite").option("maxRecordsPerFile", n).parquet(f"{path}/{name}")
    return summaries.graph_counts(nodes, checked)


def clear_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Leave both tables empty with their columns."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        empty = spark.createDataFrame([], df.schema)
        empty.write.mode("overwrite").parquet(f"{path}/{name}")


def write_documents(documents: DataFrame, path: str, output_format: str = "markdown") -> None:
    """Converted documents as text, or as one JSON record per line."""
    if output_format == "markdown":
        documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)
    elif output_format == "json":
        documents.write.mode("overwrite").json(path)
