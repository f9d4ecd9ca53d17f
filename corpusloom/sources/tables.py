"""Stored tables: pages by URL, schema listing, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_lookup(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the requested URLs from a crawl snapshot, with the columns ``pages`` comes with;
    ``found`` marks the hits."""
    return requests.join(pages, "url", "left").withColumn("found", F.col("page_id").isNotNull())


def schema_listing(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """``table, position, field, type`` of stored tables, from their footers alone."""
    rows = [
        F.struct(
            F.lit(name).alias("table"),
            F.lit(i).cast("long").alias("position"),
            F.lit(f.name).alias("field"),
            F.lit(f.dataType.simpleString()).alias("type"),
        )
        for name, path in tables.items()
        for i, f in enumerate(spark.read.parquet(path).schema.fields)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def last_change(spark: SparkSession, path: str) -> int:
    """When a table's files were last written, in milliseconds, as its file system tells."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max([files.getFileStatus(where).getModificationTime(), *(f.getModificationTime() for f in files.listStatus(where))])
