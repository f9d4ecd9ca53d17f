"""Session settings and the shared work folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; extra settings go in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; a cluster has to name one
    that every executor can reach.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_roots[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


# Bytes of text per bucket of the tables made from it.
BUCKET_BYTES = 32 << 20


def power_of_two(least: float) -> int:
    """The smallest power of two that is not below ``least``."""
    return 1 << max(0, math.ceil(least) - 1).bit_length()


def buckets_for(texts: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets tables made from ``texts`` get: by the bytes the column really has, not by
    an estimate, rounded to a power of two so that tables of a similar size go together."""
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]
    return power_of_two(max(texts.sparkSession.sparkContext.defaultParallelism, n_bytes / bucket_bytes))


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_go(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of the jobs run inside go with their job.

    Otherwise they stay until the driver happens to collect its garbage, and a chain of
    large steps holds the shuffles of all of them on disk at once.
    """
    return settings(spark, {_SHUFFLES_GO: "true"})


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below ``path`` and read it back; its shuffle files go with the job."""
    spark = df.sparkSession
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For intermediates that several later branches read: the work is done once, a lost
    executor costs a re-read and not the whole lineage, and Catalyst knows the size of
    what it reads, so whether to broadcast it is decided on facts. With ``bucket_by``
    the table keeps its partitioning in ``buckets`` buckets and later steps on that key need
    no shuffle; a ``df`` that is already grouped by the key is shuffled once, not again for the buckets.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if bucket_by is None:
        return write_once(df, path)
    n = buckets or spark.sparkContext.defaultParallelism
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    with settings(spark, {_SHUFFLES_GO: "true", "spark.sql.shuffle.partitions": str(n)}):
        (
            df.repartition(n, bucket_by)
            .write.bucketBy(n, bucket_by)
            .option("compression", "zstd")
            .option("path", path)
            .saveAsTable(table)
        )
    return spark.table(table)
