"""A chunk store that knows its ids: levelled runs of ids by prefix, named by a commit log.

    store/log/...                       the states
    store/data/stream=<s>/batch=<n>/    the chunks a batch added
    store/ids/<run>/prefix=<pp>/        their ids, sorted

A batch asks only for the ids that share a prefix with its own, in the runs the last state
names, so it does not read the store. Runs of a level are merged once there are several, so
their number grows with the logarithm of the batches. Chunks of a batch are visible from its
commit on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import stored
from corpusloom.sources.runlog import FANOUT, RunLog, State, read_runs

# Leading characters of an id that name its folder.
PREFIX_CHARS = 2
_IDS = "chunk_id string, prefix string"


def _with_prefix(ids: DataFrame) -> DataFrame:
    return ids.select("chunk_id", F.substring("chunk_id", 1, PREFIX_CHARS).alias("prefix"))


def held_ids(spark: SparkSession, store: str, state: State, wanted: DataFrame) -> DataFrame:
    """Which of ``wanted(chunk_id)``, a stored table, the store holds. Only the folders of their
    prefixes are read, and where they are few they go to the runs and not the other way round."""
    prefixes = sorted(r[0] for r in _with_prefix(wanted).select("prefix").distinct().collect())
    runs = read_runs(spark, f"{store}/ids", state.names(), _IDS)
    near = runs.filter(F.col("prefix").isin(prefixes) if prefixes else F.lit(False))
    return near.join(wanted.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id")


def insert(
    chunks: DataFrame,
    store: str,
    stream: str,
    batch: int,
    fanout: int = FANOUT,
    also: Callable[[], None] | None = None,
) -> bool:
    """Add the chunks the store does not hold as batch number ``batch`` of ``stream``; ``also`` writes
    what has to appear with them and may be run again.

    ``chunks`` must be distinct by ``chunk_id``. A batch that is already in the store adds
    nothing and gives false; one that broke is written anew. Streams may insert at the same
    time: the one that commits second looks again at what it may add.
    """
    spark = chunks.sparkSession
    log = RunLog(spark, store)
    if log.read().is_done(stream, batch):
        return False
    chunks = stored(chunks, "batch-chunks")

    def write(state: State, run: str) -> None:
        held = held_ids(spark, store, state, chunks)
        data = f"{store}/data/stream={stream}/batch={batch}"
        chunks.join(held, "chunk_id", "left_anti").write.mode("overwrite").parquet(data)
        _write_ids(spark.read.schema(chunks.schema).parquet(data), f"{store}/ids/{run}")
        if also is not None:
            also()

    def merge(names: list[str], run: str) -> None:
        _write_ids(read_runs(spark, f"{store}/ids", names, _IDS), f"{store}/ids/{run}")

    return log.add(write, stream, batch, merge, fanout)


def _write_ids(ids: DataFrame, path: str) -> None:
    rows = _with_prefix(ids)
    rows.repartition("prefix").sortWithinPartitions("prefix", "chunk_id").write.partitionBy("prefix").parquet(path)


def read_store(spark: SparkSession, store: str, schema: str, stream: str | None = None, batch: int | None = None) -> DataFrame:
    """The chunks of all batches that were committed, or those of one stream or batch."""
    state = RunLog(spark, store).read()
    if not state.done:
        return spark.createDataFrame([], schema)
    whole = f"{schema}, stream string, batch long"
    rows = spark.read.schema(whole).option("basePath", f"{store}/data").parquet(f"{store}/data")
    seen = F.lit(False)
    for name, last in state.done.items():
        if stream in (None, name):
            seen = seen | ((F.col("stream") == name) & (F.col("batch") <= last))
    if batch is not None:
        seen = seen & (F.col("batch") == batch)
    return rows.filter(seen).drop("stream", "batch")
