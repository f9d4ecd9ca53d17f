"""Tables laid out by a lookup key: a lookup reads only the shelves its keys lie on.

A row's shelf is a hash of its key and its part; shelves are folders, rows are sorted by key
inside. A key with many rows (a hub) has several parts, so it lies on several shelves and no
shelf holds all of it; every other key has part 0. The shelves of a batch of keys, at most
as many numbers as there are shelves, become a filter on the folder that Spark applies
before it opens a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import new_path, power_of_two, shuffles_go, stored

PART, SHELF = "_part", "_shelf"
ROWS_PER_PART = 65_536
ROWS_PER_SHELF = 131_072
# Folders of one table at least and at most; more rows make larger shelves of several files.
FEWEST, MOST = 16, 4_096


def _shelf(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys, PART), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Shelves:
    rows: DataFrame
    keys: tuple[str, ...]
    hubs: DataFrame  # keys, parts
    n: int

    def asked(self, wanted: DataFrame) -> DataFrame:
        """``wanted(keys, ...)`` with the part of each place a key's rows lie at."""
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        hubs = self.hubs.withColumnRenamed("parts", "_parts")
        return wanted.join(hubs, list(self.keys), "left").withColumn(PART, F.explode(parts)).drop("_parts")

    def at(self, asked: DataFrame) -> DataFrame:
        """The rows on the shelves of ``asked(keys, _part, ...)``, not yet joined."""
        places = asked.select(_shelf(self.keys, self.n).alias(SHELF)).distinct().collect()
        shelves = sorted(r[0] for r in places)
        here = F.col(SHELF).isin(shelves) if shelves else F.lit(False)
        return self.rows.filter(here).drop(SHELF)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted(keys, ...)`` joined with the rows of its keys. A null key finds nothing. What is asked is
        stored, as it is read twice and Spark shuffles the shelves unless it knows how small it is."""
        asked = stored(self.asked(wanted), "asked")
        return self.at(asked).join(asked, [*self.keys, PART]).drop(PART)


def shelve(
    df: DataFrame,
    keys: tuple[str, ...],
    name: str,
    rows_per_part: int = ROWS_PER_PART,
    rows_per_shelf: int = ROWS_PER_SHELF,
    hubs: DataFrame | None = None,
    n_rows: int | None = None,
    gather: Callable[[DataFrame], DataFrame] | None = None,
) -> Shelves:
    """Write ``df``, a stored table, by ``keys``.

    Rows of a hub are dealt to its parts by a hash of the whole row, so a task that is run
    again deals them the same way. A caller that knows them passes ``hubs(keys, parts)`` itself, with
    the part of each row in the column ``PART``. ``gather`` makes the rows of a shelf, ``n_rows`` of them in
    all, out of what has been dealt to it, so that they are neither stored nor shuffled before.
    """
    spark, columns = df.sparkSession, list(df.columns)
    if hubs is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_part)
        hubs = counts.select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("parts"))
    hubs = stored(hubs, f"{name}-hubs")
    if PART not in columns:
        joined = df.join(hubs, list(keys), "left")
        part = F.coalesce(F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int"), F.lit(0))
        df = joined.select(*columns, part.alias(PART))
    n = min(MOST, max(FEWEST, power_of_two((df.count() if n_rows is None else n_rows) / rows_per_shelf)))
    placed = df.withColumn(SHELF, _shelf(keys, n)).repartition(n, SHELF)
    placed = gather(placed) if gather else placed
    path = new_path(spark, name)
    with shuffles_go(spark):
        placed.sortWithinPartitions(SHELF, *keys).write.partitionBy(SHELF).parquet(path)
    return Shelves(spark.read.schema(placed.schema).parquet(path), keys, hubs, n)
