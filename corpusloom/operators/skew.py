"""Joins and orderings that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

# A key below this many rows fits any task and is left alone; a larger one is cut into
# pieces of about this size. So at most rows / HOT_ROWS keys are hot.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``key, salts`` of every value with ``min_rows`` rows or more, counted with map-side
    combine, and the number of pieces it is cut into."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") >= min_rows)
        .select(key, F.ceil(F.col("_rows") / min_rows).cast("int").alias("salts"))
    )


def salted_join(
    big: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``big JOIN keyed`` on ``key`` where ``big`` may have hot keys.

    Rows of a hot key are spread over as many tasks as its size asks for and only the hot
    rows of ``keyed`` are repeated to meet them; every other row keeps salt 0. The salt is
    a hash of the row, so a task that is run again sends its rows to the same places.
    ``hot(key, salts)`` can be passed where the counts are known already. ``how`` is one of
    inner, left, left_semi, left_anti.
    """
    hot = (hot if hot is not None else hot_keys(big, key, min_rows)).select(
        F.col(key).alias("_hot"), F.col("salts").alias("_salts")
    )
    # Written first: read twice, and of a known size, so Spark broadcasts it while it is small.
    hot = stored(hot, "hot-keys")
    spread = F.when(
        F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int")
    ).otherwise(F.lit(0))
    repeat = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    left = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", spread)
    right = keyed.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(repeat))
    drop = ("_hot", "_salts")
    return left.drop(*drop).join(right.drop(*drop), [key, "_salt"], how).drop("_salt")


def top_k(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    k: Column | int,
    most: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows per group. Where ``k`` is a column, ``most`` is a constant at
    least as large; a constant is applied inside each task before the shuffle, so a
    group of any size sends ``k`` rows per task."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if most is not None:
        ranked = ranked.filter(F.col(rank) <= most)
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def next_row(
    df: DataFrame, group: str, order: str, values: list[str], prefix: str = "next_", span: int = 1000
) -> DataFrame:
    """``values`` of the next row of the group, without one task per group.

    The group is cut into stretches of ``span`` order values. Inside a stretch this is
    an ordinary ``lead``; only the first row of each stretch goes on to a second pass,
    which hands it to the last row of the stretch before.
    """
    stretch = F.floor(F.col(order) / F.lit(span))
    inside = Window.partitionBy(group, "_stretch").orderBy(order)
    packed = F.struct(*[F.col(v) for v in values])
    rows = (
        df.withColumn("_stretch", stretch)
        .withColumn("_next", F.lead(packed).over(inside))
        .withColumn("_last", F.lead(F.lit(True), 1, False).over(inside) == F.lit(False))
    )
    heads = (
        df.withColumn("_stretch", stretch)
        .groupBy(group, "_stretch")
        .agg(F.min_by(packed, F.col(order)).alias("_head"))
        .withColumn("_head", F.lead("_head").over(Window.partitionBy(group).orderBy("_stretch")))
        .filter(F.col("_head").isNotNull())
    )
    joined = rows.join(heads, [group, "_stretch"], "left")
    follower = F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_next"))
    return joined.select(
        *[joined[c] for c in df.columns],
        *[follower[v].alias(prefix + v) for v in values],
    )


def numbered(df: DataFrame, key: Column, out: str = "row_no", rows: int = HOT_ROWS) -> DataFrame:
    """Gap-free numbers from 1 in the order ``(md5 of key, key)``.

    Rows are numbered inside stretches of about ``rows`` rows, cut by the md5, then shifted by
    the rows of the stretches before; only the list of stretches passes one task.
    """
    stretches = 1 + df.count() // rows
    place = F.conv(F.substring(F.md5("_key"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    buckets = df.withColumn("_key", key).withColumn("_bucket", F.floor(place * stretches))
    inside = Window.partitionBy("_bucket").orderBy(F.md5("_key"), "_key")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        buckets.withColumn("_in_bucket", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(out, (F.col("_in_bucket") + F.col("_offset")).cast("long"))
        .drop("_key", "_bucket", "_in_bucket", "_offset")
    )
