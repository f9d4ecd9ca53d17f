"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks in hash order. Time is counted in slots of one
block. While all sources last, block j of a source with weight w is released at ``floor(j / w)``
and due at ``ceil((j + 1) / w)``; each slot goes to the released block with the earliest
deadline. After any number of slots a source then has less than one block more or less than
its weight asks. Weights are taken as they are, in whole numbers without rounding.

When a source has no block left, the others share its slots by their weights: the ideal mix goes
on with steeper lines, and releases and deadlines follow from it. Nothing is left out.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from corpusloom.session import stored

BLOCK_DOCS = 32
# Blocks of a source in one row of the schedule.
PERIOD = 1_000
# Rows of one source numbered by one task.
STRETCH_ROWS = 50_000


def parts_of(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of a period, one at least, by largest remainders."""
    period = max(period, 8 * len(weights))
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (parts[s] - exact[s], s))
    while (missing := period - sum(parts.values())) > 0:
        for source in by_rest[:missing]:
            parts[source] += 1
    return parts


def schedule(parts: Mapping[str, int]) -> list[str]:
    """One period of whole parts: the source of each slot."""
    order = [""] * sum(parts.values())
    for source, slots in slots_of(parts, parts).items():
        for slot in slots.tolist():
            order[slot] = source
    return order


class _Ideal:
    """The slots all sources together have taken when each has had ``x`` times its weight, or all its
    blocks: a concave line in pieces, the smallest of ``done + total * x``."""

    def __init__(self, blocks: Mapping[str, int], whole: Mapping[str, int]):
        ends: dict[Fraction, list[str]] = {}
        for source, n in blocks.items():
            ends.setdefault(Fraction(n, whole[source]), []).append(source)
        done, total = 0, sum(whole[s] for s in blocks)
        self.ends, self.pieces = sorted(ends), [(done, total)]
        for end in self.ends:
            done += sum(blocks[s] for s in ends[end])
            total -= sum(whole[s] for s in ends[end])
            self.pieces.append((done, total))
        self.near = [float(e / self.ends[-1]) for e in self.ends]

    def floor_ceil(self, j: int, weight: int) -> tuple[int, int]:
        """Slots before ``x = j / weight``, rounded down and up."""
        x = j * self.ends[-1].denominator / (weight * self.ends[-1].numerator)
        first, last = bisect_left(self.near, x * (1 - 1e-9)), bisect_right(self.near, x * (1 + 1e-9))
        pieces = self.pieces[first : last + 1]
        return min(d + t * j // weight for d, t in pieces), min(d - (-t * j // weight) for d, t in pieces)


def slots_of(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, np.ndarray]:
    """The slot of every block of each source, earliest deadline first among released blocks. Equal
    deadlines go to the larger weight, then by name."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    common = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    ideal = _Ideal(blocks, whole)
    waiting: list[tuple[int, str, int, int]] = []
    ready: list[tuple[int, int, str, int]] = []
    slots = {s: np.empty(n, np.int64) for s, n in blocks.items()}

    def wait(source: str, j: int, release: int) -> tuple[int, int]:
        """The deadline of block ``j``, and the release of the next."""
        following, due = ideal.floor_ceil(j + 1, whole[source])
        heapq.heappush(waiting, (release, source, j, due))
        return due, following

    following = {s: wait(s, 0, 0)[1] for s in blocks}
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, source, j, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, -whole[source], source, j))
        _, _, source, j = heapq.heappop(ready)
        slots[source][j] = slot
        if j + 1 < blocks[source]:
            following[source] = wait(source, j + 1, following[source])[1]
    return slots


def plan(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[tuple]:
    """The slots of a mix: ``source, first_block, last_block, first_slot, period, slots``.

    Block ``first_block + i`` of a source stands in slot ``first_slot + slots[i]``; a row has
    ``period`` blocks, the last of a source may have fewer. Sources without a positive weight
    follow when all others are used up, evenly.
    """
    some = {s: n for s, n in blocks.items() if n > 0}
    weighted = {s: n for s, n in some.items() if weights.get(s, 0) > 0}
    rows, offset = [], 0
    for part, by in ((weighted, weights), ({s: n for s, n in some.items() if s not in weighted}, dict.fromkeys(some, 1))):
        if not part:
            continue
        for source, slots in slots_of(part, by).items():
            for first in range(0, len(slots), period):
                mine = slots[first : first + period]
                rows.append((source, first, first + len(mine) - 1, offset, period, mine))
        offset += sum(part.values())
    return rows


def default_weights(blocks: Mapping[str, int]) -> dict[str, float]:
    """The square root of each source's size: small sources count more than their share."""
    return {s: n**0.5 for s, n in blocks.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` and ``mix_position``, its place in the mix.

    ``weights`` are the target weights by ``source`` (default: ``default_weights``). Every row has
    its place: the mix keeps to the weights until a source is used up, and then to those of
    the others. Positions rise with the slots; the last block of a source may leave places
    empty. Null and empty sources are one source; rows with a null or repeated ``doc_id`` or
    a null text are rows like others; columns of the three names are set anew; an empty
    table gives no rows.

    Rows of a source are numbered in hash order in stretches, so a source with a third of all
    rows is many tasks. Row counts per source and the slot of each block meet the driver; ``period``
    is the number of blocks of a source whose slots are one row of the schedule.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    key = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = {r[0]: r[1] for r in docs.select(key.alias("source")).groupBy("source").count().collect()}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    told = plan(blocks, weights if weights is not None else default_weights(blocks), period)
    kinds = {"of": pa.string(), "first": pa.int64(), "last": pa.int64(), "offset": pa.int64(), "period": pa.int64()}
    kinds["slots"] = pa.list_(pa.int64())
    columns_told = zip(kinds.items(), zip(*told) if told else [()] * len(kinds))
    table = pa.table({name: pa.array(list(c), kind) for (name, kind), c in columns_told})
    phases = stored(spark.createDataFrame(table), "mix-slots")
    # Sources of one stretch need no row.
    long = [(s, 1 + n // STRETCH_ROWS) for s, n in sizes.items() if n >= STRETCH_ROWS]
    stretches = stored(spark.createDataFrame(long, "source string, stretches long"), "mix-stretches")
    # One struct keeps the columns of the input apart from those of the work.
    plain = [f.name for f in docs.schema if f.name in columns and isinstance(f.dataType, AtomicType)]
    rows = docs.select(
        F.struct(*columns).alias("row"),
        key.alias("source"),
        F.col("doc_id").alias("doc_id"),
        F.xxhash64(F.col("doc_id"), key).alias("order"),
        F.xxhash64(*plain).alias("tie"),
    )
    unit = F.shiftrightunsigned(F.col("order"), 11).cast("double") / float(1 << 53)
    rows = rows.join(stretches, "source", "left").withColumn("stretch", F.floor(unit * F.coalesce("stretches", F.lit(1))))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", "stretch").count()
    counts = counts.select("source", "stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "stretch").orderBy("order", "doc_id", "tie")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["source", "stretch"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("inside"))
    numbered = numbered.withColumn("block", F.floor(F.col("number") / block_docs))
    found = numbered.join(
        phases,
        (F.col("source") == F.col("of")) & (F.col("block") - F.col("block") % period == F.col("first")),
    )
    slot = F.col("offset") + F.get("slots", (F.col("block") - F.col("first")).cast("int"))
    found = found.withColumn("slot", slot.cast("long"))
    return found.select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        F.col("block").alias("mix_block"),
        F.col("slot").alias("mix_slot"),
        (F.col("slot") * block_docs + F.col("number") % block_docs).cast("long").alias("mix_position"),
    )


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of ``docs``, columns as they are, sorted into the order of the mix."""
    return mix(docs, weights, block_docs).orderBy("mix_position").select(*docs.columns)
