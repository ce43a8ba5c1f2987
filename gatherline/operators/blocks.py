"""Running totals, numbers and bounded frames over groups of any size.

A window puts a whole group into one task. Groups of up to ``block_rows`` rows keep that plan. If a larger one is
found, the rows are ranged by group and order over as many tasks as they need, and a task's range is cut into blocks: a
block then holds a part of a group, or many small groups. Totals are carried from block to block by a table of one row a
block, and bounded frames get the last rows of the blocks before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.sources.scratch import written

#: Rows of a group that one task sorts, and of a block of a larger group, about.
BLOCK_ROWS = 2_000_000
#: Ranges for each core, if there are more blocks than that.
RANGES = 4


def exceeds(rows: DataFrame, group, block_rows: int) -> int:
    """All rows if some group has more than ``block_rows``, else 0; a null key is a group."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("every")).first()
    return sizes["every"] if (sizes["most"] or 0) > block_rows else 0


def ranged(rows: DataFrame, group, order, block_rows: int, every: int) -> DataFrame:
    """``rows``, written in ranges of group and order, with ``_at``, which numbers them in that order with gaps, and ``_block``.

    Small blocks share a range: Spark's driver samples rows for each range, and every range is a file.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(2, min(-(-every // block_rows), max(RANGES * cores, -(-every // BLOCK_ROWS))))
    names = [F.col(c) if isinstance(c, str) else c for c in (*group, *order)]
    placed = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_block", F.col("_at") - F.col("_at").bitwiseAND((1 << 33) - 1) % block_rows)


def _carried(placed: DataFrame, group, weight: Column) -> DataFrame:
    """``*_g, _b, _carry, _all`` of each block of a group that has several: the weight before it, and the group's.

    A block holds several groups, but at most one that began earlier and one that goes on, so there are no more than
    two rows a block: a table for broadcasting.
    """
    blocks = placed.groupBy(*group, "_block").agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*group)
    before = F.sum("w").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumns({"_parts": F.count("*").over(whole), "_carry": F.coalesce(before, F.lit(0)), "_all": F.sum("w").over(whole)})
    return blocks.where("_parts > 1").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_block").alias("_b"), "_carry", "_all")


def _with_totals(placed: DataFrame, group, weight: Column, before: str, total: str) -> DataFrame:
    carried = F.broadcast(_carried(placed, group, weight))
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    here = Window.partitionBy(*group, "_block")
    inside = F.coalesce(F.sum(weight).over(here.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumns({before: inside, total: F.sum(weight).over(here)}).join(carried, same, "left")
    out = out.withColumns({before: F.col(before) + F.coalesce("_carry", F.lit(0)), total: F.coalesce("_all", total)})
    return out.drop("_b", "_carry", "_all", *[f"_g{i}" for i in range(len(group))])


def running(rows: DataFrame, group, order, weight: Column | None = None, before: str = "_before", total: str = "_total", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``before``, the sum of ``weight`` over a group's rows before this one, and ``total``, that over all its rows.

    Without ``weight`` rows are counted, so ``before`` is a row's place, from 0 and without gaps. ``order``: names or
    columns; rows that tie in it follow in any one order. ``weight`` has no nulls.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    every = exceeds(rows, group, block_rows)
    if every:
        return _with_totals(ranged(rows, group, order, block_rows, every), group, weight, before, total).drop("_at", "_block")
    whole = Window.partitionBy(*group)
    inside = F.coalesce(F.sum(weight).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({before: inside, total: F.sum(weight).over(whole)})


def placed_blocks(rows: DataFrame, group, order, block_rows: int, every: int) -> DataFrame:
    """``rows``, written with ``_at`` and ``_block`` as ``ranged`` gives them, ``_place`` in the group and the group's ``_size``."""
    return written(_with_totals(ranged(rows, group, order, block_rows, every), group, F.lit(1).cast("bigint"), "_place", "_size"))


def halo(placed: DataFrame, group, depth: int) -> DataFrame:
    """For each block that doesn't begin its group the last ``depth`` rows before it, with its ``_block``.

    Places are cut into stretches of ``depth``, of which a halo touches two at most, so no more than two rows a block are
    broadcast, whatever the depth.
    """
    stretch = lambda p: F.floor(p / max(depth, 1))
    begin = placed.groupBy(*group, "_block").agg(F.min("_place").alias("_first")).where("_first > 0")
    asked = begin.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_block").alias("_to"), "_first", F.explode(F.sequence(stretch(F.greatest(F.col("_first") - depth, F.lit(0))), stretch(F.col("_first") - 1))).alias("_stretch"))
    same = (stretch(F.col("_place")) == F.col("_stretch")) & F.col("_place").between(F.col("_first") - depth, F.col("_first") - 1)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(F.broadcast(asked), same).withColumn("_block", F.col("_to")).select(*placed.columns)


def framed(rows: DataFrame, group, order, depth: int, columns: Callable[[Window], dict[str, Column]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``columns(window)``, whose frames reach ``depth`` rows back at most and none ahead.

    Of large groups every block gets the last ``depth`` rows before it as a halo.
    """
    every = exceeds(rows, group, block_rows)
    if not every:
        return rows.withColumns(columns(Window.partitionBy(*group).orderBy(*order)))
    placed = placed_blocks(rows, group, order, block_rows, every)
    both = placed.withColumn("_halo", F.lit(False)).unionByName(halo(placed, group, depth).withColumn("_halo", F.lit(True)))
    out = both.withColumns(columns(Window.partitionBy(*group, "_block").orderBy("_at")))
    return out.where("NOT _halo").drop("_halo", "_at", "_block", "_place", "_size")


def quantiles(rows: DataFrame, group, value: str, shares: list[float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``*group, q``: exact quantiles of ``value``, linearly interpolated, in the order of ``shares``; nulls don't count.

    Equal values are merged first; then the values whose places the quantiles name are picked, two for each, so no
    aggregation holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = running(counts, group, ["_v"], F.col("_c"), block_rows=block_rows)
    place = lambda s: F.lit(float(s)) * (F.col("_total") - 1)
    inside = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_c"))
    ends = [e for s in shares for e in (F.max(F.when(inside(F.floor(place(s))), F.col("_v"))), F.max(F.when(inside(F.ceil(place(s))), F.col("_v"))))]
    wanted = F.lit(False)
    for s in shares:
        wanted = wanted | inside(F.floor(place(s))) | inside(F.ceil(place(s)))
    found = placed.where(wanted).groupBy(*group).agg(F.max("_total").alias("_total"), *[e.alias(f"_e{i}") for i, e in enumerate(ends)])
    between = [F.col(f"_e{2 * i}") + (place(s) - F.floor(place(s))) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) for i, s in enumerate(shares)]
    return found.select(*group, F.array(*between).alias("q"))
