"""Exact order statistics of a column too large to sort or collect.

``percentile`` keeps every distinct value of a group in one task.  Here each pass
counts values per bin, finds the bin that holds the wanted rank, and the next
pass looks inside that bin only:

1. by power of two (at most 4,403 bins whatever the values),
2. by 65,536 equal parts of what is left, repeated while a bin holds more than
   ``EXACT_ROWS`` rows and more than one value,
3. by value, with few enough left.

A double has 2^52 values per power of two, so step 2 ends after three rounds at
most.  Every pass is a map-side combined count.  A global sort is never needed, and the
answer is exact, ties included.  Passes run when the function is called, as in any iterative
fit.  The values are written once, and what each pass finds is a table: there may be as many
groups and ranks as there are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import release, scoped, settled

PARTS = 65_536
EXACT_ROWS = 1_000_000
#: Up to so many bins are broadcast; more are joined by their group.
BROADCAST_BINS = 100_000


def _octave(x: Column) -> Column:
    """A non-decreasing integer function of any double: signed power of two."""
    power = F.floor(F.greatest(F.lit(-1100.0), F.least(F.log2(F.abs(x)), F.lit(1100.0))))
    size = F.when(x == 0, F.lit(0)).otherwise(power + 1101)
    return (F.signum(x) * size).cast("int")


def _part(x: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal parts of [low, high] holds x; non-decreasing in x."""
    width = high - low
    return F.when(width > 0, F.least(F.floor((x - low) / width * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")


def _narrow(histogram: DataFrame, bin_col: str, *keep: str) -> DataFrame:
    """From counts per bin to the one bin per (group, slot) that holds its rank."""
    order = Window.partitionBy("group", "slot").orderBy(bin_col)
    before = F.sum("n").over(order) - F.col("n")
    return (
        histogram.withColumn("before", before)
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        .select("group", "slot", (F.col("rank") - F.col("before")).alias("rank"), "n", *keep)
    )


def _crowded(found: DataFrame) -> bool:
    """Whether a bin is still too full to be settled by value."""
    return not found.where((F.col("n") > EXACT_ROWS) & (F.col("low") < F.col("high"))).isEmpty()


def _inside(values: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in the bins still of interest."""
    bins = found.drop("n").withColumnRenamed("group", "_group")
    if found.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS:
        bins = F.broadcast(bins)
    match = (
        F.col("group").eqNullSafe(F.col("_group"))
        & (F.col("x") >= F.col("low"))
        & (F.col("x") <= F.col("high"))
    )
    return values.join(bins, match).drop("_group")


def order_statistics(df: DataFrame, column: str, slots: Column, by: list[str]) -> DataFrame:
    """(by, slot, v): the values at the wanted 0-based ranks, per group.

    ``slots`` is an array of structs with a ``rank``, written in terms of the
    group size ``size``.  NULL and NaN are left out.
    """
    group = F.struct(*by).alias("group") if by else F.lit(0).alias("group")
    values = df.select(group, F.col(column).alias("v"), F.col(column).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    counted = [F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    with scoped() as keep:
        values = settled(values, "values")
        octaves = values.withColumn("part", _octave(F.col("x"))).groupBy("group", "part").agg(*counted)
        wanted = (
            octaves.withColumn("size", F.sum("n").over(Window.partitionBy("group")))
            .withColumn("slot", F.explode(slots))
            .withColumn("rank", F.col("slot.rank"))
        )
        found = settled(_narrow(wanted, "part", "low", "high"), "bins")
        while _crowded(found):
            part = _part(F.col("x"), F.col("low"), F.col("high"))
            parts = (
                _inside(values, found)
                .withColumn("part", part)
                .groupBy("group", "slot", "rank", "part")
                .agg(*counted)
            )
            before, found = found, settled(_narrow(parts, "part", "low", "high"), "bins")
            release(before)
        distinct = (
            _inside(values, found).groupBy("group", "slot", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
        )
        result = keep(settled(_narrow(distinct, "v", "v"), "order-statistics"))
    return result.select(*[F.col(f"group.{c}") for c in by], "slot", "v")


def quantiles(df: DataFrame, column: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, fraction, value): exact quantiles, linear between neighbouring ranks."""
    by = by or []

    def neighbours(fraction: float) -> list[Column]:
        at = (F.col("size") - 1) * F.lit(float(fraction))
        below = F.floor(at)
        above = F.least(below + 1, F.col("size") - 1)
        return [
            F.struct(
                F.lit(float(fraction)).alias("fraction"),
                F.lit(side).alias("side"),
                rank.alias("rank"),
                (at - below).alias("weight"),
            )
            for side, rank in ((0, below), (1, above))
        ]

    slots = F.array(*[s for f in fractions for s in neighbours(f)])
    ends = order_statistics(df, column, slots, by)
    def end(side: int) -> Column:
        return F.max(F.when(F.col("slot.side") == side, F.col("v").cast("double")))

    low, high, weight = F.col("low"), F.col("high"), F.col("weight")
    keys = [F.col("slot.fraction").alias("fraction"), F.col("slot.weight").alias("weight")]
    both = ends.groupBy(*by, *keys).agg(end(0).alias("low"), end(1).alias("high"))
    # no arithmetic where none is needed: an infinite neighbour must not spoil an exact hit
    value = F.when((weight == 0) | (low == high), low).otherwise(low + (high - low) * weight)
    return both.select(*by, "fraction", value.alias("value"))


def split_ordered(df: DataFrame, order_key: str, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(first int(fraction x n) rows by a unique numeric key, the rest).

    The cut is one value, so both parts are plain filters that reach the scan.
    """
    rank = F.floor(F.lit(float(fraction)) * F.col("size"))
    cut = order_statistics(df, order_key, F.array(F.struct(rank.alias("rank"))), []).first()
    if cut is None:  # no rows, or a fraction of 1
        return df, df.where(F.lit(False))
    return df.where(F.col(order_key) < cut["v"]), df.where(F.col(order_key) >= cut["v"])


def bin_of(value: Column, edges: list[Column]) -> Column:
    """Number of edges at or below the value: ``edge[i-1] <= x < edge[i]``."""
    total = F.lit(0)
    for edge in edges:
        total = total + (value >= edge).cast("int")
    return total
