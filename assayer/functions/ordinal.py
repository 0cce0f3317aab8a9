"""Ordinal levels 0..4: contexts, names, clipping, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.schema import CONFLICT_LEVEL, N_LEVELS, STATES

TOP = N_LEVELS - 1


def context_index(task: Column, data: Column, tool: Column) -> Column:
    """Flat context number 0..124."""
    return (task * N_LEVELS * N_LEVELS + data * N_LEVELS + tool).cast("int")


def context_levels(ctx: Column) -> tuple[Column, Column, Column]:
    """The (task, data, tool) levels of a flat context number."""
    wide = N_LEVELS * N_LEVELS
    return (
        F.floor(ctx / wide).cast("int"),
        F.floor((ctx % wide) / N_LEVELS).cast("int"),
        (ctx % N_LEVELS).cast("int"),
    )


def state_name(level: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATES]), level)


def state_level(name: Column) -> Column:
    known = F.array(*[F.lit(s) for s in STATES])
    return F.nullif(F.array_position(known, name).cast("int"), F.lit(0)) - 1


def is_level(level: Column) -> Column:
    """True for 0..4, false for anything else including NULL."""
    return F.coalesce(level.between(0, TOP), F.lit(False))


def checked_level(level: Column, name: str, nullable: bool = False) -> Column:
    """The level itself; the job fails on the first value outside 0..4."""
    good = is_level(level)
    if nullable:
        good = good | level.isNull()
    message = F.concat(F.lit(f"{name} out of range 0..{TOP}: "), F.coalesce(level.cast("string"), F.lit("NULL")))
    return F.when(good, level).otherwise(F.raise_error(message).cast("int"))


def clip_level(level: Column) -> Column:
    """Clip to 0..4; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(level.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(TOP), level.cast("int"))))


def round_level(score: Column) -> Column:
    """Round half to even, then clip.  ``round`` would send 0.5 and 2.5 upwards."""
    return clip_level(F.bround(score, 0).cast("int"))


def is_conflict_state(level: Column) -> Column:
    return level >= CONFLICT_LEVEL


def good_probability(theta: Column) -> Column:
    """P(CERTAIN) + P(HIGH) of a distribution held as an array."""
    return F.get(theta, F.lit(0)) + F.get(theta, F.lit(1))


def first_argmax(values: Column) -> Column:
    """Index of the largest element; the lowest index wins ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def distribution_map(theta: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), theta)


def evidence_map(task: Column, data: Column, tool: Column) -> Column:
    """The evidence as a name-to-level map."""
    return F.create_map(
        F.lit("TaskStatus"), task, F.lit("DataQuality"), data, F.lit("ToolReliability"), tool
    )


def mixed_radix(bins: Column, base: int) -> Column:
    """Cell number of an array of bin numbers, first bin most significant."""
    return F.aggregate(bins, F.lit(0).cast("long"), lambda acc, b: acc * base + b)
