"""Plan steps: what is still to do, what comes next, what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text

NO_RESULTS = "No results were produced."  # fixed value

#: Step numbers whose lines are sorted and joined together.
PART_STEPS = 1000


def pending_steps(
    steps: DataFrame, completed: DataFrame, key: str = "run_id", step: str = "step", done: str = "task"
) -> DataFrame:
    """(run, pos, step): first occurrence of every step not yet completed.

    Steps and completed steps are equal when they match after collapsing white
    space and case.  Removing the completed and the repeated is one aggregate
    over both tables, combined before the shuffle, so a step repeated a billion
    times costs no more than any other.
    """
    planned = steps.select(
        key,
        text.normalise(F.col(step)).alias("norm"),
        F.struct(F.col("pos"), F.col(step).alias("step")).alias("planned"),
        F.lit(False).alias("done"),
    )
    finished = completed.select(
        key,
        text.normalise(F.col(done)).alias("norm"),
        F.lit(None).cast(planned.schema["planned"].dataType).alias("planned"),
        F.lit(True).alias("done"),
    )
    return (
        planned.unionByName(finished)
        .where(F.length("norm") > 0)
        .groupBy(key, "norm")
        .agg(F.min("planned").alias("planned"), F.max("done").alias("done"))
        .where(~F.col("done"))
        .select(key, "planned.pos", "planned.step")
    )


def next_step(pending: DataFrame, key: str = "run_id") -> DataFrame:
    """Head of the remaining plan per run and how many steps follow it."""
    return (
        pending.groupBy(key)
        .agg(F.min(F.struct("pos", "step")).alias("head"), (F.count(F.lit(1)) - 1).alias("n_after"))
        .select(key, "head.pos", "head.step", "n_after")
    )


def transcript(past: DataFrame, key: str = "run_id", part_steps: int = PART_STEPS) -> DataFrame:
    """(run, text): lines ``- task: result`` in step order, one text per run."""
    line = F.concat(F.lit("- "), F.col("task"), F.lit(": "), F.col("result"))
    return _joined(past.withColumn("_text", line), key, part_steps, "\n")


def result_summary(runs: DataFrame, past: DataFrame, key: str = "run_id", part_steps: int = PART_STEPS) -> DataFrame:
    """(run, text): the results joined by blanks and stripped, one text per run.

    A run without steps gets the fixed sentence.
    """
    whole = _joined(past.withColumn("_text", F.col("result")), key, part_steps, " ")
    found = whole.select(key, text.strip(F.col("text")).alias("text"))
    none = runs.select(key).distinct().join(whole.select(key), key, "left_anti")
    return found.unionByName(none.select(key, F.lit(NO_RESULTS).alias("text")))


def _joined(lines: DataFrame, key: str, part_steps: int, glue: str) -> DataFrame:
    """(run, text): the lines of a run in step order.

    Parts of ``part_steps`` step numbers are sorted and joined in parallel; only their texts
    meet in one row, which is the result itself. Equal positions follow their text.
    """
    part = F.floor(F.col("pos") / part_steps).alias("_part")
    sorted_lines = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("_text", F.lit("")).alias("_text"))))
    parts = lines.groupBy(key, part).agg(
        F.array_join(F.transform(sorted_lines, lambda e: e["_text"]), glue).alias("_joined")
    )
    sorted_parts = F.sort_array(F.collect_list(F.struct("_part", "_joined")))
    return parts.groupBy(key).agg(F.array_join(F.transform(sorted_parts, lambda e: e["_joined"]), glue).alias("text"))
