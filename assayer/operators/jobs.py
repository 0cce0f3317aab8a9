"""Folding a log of job changes into current job state.

A change has ``job_id``, ``seq`` (increasing per job), ``op`` ('create' or
'update'), ``changes`` (field name to value; a present key with a NULL value sets
NULL) and ``at``.  An update sets only its fields; without a job it does
nothing; a later create replaces everything.

The fold is a handful of ``max`` over structs led by ``seq``: combined before the
shuffle, mergeable in any order, the same in batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.skew import MIN_HEAVY_ROWS, join_lookup
from assayer.schema import JOB_TTL_SECONDS
from assayer.session import settled

FIELDS = ("status", "prompt", "result", "error")
DEFAULTS = {"status": "queued", "prompt": ""}
_PARTS = ["created", "last", *[f"set_{f}" for f in FIELDS]]


def _given(field: str) -> Column:
    return F.coalesce(F.map_contains_key("changes", F.lit(field)), F.lit(False))


def _initial(field: str) -> Column:
    value = F.try_element_at("changes", F.lit(field))
    if field in DEFAULTS:
        return F.when(_given(field), value).otherwise(F.lit(DEFAULTS[field]))
    return value


def fold_parts() -> list[Column]:
    """The aggregates of a fold, in the order of their names."""
    seq, at = F.col("seq"), F.col("at")
    create = F.struct(seq, at, *[_initial(f).alias(f) for f in FIELDS])
    parts = {
        "created": F.max(F.when(F.col("op") == "create", create)),
        "last": F.max(F.struct(seq, at)),
    }
    for f in FIELDS:
        change = F.struct(seq, F.try_element_at("changes", F.lit(f)).alias("value"))
        parts[f"set_{f}"] = F.max(F.when((F.col("op") == "update") & _given(f), change))
    return [parts[name].alias(name) for name in _PARTS]


def merge_parts() -> list[Column]:
    return [F.max(name).alias(name) for name in _PARTS]


def finish(folded: DataFrame, *keep: str) -> DataFrame:
    """Fold parts to job rows; keys that never saw a create are dropped."""
    created = F.col("created.seq")

    def value(f: str) -> Column:
        newer = F.col(f"set_{f}.seq") > created
        return F.when(newer, F.col(f"set_{f}.value")).otherwise(F.col(f"created.{f}"))

    return folded.where(F.col("created").isNotNull()).select(
        "job_id",
        *keep,
        *[value(f).alias(f) for f in FIELDS],
        F.col("created.at").alias("created_at"),
        F.col("last.at").alias("updated_at"),
    )


def job_state(changes: DataFrame) -> DataFrame:
    """Current row of every job that was created (no expiry)."""
    return finish(changes.groupBy("job_id").agg(*fold_parts()))


def slot_parts(changes: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """(job_id, slot, parts..., from_us, to_us): changes folded within TTL-long slots of time.

    Changes in one slot can never be a TTL apart, so a life is a row of slots. Parts of one slot may
    be merged in any order, which is what a stream keeps.
    """
    micros = F.unix_micros("at")
    slot = F.floor(micros / F.lit(ttl_seconds * 1_000_000)).alias("slot")
    return changes.groupBy("job_id", slot).agg(*fold_parts(), F.min(micros).alias("from_us"), F.max(micros).alias("to_us"))


def merged_slots(parts: DataFrame) -> DataFrame:
    """One row per job and slot, dealt by job: what looks for lives next finds its rows in place."""
    by_job = parts.repartition("job_id")
    return by_job.groupBy("job_id", "slot").agg(*merge_parts(), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"))


def state_of_slots(slots: DataFrame) -> DataFrame:
    """Current row of every job, whatever time lies between its changes."""
    return finish(slots.groupBy("job_id").agg(*merge_parts()))


def with_lives(slots: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Adds ``life``: gaps are looked for between slots only, and a job brings at most one row per
    slot of its history to the window."""
    by_slot = Window.partitionBy("job_id").orderBy("slot")
    gap = F.col("from_us") - F.lag("to_us").over(by_slot)
    starts = (F.coalesce(gap, F.lit(0)) >= ttl_seconds * 1_000_000).cast("int")
    return slots.withColumn("starts", starts).withColumn("life", F.sum("starts").over(by_slot)).drop("starts")


def lives_of_slots(slots: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """One row per life; expects one row per job and slot."""
    folded = with_lives(slots, ttl_seconds).groupBy("job_id", "life").agg(*merge_parts())
    return finish(folded, "life").withColumn("expires_at", _plus_seconds("updated_at", ttl_seconds))


def split_ended(parts: DataFrame, as_of: Column, ttl_seconds: int = JOB_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(merged slots of lives that still run at ``as_of``, rows of the lives that have ended).

    ``as_of`` is a time in microseconds up to which all changes have been seen. A life that has ended can't
    be continued: a later change begins a new one. A running life has a change within the last TTL, so
    its slots are looked for among the parts of jobs that have one, and only those are merged twice. The list
    of these jobs is :func:`settled`, so that its size is known before the join is planned.
    """
    begin = as_of - ttl_seconds * 1_000_000
    lives = with_lives(merged_slots(parts), ttl_seconds).groupBy("job_id", "life")
    ended = finish(lives.agg(*merge_parts(), F.max("to_us").alias("to_us")).where(F.col("to_us") <= begin))

    running = settled(parts.where(F.col("to_us") > begin).select(F.col("job_id").alias("_running")).distinct(), "running")
    candidates = parts.join(running, F.col("job_id").eqNullSafe(F.col("_running")), "left_semi")
    slots = with_lives(merged_slots(candidates), ttl_seconds)
    with_last = slots.withColumn("_last", F.max("to_us").over(Window.partitionBy("job_id", "life")))
    still = with_last.where(F.col("_last") > begin).drop("_last", "life")
    return still, ended


def job_lives(changes: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """One row per life of a job: it ends when no change arrives within the TTL."""
    return lives_of_slots(slot_parts(changes, ttl_seconds), ttl_seconds)


def live_jobs(changes: DataFrame, as_of: Column, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs not yet expired at ``as_of``, seen from the changes up to then."""
    seen = changes.where(F.col("at") <= as_of)
    return job_lives(seen, ttl_seconds).where(F.col("expires_at") > as_of)


def _plus_seconds(column: str, seconds: int) -> Column:
    return F.col(column) + F.make_dt_interval(secs=F.lit(float(seconds)))


def orphan_updates(changes: DataFrame, min_heavy_rows: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Updates that found no job: never created, or created only later."""
    creates = (
        changes.where(F.col("op") == "create").groupBy("job_id").agg(F.min("seq").alias("_born"))
    )
    updates = changes.where(F.col("op") == "update")
    joined = join_lookup(updates, creates, ["job_id"], "left", ["seq"], min_heavy_rows)
    return joined.where(F.col("_born").isNull() | (F.col("seq") < F.col("_born"))).drop("_born")


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """(status, n, mean_confidence) over job rows; confidence comes from ``result``."""
    confidence = F.get_json_object("result", "$.confidence_score").cast("double")
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence")
    )
