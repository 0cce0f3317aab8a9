"""Streaming twins of the batch operators.

Each function maps a streaming DataFrame to a streaming DataFrame; the caller
chooses source, sink, trigger and checkpoint folder.  Restart and per-session
resumption are the checkpoint's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import jobs, metrics
from assayer.operators.posterior import conjugate_counts, resolve
from assayer.schema import JOB_TTL_SECONDS


def running_counts(observations: DataFrame) -> DataFrame:
    """Conjugate counts so far; complete or update mode, at most 625 states.

    Addition commutes, so late rows need no watermark. A row out of range must not end the stream: it
    isn't counted here, and :func:`assayer.streaming.sinks.valid_and_quarantined` keeps it.
    """
    return conjugate_counts(observations, strict=False)


def score_evidence(evidence: DataFrame, table: DataFrame) -> DataFrame:
    """Resolve each arriving evidence row against a static posterior.

    A row with a level out of range meets no resolution, so its state is NULL; the stream goes on.
    """
    return resolve(evidence, table, strict=False)


def windowed_conflict_rate(
    resolved: DataFrame,
    width: str = "1 day",
    slide: str | None = None,
    lateness: str = "1 hour",
    low_confidence: float = 0.5,
) -> DataFrame:
    """Rates per event-time window; append mode emits a window once it is closed."""
    return metrics.conflict_rate(resolved.withWatermark("ts", lateness), width, slide, low_confidence)


def windowed_latency(spans: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """(window_start, bucket, n): a histogram per window in place of the values.

    Update mode reports open windows too, append mode only those that are closed.
    :func:`assayer.operators.metrics.histogram_quantile` reads any quantile from it.
    """
    window = F.window("ended", width)
    counted = metrics.log_histogram(spans.withWatermark("ended", lateness), "duration_ms", [window])
    return counted.select(F.col("window.start").alias("window_start"), "bucket", "n")


def windowed_evidence(evidence: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Rows per window and evidence triple."""
    return (
        evidence.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width), "task", "data", "tool")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "task", "data", "tool", "n")
    )


def expired_lives(
    changes: DataFrame, lateness: str = "1 hour", ttl_seconds: int = JOB_TTL_SECONDS
) -> DataFrame:
    """Lives of jobs that ran out; append mode emits each once it cannot change.

    ``session_window`` joins rows exactly one gap apart, while a key is gone at
    exactly its TTL: hence one microsecond less.
    """
    gap = f"{ttl_seconds - 1} seconds 999999 microseconds"
    life = F.session_window("at", gap)
    folded = changes.withWatermark("at", lateness).groupBy("job_id", life).agg(*jobs.fold_parts())
    return jobs.finish(folded)
