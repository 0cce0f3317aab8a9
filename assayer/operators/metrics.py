"""Metrics over the structured event log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.ordinal import distribution_map, evidence_map
from assayer.functions.times import duration_ms, log_text
from assayer.operators.quantiles import quantiles

CONFLICT_EVENT = "bayes.conflict_resolved"  # fixed value
STEP_EVENT = "executor.step"  # fixed value


def span_name() -> Column:
    """``x.start`` and ``x.end`` both belong to span ``x``."""
    return F.regexp_extract("event", r"^(.*)\.(?:start|end)$", 1)


def span_parts(events: DataFrame) -> DataFrame:
    """(trace_id, name, started, ended, n_starts, n_ends) of every span with an event, paired or not.

    A span has one start and one end; pairing them is an aggregate, not a join. Should a name
    recur within a trace, the row covers first start to last end and the counts say so.
    """
    starts, ends = F.col("event").endswith(".start"), F.col("event").endswith(".end")
    return (
        events.where(starts | ends)
        .groupBy("trace_id", span_name().alias("name"))
        .agg(
            F.min(F.when(starts, F.col("ts"))).alias("started"),
            F.max(F.when(ends, F.col("ts"))).alias("ended"),
            F.count_if(starts).alias("n_starts"),
            F.count_if(ends).alias("n_ends"),
        )
    )


def merged_spans(parts: DataFrame) -> DataFrame:
    """One row per span from parts of several batches."""
    return parts.groupBy("trace_id", "name").agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.sum("n_starts").alias("n_starts"),
        F.sum("n_ends").alias("n_ends"),
    )


def split_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paired with ``duration_ms``, open: started only, unpaired: ended only)."""
    started, ended = F.col("started").isNotNull(), F.col("ended").isNotNull()
    paired = spans.where(started & ended).withColumn("duration_ms", duration_ms(F.col("started"), F.col("ended")))
    return paired, spans.where(started & ~ended), spans.where(~started & ended)


def span_states(spans: DataFrame) -> DataFrame:
    """(trace_id, name, state, duration_ms, n_starts, n_ends): the three outputs of :func:`split_spans` in one."""
    named = [
        part.withColumn("state", F.lit(state))
        for part, state in zip(split_spans(spans), ("paired", "open", "unpaired"), strict=True)
    ]
    whole = named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)
    return whole.select("trace_id", "name", "state", "duration_ms", "n_starts", "n_ends")


def span_durations(events: DataFrame) -> DataFrame:
    """(trace_id, name, started, ended, n_starts, n_ends, duration_ms) of the paired spans."""
    return split_spans(span_parts(events))[0]


def rate_columns(low_confidence: float = 0.5) -> list[Column]:
    """Aggregates of a window of resolutions, for batch and stream."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("is_conflict").cast("double")).alias("conflict_rate"),
        F.avg((F.col("good_probability") < low_confidence).cast("double")).alias("low_confidence_rate"),
        F.avg("effective_sample_size").alias("mean_ess"),
    ]


def conflict_rate(
    resolved: DataFrame, width: str = "1 day", slide: str | None = None, low_confidence: float = 0.5
) -> DataFrame:
    """Conflict and low-confidence rate per time window of ``ts``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        resolved.groupBy(window)
        .agg(*rate_columns(low_confidence))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *_names())
    )


def _names() -> list[str]:
    return ["n", "conflict_rate", "low_confidence_rate", "mean_ess"]


#: Greatest relative error of a value that a histogram gives back.
RELATIVE_ERROR = 0.005
_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
#: Puts all buckets of positive numbers above those of zero, and far from any infinity.
_ORIGIN, _INFINITE = 1_000_000, 200_000


def log_bucket(x: Column) -> Column:
    """A whole number that does not fall as ``x`` grows: the power of a fixed base, with the sign, 0 for 0.

    NULL and NaN have none; infinite values have the outermost ones.
    """
    power = F.ceil(F.round(F.log(F.abs(x)) / F.lit(math.log(_GAMMA)), 9))
    place = F.when(F.abs(x) == float("inf"), F.lit(_INFINITE)).otherwise(power) + _ORIGIN
    return F.when(x == 0, F.lit(0)).when(~F.isnan(x), F.signum(x) * place).cast("long")


def bucket_value(bucket: Column) -> Column:
    """The value that stands for a bucket, within :data:`RELATIVE_ERROR` of all in it."""
    power = F.abs(bucket) - _ORIGIN
    size = F.when(power == _INFINITE, F.lit(float("inf"))).otherwise(F.pow(F.lit(_GAMMA), power) * (2 / (_GAMMA + 1)))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def log_histogram(rows: DataFrame, column: str, by: list) -> DataFrame:
    """(by, bucket, n): some 1,500 buckets for values from microseconds to days, whatever their number.

    Counts of several histograms add up to the histogram of all their rows, in any order.
    """
    return rows.groupBy(*by, log_bucket(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(histogram: DataFrame, by: list[str], fraction: float = 0.95) -> DataFrame:
    """(by, n, latency_ms): the value at or below which ``fraction`` of the rows lie, within the relative error.

    Counts of one bucket may stand in several rows, as parts of a stream leave them.
    """
    counts = histogram.where("bucket is not null").groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by).orderBy("bucket")
    upto, total = F.sum("n").over(order), F.sum("n").over(Window.partitionBy(*by))
    wanted = F.greatest(F.ceil(F.lit(fraction) * F.col("total")), F.lit(1))
    placed = counts.withColumns({"upto": upto, "total": total}).where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    return placed.select(*by, F.col("total").alias("n"), bucket_value(F.col("bucket")).alias("latency_ms"))


def latency_quantile(spans: DataFrame, by: list[str], fraction: float = 0.95) -> DataFrame:
    """Exact latency quantile per group (names or days: few groups)."""
    return quantiles(spans, "duration_ms", [fraction], by).withColumnRenamed("value", "latency_ms")


def step_events(
    resolved: DataFrame, flag: str = "is_conflict", logger: str = "resolver", level: str = "INFO"
) -> DataFrame:
    """(value): one JSON log line per row that is not flagged, the other half of :func:`conflict_events`.

    Both together hold every step once, so rates over all steps can be had from the log. A line
    has the task and the confidence; ``consistency`` (3 decimals) for answers, ``result`` for tools.
    """
    more = [F.round("consistency", 3).alias("consistency")] if "consistency" in resolved.columns else []
    more += ["result"] if "result" in resolved.columns else []
    payload = F.struct(
        log_text(F.col("ts")).alias("ts"),
        F.lit(level).alias("level"),
        F.lit(logger).alias("logger"),
        F.lit(STEP_EVENT).alias("event"),
        *(["trace_id"] if "trace_id" in resolved.columns else []),
        F.col("task_text").alias("task"),
        F.col("confidence"),
        *more,
    )
    return resolved.where(~F.coalesce(F.col(flag), F.lit(False))).select(F.to_json(payload).alias("value"))


def log_rates(events: DataFrame, width: str = "1 day", low_confidence: float = 0.5) -> DataFrame:
    """(window_start, n_steps, n_conflicts, conflict_rate, low_confidence_rate) from parsed log events.

    ``events`` is the first result of :func:`assayer.sources.readers.parse_log`; other events don't count.
    """
    confidence = F.try_element_at("fields", F.lit("confidence")).cast("double")
    conflict = (F.col("event") == CONFLICT_EVENT).cast("double")
    return (
        events.where(F.col("event").isin(CONFLICT_EVENT, STEP_EVENT))
        .groupBy(F.window("ts", width))
        .agg(
            F.count(F.lit(1)).alias("n_steps"),
            F.count_if(F.col("event") == CONFLICT_EVENT).alias("n_conflicts"),
            F.avg(conflict).alias("conflict_rate"),
            F.avg((confidence < low_confidence).cast("double")).alias("low_confidence_rate"),
        )
        .select(F.col("window.start").alias("window_start"), "n_steps", "n_conflicts", "conflict_rate", "low_confidence_rate")
    )


def conflict_events(
    resolved: DataFrame, flag: str = "is_conflict", logger: str = "resolver", level: str = "INFO"
) -> DataFrame:
    """(value): one JSON log line per flagged row, ready for a text or message sink.

    Expects the columns of :func:`assayer.operators.posterior.resolve` with ``ts``,
    ``trace_id`` and ``task_text``.  Answers are flagged by ``is_conflict``, tool
    outputs by ``gated``; the confidence is the most likely state's own.
    """
    own = "map_confidence" if "map_confidence" in resolved.columns else "confidence"
    payload = F.struct(
        log_text(F.col("ts")).alias("ts"),
        F.lit(level).alias("level"),
        F.lit(logger).alias("logger"),
        F.lit(CONFLICT_EVENT).alias("event"),
        F.col("trace_id"),
        F.col("task_text").alias("task"),
        evidence_map(F.col("task"), F.col("data"), F.col("tool")).alias("evidence"),
        F.col("state").alias("resolved_state"),
        F.col(own).alias("confidence"),
        F.array("credible_low", "credible_high").alias("credible_interval"),
        F.col("effective_sample_size"),
        distribution_map(F.col("theta")).alias("distribution"),
        *([F.round("consistency", 3).alias("consistency")] if "consistency" in resolved.columns else []),
    )
    return resolved.where(F.col(flag)).select(F.to_json(payload).alias("value"))
