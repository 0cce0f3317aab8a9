"""Streams over the files of the shared tables, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.catalog import sql as q
from assayer.catalog.registry import query, r6
from assayer.functions.times import utc_instant
from assayer.operators import jobs, metrics, posterior
from assayer.plans.scoring import score_tool_outputs
from assayer.session import fresh_dir
from assayer.sources.readers import stream_table
from assayer.streaming import jobs as streams
from assayer.streaming.parts import SPANS, absorb, compact, ended_rows, job_fold
from assayer.streaming.sinks import append_to_table, snapshot_to_table, valid_and_quarantined

_PRIOR_ONLY = (q.PRIOR, q.ALPHA_OF_PRIOR, q.CUBE)


def _prior_resolutions(spark):
    return posterior.resolutions(posterior.prior_table(spark))


@query(
    q.with_parts(q.EVENT_EVIDENCE)
    + "SELECT task, data, tool, outcome, CAST(count(*) AS BIGINT) AS n FROM ee GROUP BY ALL"
)
def stream_counts(spark, sf_dir):
    arriving = fx.event_evidence_of(fx.table_stream(spark, sf_dir, "events"))
    return snapshot_to_table(streams.running_counts(arriving), "counts")


@query(
    q.with_parts(q.EVENT_EVIDENCE, *_PRIOR_ONLY)
    + """SELECT x.event_id, r.state, r.is_conflict, round(r.confidence, 6) AS confidence
    FROM ee x JOIN resolved r ON """ + q.SAME_EVIDENCE
)
def stream_scores(spark, sf_dir):
    arriving = fx.event_evidence_of(fx.table_stream(spark, sf_dir, "events"))
    scored = append_to_table(streams.score_evidence(arriving, _prior_resolutions(spark)), "scores")
    return scored.select("event_id", "state", "is_conflict", r6("confidence"))


@query(
    q.with_parts(q.O, q.KEYWORDS, *_PRIOR_ONLY)
    + """, w AS (
      SELECT date_trunc('day', x.ts) AS window_start, count(*) AS n, avg(CAST(r.is_conflict AS DOUBLE)) AS conflict_rate,
        avg(CASE WHEN r.good_probability < 0.5 THEN 1.0 ELSE 0.0 END) AS low_confidence_rate
      FROM kw x JOIN resolved r ON """ + q.SAME_EVIDENCE + """ GROUP BY ALL)
    SELECT CAST(epoch(window_start) AS BIGINT) AS window_s, CAST(n AS BIGINT) AS n,
      round(conflict_rate, 6) AS conflict_rate, round(low_confidence_rate, 6) AS low_confidence_rate
    FROM w"""
)
def stream_conflict_rate(spark, sf_dir):
    arriving = fx.with_result(fx.table_stream(spark, sf_dir, "events")).select(
        utc_instant(F.col("ts")).alias("ts"), "result"
    )
    scored = score_tool_outputs(arriving, _prior_resolutions(spark))
    windows = snapshot_to_table(streams.windowed_conflict_rate(scored), "rates", "update", ["window_start"])
    return windows.select(
        F.unix_seconds("window_start").alias("window_s"), "n", r6("conflict_rate"), r6("low_confidence_rate")
    )


@query(
    q.with_parts(q.EVENT_EVIDENCE)
    + """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_s, task, data, tool, CAST(count(*) AS BIGINT) AS n
    FROM ee GROUP BY ALL"""
)
def stream_evidence(spark, sf_dir):
    arriving = fx.event_evidence_of(fx.table_stream(spark, sf_dir, "events"))
    keys = ["window_start", "task", "data", "tool"]
    windows = snapshot_to_table(streams.windowed_evidence(arriving), "evidence", "update", keys)
    return windows.select(F.unix_seconds("window_start").alias("window_s"), "task", "data", "tool", "n")


@query(q.with_parts(q.SPANS) + "SELECT trace_id, name, duration_ms FROM spans")
def stream_spans(spark, sf_dir):
    arriving = fx.span_events_of(fx.table_stream(spark, sf_dir, "events"))
    parts = absorb(arriving, fresh_dir(spark, "spans"), SPANS)
    return metrics.split_spans(SPANS.merge(parts))[0].select("trace_id", "name", "duration_ms")


@query(q.with_parts(q.BROKEN_SPANS) + "SELECT * FROM span_states")
def span_states(spark, sf_dir):
    events = fx.broken_span_events_of(fx.table(spark, sf_dir, "events"))
    return metrics.span_states(metrics.span_parts(events))


@query(q.with_parts(q.BROKEN_SPANS) + "SELECT * FROM span_states")
def stream_span_states(spark, sf_dir):
    """Paired, open and unpaired spans of a source that grows between two runs of one stream."""
    events = fx.broken_span_events_of(fx.table(spark, sf_dir, "events"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).scalar()
    halves = [events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle)]
    folder = fresh_dir(spark, "span-states")
    for source in _growing(spark, halves):
        parts = absorb(source, folder, SPANS)
        compact(spark, folder, SPANS, source.schema)
    return metrics.span_states(SPANS.merge(parts))


def _growing(spark, portions):
    """A file stream after each portion has been added to its folder."""
    folder = fresh_dir(spark, "growing")
    for portion in portions:
        portion.write.mode("append").parquet(folder)
        yield stream_table(spark, portion.schema, folder)


@query(
    q.with_parts(q.EVENT_EVIDENCE)
    + "SELECT task, data, tool, outcome, CAST(count(*) AS BIGINT) AS n FROM ee GROUP BY ALL"
)
def stream_resumed_counts(spark, sf_dir):
    """Counts of a stream that is run again from its checkpoint after its source has grown."""
    rows = fx.event_evidence_of(fx.table(spark, sf_dir, "events"))
    folder = fresh_dir(spark, "resumed")
    for source in _growing(spark, [rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0")]):
        counts = snapshot_to_table(streams.running_counts(source), "counts", folder=folder)
    return counts


def _observed(spark, sf_dir):
    arriving = fx.poisoned_evidence_of(fx.table_stream(spark, sf_dir, "events"))
    return valid_and_quarantined(arriving, "observed", posterior.split_valid, posterior.conjugate_counts)


@query(
    q.with_parts(q.EVENT_EVIDENCE, q.POISONED)
    + """SELECT task, data, tool, outcome, CAST(count(*) AS BIGINT) AS n FROM pz
    WHERE task BETWEEN 0 AND 4 AND tool BETWEEN 0 AND 4 AND outcome BETWEEN 0 AND 4 GROUP BY ALL"""
)
def stream_valid_counts(spark, sf_dir):
    """Counts of the valid rows: each micro-batch's counts, added up."""
    counts, _ = _observed(spark, sf_dir)
    return counts.groupBy("task", "data", "tool", "outcome").agg(F.sum("n").alias("n"))


@query(
    q.with_parts(q.EVENT_EVIDENCE, q.POISONED)
    + """SELECT event_id, CASE WHEN task NOT BETWEEN 0 AND 4 THEN 'task'
      WHEN tool IS NULL THEN 'tool' ELSE 'outcome' END AS bad_column FROM pz
    WHERE task NOT BETWEEN 0 AND 4 OR tool IS NULL OR outcome NOT BETWEEN 0 AND 4"""
)
def stream_quarantine(spark, sf_dir):
    return _observed(spark, sf_dir)[1].select("event_id", "bad_column")


@query(
    q.with_parts(q.EVENT_EVIDENCE, q.POISONED, *_PRIOR_ONLY)
    + """SELECT x.event_id, r.state, round(r.confidence, 6) AS confidence, CAST(NULL AS VARCHAR) AS bad_column
    FROM pz x JOIN resolved r ON """ + q.SAME_EVIDENCE + """ WHERE x.task BETWEEN 0 AND 4
    UNION ALL SELECT event_id, NULL, NULL, 'task' FROM pz WHERE task NOT BETWEEN 0 AND 4"""
)
def stream_checked_scores(spark, sf_dir):
    """Scores of the valid evidence and the quarantined rows, together every row once."""
    table = _prior_resolutions(spark)
    scored, bad = valid_and_quarantined(
        fx.poisoned_evidence_of(fx.table_stream(spark, sf_dir, "events")),
        "scored",
        lambda rows: posterior.split_valid(rows, partial=True),
        lambda rows: posterior.resolve(rows, table).select("event_id", "state", r6("confidence")),
    )
    return scored.unionByName(bad.select("event_id", "bad_column"), allowMissingColumns=True)


@query(
    q.with_parts("days AS (SELECT date_trunc('day', ts) AS d, value FROM events)", q.histogram("days", "d", "value", 0.95))
    + "SELECT CAST(epoch(d) AS BIGINT) AS window_s, n, round(v, 6) AS latency_ms FROM placed"
)
def stream_latency(spark, sf_dir):
    """The 95th percentile of each day, the open one too, within half a per cent."""
    values = fx.table_stream(spark, sf_dir, "events").select(
        utc_instant(F.col("ts")).alias("ended"), F.col("value").alias("duration_ms")
    )
    counts = snapshot_to_table(streams.windowed_latency(values), "latency", "update", ["window_start", "bucket"])
    found = metrics.histogram_quantile(counts, ["window_start"])
    return found.select(F.unix_seconds("window_start").alias("window_s"), "n", r6("latency_ms"))


_JOB_COLUMNS = """job_id, status, prompt, nullif(result0, '') AS result, error,
  epoch_us(created_at) // 1000000 AS created_s, epoch_us(updated_at) // 1000000 AS updated_s"""


def _job_columns(rows):
    return rows.select(
        "job_id", "status", "prompt", "result", "error",
        F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s"),
    )


@query(q.with_parts(q.CHANGES, q.fold("ch", "job_id")) + f"SELECT {_JOB_COLUMNS} FROM folded")
def stream_job_state(spark, sf_dir):
    arriving = fx.job_changes_of(fx.table_stream(spark, sf_dir, "orders"))
    return _job_columns(jobs.state_of_slots(absorb(arriving, fresh_dir(spark, "jobs"), job_fold())))


@query(
    q.with_parts(q.CHANGES, q.LIVES, q.fold("lf", "job_id, life")) + f"SELECT {_JOB_COLUMNS} FROM folded"
)
def stream_job_lives(spark, sf_dir):
    """Lives of jobs whose changes arrive in three portions of time; what has ended leaves the state each time."""
    changes = fx.job_changes(spark, sf_dir)
    cuts = changes.agg(F.percentile_approx(F.unix_micros("at"), [0.4, 0.7]).alias("c")).first()["c"] or [0, 0]
    at = F.unix_micros("at")
    portions = [changes.where(at <= cuts[0]), changes.where((at > cuts[0]) & (at <= cuts[1])), changes.where(at > cuts[1])]
    folder, fold = fresh_dir(spark, "job-lives"), job_fold()
    for source, upto in zip(_growing(spark, portions), [*cuts, None], strict=True):
        parts = absorb(source, folder, fold)
        if upto is not None:
            compact(spark, folder, fold, source.schema, lambda slots, t=upto: jobs.split_ended(slots, F.lit(t)))
    living = jobs.lives_of_slots(fold.merge(parts)).drop("life", "expires_at")
    return _job_columns(living.unionByName(ended_rows(spark, folder, living.schema)))


@query(
    q.with_parts(q.CHANGES, q.LIVES, q.fold("lf", "job_id, life"))
    + f"""SELECT {_JOB_COLUMNS} FROM folded
    WHERE updated_at + INTERVAL 24 HOUR <= (SELECT max(tm) - INTERVAL 1 HOUR FROM ch)"""
)
def stream_expired_jobs(spark, sf_dir):
    arriving = fx.job_changes_of(fx.table_stream(spark, sf_dir, "orders"))
    return _job_columns(append_to_table(streams.expired_lives(arriving), "lives"))
