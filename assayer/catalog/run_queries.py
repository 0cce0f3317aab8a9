"""Plan clean-up, run folding, job folding, event metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.catalog import sql as q
from assayer.catalog.registry import query, r6
from assayer.functions.times import log_text, utc_instant
from assayer.operators import jobs, json_objects, metrics, posterior, runs, steps
from assayer.plans.scoring import score_tool_outputs
from assayer.sources.readers import parse_log

_PLAN = (q.O, q.STEPS)
_PRIOR_ONLY = (q.PRIOR, q.ALPHA_OF_PRIOR, q.CUBE)
_KEYWORDS = (q.O, q.KEYWORDS, *_PRIOR_ONLY)


def _prior_resolutions(spark):
    return posterior.resolutions(posterior.prior_table(spark))


def _pending(spark, sf_dir):
    return steps.pending_steps(
        fx.planned_steps(spark, sf_dir), fx.past_steps(spark, sf_dir)
    )


@query(q.with_parts(*_PLAN) + "SELECT * FROM pending")
def pending_steps(spark, sf_dir):
    return _pending(spark, sf_dir)


@query(
    q.with_parts(*_PLAN)
    + """SELECT run_id, min(pos) AS pos, arg_min(step, pos) AS step, CAST(count(*) - 1 AS BIGINT) AS n_after
    FROM pending GROUP BY run_id"""
)
def next_step(spark, sf_dir):
    return steps.next_step(_pending(spark, sf_dir))


_DECIDED = """,
d AS (SELECT DISTINCT user_id AS run_id FROM events),
prop0 AS (
  SELECT run_id, unnest([0, 1]) AS pos, unnest(['check  CLICK 0', 'Check view 9']) AS step,
    unnest(['check click 0', 'check view 9']) AS norm FROM d WHERE run_id % 5 = 1),
prop AS (
  SELECT * FROM prop0 q WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.run_id = q.run_id AND p.norm = q.norm)),
routed AS (
  SELECT run_id, CASE run_id % 5 WHEN 4 THEN 'unparseable' WHEN 1 THEN 'plan' ELSE 'response' END AS action,
    CASE WHEN run_id % 5 IN (0, 2) THEN 'decision'
      WHEN run_id % 5 = 3 THEN 'summary'
      WHEN run_id % 5 = 1 AND run_id IN (SELECT run_id FROM prop) THEN 'decision'
      WHEN run_id IN (SELECT run_id FROM pending) THEN 'current_plan'
      ELSE 'summary' END AS source,
    CASE run_id % 5 WHEN 0 THEN 'run ' || run_id || ' is done' WHEN 2 THEN 'fine as it is' END AS response
  FROM d),
going AS (
  SELECT *, CASE WHEN action = 'response' OR source = 'summary' THEN 'END' ELSE 'executor' END AS next FROM routed)
"""


def _routed(spark, sf_dir):
    decided = json_objects.decisions(json_objects.recover_json(fx.run_decisions(spark, sf_dir)))
    proposed = steps.pending_steps(json_objects.decided_steps(decided), fx.past_steps(spark, sf_dir))
    current = _pending(spark, sf_dir)
    return runs.replan(decided, proposed, current), proposed, current


@query(q.with_parts(*_PLAN) + _DECIDED + "SELECT run_id, action, source, response, next FROM going")
def replan_routes(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


@query(
    q.with_parts(*_PLAN) + _DECIDED
    + """SELECT g.run_id, g.source, CAST(p.pos AS BIGINT) AS pos, p.step FROM going g JOIN prop p USING (run_id)
    WHERE next = 'executor' AND source = 'decision'
    UNION ALL SELECT g.run_id, g.source, p.pos, p.step FROM going g JOIN pending p USING (run_id)
    WHERE next = 'executor' AND source = 'current_plan'"""
)
def next_plan(spark, sf_dir):
    return runs.next_plan(*_routed(spark, sf_dir))


@query(
    q.with_parts(*_PLAN) + _DECIDED
    + """, summaries AS (
      SELECT run_id, string_agg(result, ' ' ORDER BY pos) AS text FROM past GROUP BY run_id
      UNION ALL SELECT run_id, 'No results were produced.' FROM d
      WHERE run_id NOT IN (SELECT run_id FROM past))
    SELECT run_id, response AS text FROM going WHERE next = 'END' AND source = 'decision'
    UNION ALL SELECT s.run_id, s.text FROM summaries s JOIN going g USING (run_id)
    WHERE g.next = 'END' AND g.source = 'summary'"""
)
def final_responses(spark, sf_dir):
    summaries = steps.result_summary(fx.runs(spark, sf_dir), fx.past_steps(spark, sf_dir))
    return runs.final_responses(_routed(spark, sf_dir)[0], summaries)


def _scored_past(spark, sf_dir):
    return score_tool_outputs(
        fx.executed_steps(spark, sf_dir).withColumnRenamed("task", "task_text"), _prior_resolutions(spark)
    ).drop("task").withColumnRenamed("task_text", "task")


@query(
    q.with_parts(*_KEYWORDS, q.STEPS)
    + """SELECT d.run_id, CAST(count(p.pos) AS BIGINT) AS steps_executed,
      round(coalesce(arg_max(CASE WHEN x.gated THEN r.confidence ELSE 1.0 END, p.pos), 1.0), 6) AS confidence
    FROM (SELECT DISTINCT user_id AS run_id FROM events) d
    LEFT JOIN steps p USING (run_id)
    LEFT JOIN kw x ON x.event_id = p.pos
    LEFT JOIN resolved r ON """ + q.SAME_EVIDENCE + " GROUP BY d.run_id"
)
def run_summary(spark, sf_dir):
    folded = runs.run_summary(fx.runs(spark, sf_dir), _scored_past(spark, sf_dir))
    return folded.withColumn("confidence", r6("confidence"))


@query(
    q.with_parts(*_KEYWORDS, q.STEPS)
    + """, log AS (
      SELECT user_id AS run_id, event_id AS pos, event_type = 'error' AS failed, k % 4 AS way FROM o),
    good AS (
      SELECT l.run_id, l.pos, s.result, CASE WHEN x.gated THEN r.confidence ELSE 1.0 END AS confidence
      FROM log l JOIN steps s ON s.run_id = l.run_id AND s.pos = l.pos
      JOIN kw x ON x.event_id = l.pos JOIN resolved r ON """ + q.SAME_EVIDENCE + """
      WHERE NOT l.failed),
    fine AS (
      SELECT run_id, CAST(count(*) AS BIGINT) AS n, arg_max(confidence, pos) AS confidence,
        string_agg(result, ' ' ORDER BY pos) AS text FROM good GROUP BY run_id),
    last AS (SELECT run_id, arg_max(failed, pos) AS failed, arg_max(way, pos) AS way FROM log GROUP BY run_id),
    told AS (
      SELECT *, CASE WHEN NOT failed THEN 'ok' WHEN way = 2 THEN 'raised' ELSE 'unavailable' END AS outcome FROM last)
    SELECT t.run_id, outcome,
      CASE outcome WHEN 'ok' THEN f.text WHEN 'unavailable' THEN '' END AS response,
      CASE outcome WHEN 'ok' THEN f.n WHEN 'unavailable' THEN 0 END AS steps_executed,
      CASE outcome WHEN 'ok' THEN round(f.confidence, 6) WHEN 'unavailable' THEN 0.0 END AS confidence,
      CASE outcome WHEN 'unavailable' THEN '""" + runs.UNAVAILABLE_ERROR + """'
        WHEN 'raised' THEN 'ValueError: value out of range' END AS error
    FROM told t LEFT JOIN fine f USING (run_id)"""
)
def run_results(spark, sf_dir):
    """Steps and errors of each run, the last of which decides."""
    done = fx.executed_well(spark, sf_dir)
    scored = score_tool_outputs(done.withColumnRenamed("task", "task_text"), _prior_resolutions(spark)).drop("task")
    started = fx.runs(spark, sf_dir)
    results = runs.run_results(
        started, scored, fx.run_errors(spark, sf_dir), steps.result_summary(started, done)
    )
    return results.withColumn("confidence", r6("confidence"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN '(no result produced for: Price order ' || o_orderkey || ')'
      ELSE 'order of ' || o_orderpriority END AS answer FROM orders"""
)
def default_answers(spark, sf_dir):
    rows = fx.empty_answers(spark, sf_dir)
    return rows.select("o_orderkey", runs.default_answer(F.col("answer"), F.col("task")).alias("answer"))


@query(
    q.with_parts(*_PLAN)
    + """SELECT run_id, string_agg('- ' || step || ': ' || result, chr(10) ORDER BY pos) AS text
    FROM steps GROUP BY run_id"""
)
def transcript(spark, sf_dir):
    return steps.transcript(fx.executed_steps(spark, sf_dir))


@query(
    q.with_parts(*_PLAN)
    + "SELECT run_id, string_agg(result, ' ' ORDER BY pos) AS text FROM steps GROUP BY run_id"
)
def result_summary(spark, sf_dir):
    return steps.result_summary(fx.runs(spark, sf_dir), fx.executed_steps(spark, sf_dir))


@query(
    q.with_parts(*_PLAN)
    + """SELECT d.run_id, CASE WHEN d.run_id % 7 = 0 THEN 'END'
      WHEN d.run_id IN (SELECT run_id FROM pending) THEN 'executor' ELSE 'END' END AS next
    FROM (SELECT DISTINCT user_id AS run_id FROM events) d"""
)
def run_routes(spark, sf_dir):
    counted = _pending(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    state = fx.runs(spark, sf_dir).join(counted, "run_id", "left")
    response = F.when(F.col("run_id") % 7 == 0, F.lit("done"))
    return state.select("run_id", runs.route(response, F.col("n")).alias("next"))


_JOB_COLUMNS = """job_id, status, prompt, nullif(result0, '') AS result, error,
  epoch_us(created_at) // 1000000 AS created_s, epoch_us(updated_at) // 1000000 AS updated_s"""


def _job_columns(rows, *more):
    return rows.select(
        "job_id", *more, "status", "prompt", "result", "error",
        F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s"),
    )


@query(q.with_parts(q.CHANGES, q.fold("ch", "job_id")) + f"SELECT {_JOB_COLUMNS} FROM folded")
def job_state(spark, sf_dir):
    return _job_columns(jobs.job_state(fx.job_changes(spark, sf_dir)))


@query(
    q.with_parts(q.CHANGES, q.LIVES, q.fold("lf", "job_id, life"))
    + f"SELECT {_JOB_COLUMNS}, life FROM folded"
)
def job_lives(spark, sf_dir):
    return _job_columns(jobs.job_lives(fx.job_changes(spark, sf_dir)), "life")


@query(
    q.with_parts(q.CHANGES)
    + """, last AS (SELECT max(tm) - INTERVAL 40 DAY AS as_of FROM ch),
    seen AS (SELECT ch.* FROM ch, last WHERE tm <= as_of),
    gaps AS (
      SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY job_id ORDER BY seq) >= INTERVAL 24 HOUR
        THEN 1 ELSE 0 END AS starts FROM seen),
    lf AS (SELECT *, sum(starts) OVER (PARTITION BY job_id ORDER BY seq) AS life FROM gaps),"""
    + q.fold("lf", "job_id, life")
    + f"SELECT {_JOB_COLUMNS} FROM folded, last WHERE updated_at + INTERVAL 24 HOUR > as_of"
)
def live_jobs(spark, sf_dir):
    changes = fx.job_changes(spark, sf_dir)
    as_of = changes.agg((F.max("at") - F.expr("interval 40 days")).alias("t")).scalar()
    return _job_columns(jobs.live_jobs(changes, as_of))


@query(
    q.with_parts(q.CHANGES)
    + """SELECT job_id, CAST(seq AS BIGINT) AS seq, status FROM ch
    LEFT JOIN (SELECT job_id, min(seq) AS born FROM ch WHERE op = 'create' GROUP BY job_id) USING (job_id)
    WHERE op = 'update' AND (born IS NULL OR seq < born)"""
)
def orphan_updates(spark, sf_dir):
    found = jobs.orphan_updates(fx.job_changes(spark, sf_dir))
    return found.select("job_id", "seq", F.try_element_at("changes", F.lit("status")).alias("status"))


@query(
    q.with_parts(q.CHANGES, q.fold("ch", "job_id"))
    + """SELECT status, CAST(count(*) AS BIGINT) AS n,
      round(avg(CAST(json_extract_string(nullif(result0, ''), '$.confidence_score') AS DOUBLE)), 6) AS mean_confidence
    FROM folded GROUP BY status"""
)
def job_outcomes(spark, sf_dir):
    found = jobs.job_outcomes(jobs.job_state(fx.job_changes(spark, sf_dir)))
    return found.withColumn("mean_confidence", r6("mean_confidence"))


@query(
    """SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 <> 2 AS unavailable, CAST(count(*) AS BIGINT) AS n
    FROM events WHERE event_type = 'error' GROUP BY 1"""
)
def error_classes(spark, sf_dir):
    return runs.error_classes(fx.errors(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 < 3")
def blank_prompts(spark, sf_dir):
    return runs.split_prompts(fx.prompts(spark, sf_dir))[1].select("o_orderkey")


@query(
    """SELECT o_orderkey, 'Explain order ' || o_orderkey AS prompt FROM orders WHERE o_orderkey % 9 >= 3"""
)
def askable_prompts(spark, sf_dir):
    return runs.split_prompts(fx.prompts(spark, sf_dir))[0]


@query("SELECT o_orderkey, length(prompt) AS n FROM (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '   ' WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN '' ELSE '  Explain order ' || o_orderkey || chr(10) END AS prompt FROM orders) WHERE o_orderkey % 9 <> 2")
def prompts_as_given(spark, sf_dir):
    """Without stripping only the empty prompt is blank."""
    asked, _ = runs.split_prompts(fx.prompts(spark, sf_dir), strip=False)
    return asked.select("o_orderkey", F.length("prompt").cast("long").alias("n"))


@query(q.with_parts(q.SPANS) + "SELECT trace_id, name, duration_ms FROM spans")
def span_durations(spark, sf_dir):
    return metrics.span_durations(fx.span_events(spark, sf_dir)).select("trace_id", "name", "duration_ms")


@query(
    q.with_parts(q.SPANS)
    + "SELECT name, round(quantile_cont(duration_ms, 0.95), 6) AS latency_ms FROM spans GROUP BY name"
)
def latency_p95(spark, sf_dir):
    spans = metrics.span_durations(fx.span_events(spark, sf_dir))
    return metrics.latency_quantile(spans, ["name"]).select("name", r6("latency_ms"))


@query(
    """SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_s,
      round(quantile_cont(value, 0.95), 6) AS latency_ms FROM events GROUP BY 1, 2"""
)
def latency_p95_by_user_day(spark, sf_dir):
    """As many groups as users have days: nearly one for each event."""
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id", F.unix_seconds(F.date_trunc("day", utc_instant(F.col("ts")))).alias("day_s"), F.col("value").alias("duration_ms")
    )
    return metrics.latency_quantile(rows, ["user_id", "day_s"]).select("user_id", "day_s", r6("latency_ms"))


@query(
    q.with_parts(*_KEYWORDS)
    + """SELECT CAST(epoch(date_trunc('day', x.ts)) AS BIGINT) AS window_s, CAST(count(*) AS BIGINT) AS n,
      round(avg(CAST(r.is_conflict AS DOUBLE)), 6) AS conflict_rate,
      round(avg(CASE WHEN r.good_probability < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate,
      round(avg(r.ess), 6) AS mean_ess
    FROM kw x JOIN resolved r ON """ + q.SAME_EVIDENCE + " GROUP BY 1"
)
def conflict_rate(spark, sf_dir):
    observed = fx.tool_observations(spark, sf_dir).withColumn("ts", utc_instant(F.col("ts")))
    rates = metrics.conflict_rate(score_tool_outputs(observed, _prior_resolutions(spark)))
    return rates.select(
        F.unix_seconds("window_start").alias("window_s"), "n", r6("conflict_rate"),
        r6("low_confidence_rate"), r6("mean_ess"),
    )


@query(
    q.with_parts(*_KEYWORDS)
    + """SELECT 'bayes.conflict_resolved' AS event, CAST(x.event_id AS VARCHAR) AS trace_id, x.result AS task,
      x.task AS task_level, r.state AS resolved_state, round(r.confidence, 6) AS confidence,
      round(r.p4, 6) AS p_ambiguous, round(r.credible_low, 6) AS credible_low,
      strftime(x.ts, '%Y-%m-%dT%H:%M:%S') AS logged_at
    FROM kw x JOIN resolved r ON """ + q.SAME_EVIDENCE + " WHERE x.gated"
)
def conflict_events(spark, sf_dir):
    """The emitted JSON lines, read back field by field."""
    observed = fx.tool_observations(spark, sf_dir).select(
        utc_instant(F.col("ts")).alias("ts"),
        F.col("obs_id").cast("string").alias("trace_id"),
        "result",
        F.col("result").alias("task_text"),
    )
    scored = score_tool_outputs(observed, _prior_resolutions(spark))
    events, _ = parse_log(metrics.conflict_events(scored, flag="gated"))

    def field(path: str):
        name, _, rest = path.partition(".")
        value = F.try_element_at("fields", F.lit(name))
        return F.get_json_object(value, f"$.{rest}") if rest else value

    return events.select(
        "event",
        log_text(F.col("ts")).alias("logged_at"),
        field("trace_id").alias("trace_id"),
        field("task").alias("task"),
        field("evidence.TaskStatus").cast("int").alias("task_level"),
        field("resolved_state").alias("resolved_state"),
        r6(field("confidence").cast("double"), "confidence"),
        r6(field("distribution.AMBIGUOUS").cast("double"), "p_ambiguous"),
        r6(F.get(F.from_json(field("credible_interval"), "array<double>"), F.lit(0)), "credible_low"),
    )


def _scored_tools(spark, sf_dir):
    observed = fx.tool_observations(spark, sf_dir).select(
        utc_instant(F.col("ts")).alias("ts"),
        F.col("obs_id").cast("string").alias("trace_id"),
        "result",
        F.col("result").alias("task_text"),
    )
    return score_tool_outputs(observed, _prior_resolutions(spark))


@query(
    q.with_parts(*_KEYWORDS)
    + """SELECT 'executor.step' AS event, CAST(event_id AS VARCHAR) AS trace_id, result AS task, result,
      1.0::DOUBLE AS confidence, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS logged_at FROM kw WHERE NOT gated"""
)
def step_events(spark, sf_dir):
    """Lines of the steps without a conflict, read back field by field."""
    events, _ = parse_log(metrics.step_events(_scored_tools(spark, sf_dir), flag="gated"))
    return events.select(
        "event",
        *[F.try_element_at("fields", F.lit(name)).alias(name) for name in ("trace_id", "task", "result")],
        F.try_element_at("fields", F.lit("confidence")).cast("double").alias("confidence"),
        log_text(F.col("ts")).alias("logged_at"),
    )


@query(
    q.with_parts(*_KEYWORDS)
    + """SELECT CAST(epoch(date_trunc('day', x.ts)) AS BIGINT) AS window_s, CAST(count(*) AS BIGINT) AS n_steps,
      CAST(count(*) FILTER (x.gated) AS BIGINT) AS n_conflicts, round(avg(CAST(x.gated AS DOUBLE)), 6) AS conflict_rate,
      round(avg(CASE WHEN x.gated AND r.confidence < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate
    FROM kw x JOIN resolved r ON """ + q.SAME_EVIDENCE + " GROUP BY 1"
)
def log_rates(spark, sf_dir):
    """Rates over all steps from the log alone: conflict lines and step lines, written and parsed."""
    scored = _scored_tools(spark, sf_dir)
    lines = metrics.conflict_events(scored, flag="gated").unionByName(metrics.step_events(scored, flag="gated"))
    events, _ = parse_log(lines)
    return metrics.log_rates(events).select(
        F.unix_seconds("window_start").alias("window_s"), "n_steps", "n_conflicts", r6("conflict_rate"), r6("low_confidence_rate")
    )
