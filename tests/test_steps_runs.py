import pytest
from pyspark.sql import functions as F

from assayer.operators import json_objects, runs, steps


def plan(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id long, pos long, step string")


def past(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id long, pos long, task string, result string, confidence double")


def run_ids(spark, n):
    return spark.range(n).select(F.col("id").alias("run_id"))


def test_completed_and_repeated_steps_are_dropped(spark):
    planned = plan(spark, *[(1, i, s) for i, s in enumerate([" Trim sails ", "sound depth", "sound depth", "drop anchor", "stow ropes", " ", None])])
    done = past(spark, (1, 0, "trim sails", "r", 1.0), (1, 1, "DROP   ANCHOR", "r", 1.0), (2, 0, "sound depth", "r", 1.0))
    rows = steps.pending_steps(planned, done).orderBy("pos").collect()
    assert [r.step for r in rows] == ["sound depth", "stow ropes"]
    head = steps.next_step(steps.pending_steps(planned, done)).first()
    assert (head.pos, head.step, head.n_after) == (1, "sound depth", 1)


def test_the_original_spelling_is_kept(spark):
    rows = steps.pending_steps(plan(spark, (1, 0, "Do  IT"), (1, 1, "do it")), past(spark)).collect()
    assert [r.step for r in rows] == ["Do  IT"]


def texts(df):
    rows = df.collect()
    found = {r.run_id: r.text for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("part", [1, 2, 3, 1000])
def test_one_text_per_run_whatever_the_parts(spark, part):
    results = {1: [" ", "\ta ", "", "b\n", " "], 2: ["x"], 3: ["", " "], 4: ["  p", "", "q  "]}
    rows = [(k, i, f"t{i}", r, 1.0) for k, rs in results.items() for i, r in enumerate(rs)]
    df = past(spark, *rows)
    want = {k: " ".join(rs).strip() for k, rs in results.items()}
    want[0] = "No results were produced."
    assert texts(steps.result_summary(run_ids(spark, 5), df, part_steps=part)) == want
    lines = texts(steps.transcript(df, part_steps=part))
    assert lines == {k: "\n".join(f"- t{i}: {r}" for i, r in enumerate(rs)) for k, rs in results.items()}


def test_run_summary(spark):
    df = past(spark, (1, 0, "a", "r", 0.9), (1, 2, "c", "r", 0.2), (1, 1, "b", "r", 0.5))
    rows = {r.run_id: r for r in runs.run_summary(run_ids(spark, 2), df).collect()}
    assert (rows[1].steps_executed, rows[1].confidence) == (3, 0.2)
    assert (rows[0].steps_executed, rows[0].confidence) == (0, 1.0)


def test_routes(spark):
    df = spark.createDataFrame([("done", 1), ("", 1), ("", 0), (None, None)], "response string, n int")
    got = [r[0] for r in df.select(runs.route(F.col("response"), F.col("n"))).collect()]
    assert got == ["END", "executor", "END", "END"]


@pytest.mark.parametrize("min_heavy", [1, 10**9])
def test_replanning(spark, min_heavy):
    said = {
        1: '{"action": "plan", "steps": ["trim sails"]}',
        2: '{"action": "plan", "steps": ["Hoist flag", "hoist flag"]}',
        3: "no idea",
        4: '{"action": "response", "response": "bye"}',
        5: '{"action": "response"}',
        6: "no idea",
        7: '{"action": "plan", "steps": []}',
    }
    done = past(spark, *[(k, 0, "trim sails", "went well", 1.0) for k in said])
    current = plan(spark, *[(k, 0, "drop anchor") for k in (1, 2, 3, 4, 5)])
    decided = json_objects.decisions(
        json_objects.recover_json(spark.createDataFrame(list(said.items()), "run_id long, text string"))
    )
    proposed = steps.pending_steps(json_objects.decided_steps(decided), done)
    pending = steps.pending_steps(current, done)
    routed = runs.replan(decided, proposed, pending)
    got = {r.run_id: (r.source, r.response, r.next) for r in routed.collect()}
    assert got == {
        1: ("current_plan", None, "executor"),
        2: ("decision", None, "executor"),
        3: ("current_plan", None, "executor"),
        4: ("decision", "bye", "END"),
        5: ("summary", None, "END"),
        6: ("summary", None, "END"),
        7: ("summary", None, "END"),
    }
    told = runs.final_responses(routed, steps.result_summary(run_ids(spark, 8), done))
    assert texts(told) == {4: "bye", 5: "went well", 6: "went well", 7: "went well"}
    left = runs.next_plan(routed, proposed, pending, min_heavy_rows=min_heavy).collect()
    assert sorted((r.run_id, r.step, r.source) for r in left) == [
        (1, "drop anchor", "current_plan"), (2, "Hoist flag", "decision"), (3, "drop anchor", "current_plan"),
    ]


def test_prompts_and_errors(spark):
    df = spark.createDataFrame([(" hi\n",), ("  ",), ("",), (None,)], "prompt string")
    good, blank = runs.split_prompts(df)
    assert [r.prompt for r in good.collect()] == ["hi"] and blank.count() == 3
    good, blank = runs.split_prompts(df, strip=False)
    assert [r.prompt for r in good.collect()] == [" hi\n", "  "] and blank.count() == 2
    errors = spark.createDataFrame([("A", "Connection error"), ("B", "x"), ("B", "y")], "error_class string, message string")
    assert {r.unavailable: r.n for r in runs.error_classes(errors).collect()} == {True: 1, False: 2}


def test_cohort_gap(spark):
    df = spark.createDataFrame([("a", 0.8), ("a", 0.6), ("b", 0.3), ("c", 9.0)], "g string, confidence double")
    r = runs.cohort_gap(df, "g", "a", "b").first()
    assert (r.confidence_a, r.confidence_b, r.gap) == pytest.approx((0.7, 0.3, 0.4))


def test_the_last_event_of_a_run_decides(spark):
    started = spark.createDataFrame([(i,) for i in range(1, 8)], "run_id long")
    past = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.4), (2, 0, 0.9), (3, 0, 0.8), (4, 5, 0.7), (6, 0, None)], "run_id long, pos long, confidence double")
    errors = spark.createDataFrame(
        [(2, 1, "APIError", "Connection refused"), (3, 0, "ValueError", "no such tool"), (4, 1, "APIError", "connection error"), (7, 0, None, "actively refused")],
        "run_id long, pos long, error_class string, message string",
    )
    texts = spark.createDataFrame([(1, "all of it"), (2, "half of it"), (4, "after a retry"), (5, "")], "run_id long, text string")
    got = {r.run_id: tuple(r)[1:] for r in runs.run_results(started, past, errors, texts).collect()}
    gone = ("unavailable", "", 0, 0.0, runs.UNAVAILABLE_ERROR)
    assert got == {
        1: ("ok", "all of it", 2, 0.4, None),
        2: gone,
        3: ("raised", None, None, None, "ValueError: no such tool"),  # an error at a step's place comes after it
        4: ("ok", "after a retry", 1, 0.7, None),  # a later step got over it
        5: ("ok", "", 0, 1.0, None),
        6: ("ok", runs.NO_RESPONSE, 1, 1.0, None),
        7: gone,
    }
    nothing = runs.run_results(started.limit(0), past.limit(0), errors.limit(0), texts.limit(0))
    assert nothing.count() == 0


def test_step_and_conflict_lines_hold_every_step_once(spark):
    from assayer.operators import metrics, posterior
    from assayer.plans.scoring import score_steps
    from assayer.sources.readers import parse_log

    answers = [(1, 0, i, "fetch", "the total is forty two") for i in range(3)]
    answers += [(2, 0, i, "guess", t) for i, t in enumerate(("blue whale song", "seven tall ladders", "I am not sure"))]
    samples = spark.createDataFrame(answers, "run_id long, step_idx long, sample_idx long, task_text string, answer string")
    table = posterior.resolutions(posterior.prior_table(spark))
    scored = score_steps(samples, table, keys=["run_id", "step_idx", "task_text"])
    scored = scored.withColumns({"ts": F.lit("2024-03-01 10:00:00").cast("timestamp"), "trace_id": F.col("run_id").cast("string")})
    lines = metrics.conflict_events(scored).unionByName(metrics.step_events(scored))
    events, bad = parse_log(lines)
    seen = {(r.event, r.fields["task"], r.fields["consistency"]) for r in events.collect()}
    assert bad.count() == 0 and {(e, t) for e, t, _ in seen} == {("executor.step", "fetch"), ("bayes.conflict_resolved", "guess")}
    assert ("executor.step", "fetch", "1.0") in seen
    rates = metrics.log_rates(events).first()
    assert (rates.n_steps, rates.n_conflicts, rates.conflict_rate) == (2, 1, 0.5)
