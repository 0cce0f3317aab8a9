"""Folding step rows into runs, routing runs, and small run-level reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.functions.signals import is_unavailable
from assayer.operators.skew import MIN_HEAVY_ROWS, join_lookup


def default_answer(answer: Column, task: Column) -> Column:
    """An empty or missing answer is replaced by a sentence naming the task."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.concat(F.lit("(no result produced for: "), task, F.lit(")")))


def run_summary(runs: DataFrame, past: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, steps_executed, confidence): the last step's confidence counts.

    A run without steps has confidence 1.  One hash aggregate over both tables.
    """
    steps = past.select(key, "pos", "confidence")
    known = runs.select(key)
    return (
        steps.unionByName(known, allowMissingColumns=True)
        .groupBy(key)
        .agg(
            F.count("pos").alias("steps_executed"),
            F.coalesce(F.max_by("confidence", "pos"), F.lit(1.0)).alias("confidence"),
        )
    )


#: Fixed value: what a run reports whose model service could not be reached.
UNAVAILABLE_ERROR = (
    "Local LLM is unavailable. Start llama-server at the configured LLAMA_CPP_BASE_URL and try again."
)
#: A run without a response of its own.
NO_RESPONSE = "No response"  # fixed value


def run_results(
    runs: DataFrame,
    past: DataFrame,
    errors: DataFrame,
    responses: DataFrame,
    key: str = "run_id",
    unavailable_error: str = UNAVAILABLE_ERROR,
) -> DataFrame:
    """(run, outcome, response, steps_executed, confidence, error) of every run.

    ``past`` has ``pos`` and ``confidence`` per step, ``errors`` has ``pos``, ``error_class`` and
    ``message``, ``responses`` has ``text``. The last event of a run decides:

    * a step, or none at all: outcome ``ok`` with the response, the number of steps and the last
      step's confidence (1 without steps). An error that a later step got over leaves no trace;
    * an error that says the service was unreachable: ``unavailable``, an empty response,
      no steps, confidence 0 and the fixed error text;
    * any other error: ``raised``. It gives no result, so all but the error's text is NULL.

    Of a step and an error at one position the error is the later. Both logs meet in one hash aggregate
    that combines before the shuffle, so a run of any length is folded in parallel.
    """
    message = F.concat_ws(": ", "error_class", "message")
    failed = errors.select(
        key,
        "pos",
        is_unavailable(F.col("error_class"), F.col("message")).alias("_unavailable"),
        message.alias("_error"),
    )
    events = (
        past.select(key, "pos", "confidence", F.lit(0).alias("_late"))
        .unionByName(failed.withColumn("_late", F.lit(1)), allowMissingColumns=True)
        .unionByName(runs.select(key), allowMissingColumns=True)
    )
    step = F.col("_late") == 0
    last = F.struct("pos", "_late", "_unavailable", "_error")
    folded = events.groupBy(key).agg(
        F.count_if(step).alias("_steps"),
        F.coalesce(F.max_by("confidence", F.when(step, F.col("pos"))), F.lit(1.0)).alias("_confidence"),
        F.max(F.when(F.col("pos").isNotNull(), last)).alias("_last"),
    )
    ended = F.coalesce(F.col("_last._late") == 1, F.lit(False))
    outcome = F.when(~ended, "ok").when(F.col("_last._unavailable"), "unavailable").otherwise("raised")
    told = folded.withColumn("outcome", outcome).join(responses.select(key, F.col("text").alias("_text")), key, "left")

    def by_outcome(ok: Column, unavailable: Column, raised: Column) -> Column:
        known = F.when(F.col("outcome") == "ok", ok)
        return known.when(F.col("outcome") == "unavailable", unavailable).otherwise(raised)

    nothing = F.lit(None)
    return told.select(
        key,
        "outcome",
        by_outcome(F.coalesce("_text", F.lit(NO_RESPONSE)), F.lit(""), nothing).alias("response"),
        by_outcome(F.col("_steps"), F.lit(0).cast("long"), nothing).alias("steps_executed"),
        by_outcome(F.col("_confidence"), F.lit(0.0), nothing).alias("confidence"),
        by_outcome(nothing, F.lit(unavailable_error), F.col("_last._error")).cast("string").alias("error"),
    )


def route(response: Column, n_pending: Column) -> Column:
    """'END' once there is a response, 'executor' while steps remain, else 'END'."""
    return (
        F.when(F.length(F.coalesce(response, F.lit(""))) > 0, "END")
        .when(n_pending > 0, "executor")
        .otherwise("END")
    )


def _n_pending(pending: DataFrame, key: str, name: str) -> DataFrame:
    return pending.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def replan(
    decisions: DataFrame, proposed: DataFrame, current: DataFrame, key: str = "run_id"
) -> DataFrame:
    """(run, action, source, response, next): what each run does after a decision.

    ``decisions`` holds one row per run; ``proposed`` and ``current`` are the
    pending steps of the decision's plan and of the plan in force.  A plan
    without a usable step falls back to the current plan, and that to the
    summary of results (:func:`assayer.operators.steps.result_summary`).
    """
    joined = decisions.join(_n_pending(proposed, key, "n_proposed"), key, "left").join(
        _n_pending(current, key, "n_current"), key, "left"
    )
    answered = F.col("response").isNotNull()
    source = (
        F.when(F.col("action") == "response", F.when(answered, "decision").otherwise("summary"))
        .when((F.col("action") == "plan") & (F.col("n_proposed") > 0), "decision")
        .when(F.col("n_current") > 0, "current_plan")
        .otherwise("summary")
    )
    ended = (F.col("action") == "response") | (F.col("source") == "summary")
    return joined.withColumn("source", source).select(
        key, "action", "source", "response", F.when(ended, "END").otherwise("executor").alias("next")
    )


def next_plan(
    routed: DataFrame,
    proposed: DataFrame,
    current: DataFrame,
    key: str = "run_id",
    min_heavy_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """(run, pos, step, source): the steps in force after :func:`replan`.

    A proposed step that is still pending always wins, so only the current
    plans have to be matched with the runs that keep them.
    """
    kept = routed.where(F.col("source") == "current_plan").select(key)
    staying = join_lookup(current, kept, [key], "left_semi", ["pos"], min_heavy_rows)
    return proposed.withColumn("source", F.lit("decision")).unionByName(
        staying.withColumn("source", F.lit("current_plan"))
    )


def final_responses(routed: DataFrame, summaries: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, text) of the runs that ended: the decision's response, or the
    text of :func:`assayer.operators.steps.result_summary`."""
    ended = routed.where(F.col("next") == "END")
    told = ended.where(F.col("source") == "decision").select(key, F.col("response").alias("text"))
    untold = ended.where(F.col("source") == "summary").select(key)
    return told.unionByName(summaries.join(untold, key, "left_semi").select(key, "text"))


def cohort_gap(scored: DataFrame, cohort: str, a, b, confidence: str = "confidence") -> DataFrame:
    """Mean confidence of two cohorts and the difference, in one pass."""
    def mean(value) -> Column:
        return F.avg(F.when(F.col(cohort) == F.lit(value), F.col(confidence)))

    return scored.agg(mean(a).alias("confidence_a"), mean(b).alias("confidence_b")).withColumn(
        "gap", F.col("confidence_a") - F.col("confidence_b")
    )


def split_prompts(prompts: DataFrame, column: str = "prompt", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """(askable, blank).  With ``strip`` the prompt is stripped before the test."""
    cleaned = prompts.withColumn(column, text.strip(F.col(column))) if strip else prompts
    filled = F.length(F.coalesce(F.col(column), F.lit(""))) > 0
    return cleaned.where(filled), cleaned.where(~filled)


def error_classes(errors: DataFrame) -> DataFrame:
    """(unavailable, n) over error rows with ``error_class`` and ``message``."""
    return (
        errors.select(is_unavailable(F.col("error_class"), F.col("message")).alias("unavailable"))
        .groupBy("unavailable")
        .agg(F.count(F.lit(1)).alias("n"))
    )
