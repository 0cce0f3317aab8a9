"""Operator inputs derived from the shared test tables by plain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.times import utc_instant
from assayer.sources.readers import stream_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fields = table(spark, sf_dir, name).schema
    return stream_table(spark, fields, sf_dir, pathGlobFilter=f"{name}.parquet")


def _tenth_pairs(rate: str) -> Column:
    return F.least(F.lit(4), F.floor(F.round(F.col(rate) * 100).cast("int") / 2).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: order priority, quantity, discount and tax as levels 0..4."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("task"),
        F.floor((F.col("l_quantity").cast("int") - 1) / 10).cast("int").alias("data"),
        _tenth_pairs("l_discount").alias("tool"),
        _tenth_pairs("l_tax").alias("outcome"),
    )


def partial_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with some levels unobserved."""
    def unless(hidden: Column, level: str) -> Column:
        return F.when(~hidden, F.col(level))

    return observations(spark, sf_dir).withColumns(
        {
            "task": unless(F.col("l_suppkey") % 3 == 0, "task"),
            "data": unless(F.col("l_suppkey") % 5 == 0, "data"),
            "tool": unless(F.col("l_partkey") % 7 == 0, "tool"),
        }
    )


def shifted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with one level pushed out of range on some rows."""
    return observations(spark, sf_dir).withColumns(
        {
            "task": F.when(F.col("l_partkey") % 11 == 0, F.col("task") + 5).otherwise(F.col("task")),
            "outcome": F.when(F.col("l_suppkey") % 13 == 0, F.lit(-1)).otherwise(F.col("outcome")),
        }
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def with_result(events: DataFrame) -> DataFrame:
    """O: a tool result per event."""
    k = _k().cast("string")
    kind = F.col("event_type")
    return events.withColumn(
        "result",
        F.when(kind == "click", F.concat(F.lit("catalogue lookup: found "), k, F.lit(" matching entries")))
        .when(kind == "view", F.concat(k, F.lit(" rows retrieved, their dates in conflict")))
        .when(kind == "purchase", F.concat(F.lit("outcome uncertain, since "), k, F.lit(" registers disagree")))
        .when(kind == "error", F.lit("second retry failed with an error"))
        .otherwise(F.lit("a partial log and accounts that contradict it")),
    )


def tool_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_result(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("obs_id"), "ts", "result"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: the assistant's turns of a conversation as samples of one step."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("run_id"),
        F.lit(0).cast("long").alias("step_idx"),
        F.col("turn").alias("sample_idx"),
        F.col("text").alias("answer"),
    )


def adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn next to the one before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    return turns.join(before, ["conv_id", "turn"])


def _plan_text() -> Column:
    return F.concat(
        F.lit('"steps": ["'), F.col("o_orderstatus"), F.lit('", "'), F.col("o_orderpriority"), F.lit('"]')
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: eight ways of wrapping a plan in text."""
    plain = F.concat(F.lit("{"), _plan_text(), F.lit("}"))
    variant = F.col("o_orderkey") % 8
    text = (
        F.when(variant == 0, plain)
        .when(variant == 1, F.concat(F.lit("Steps as agreed:\n```json\n"), plain, F.lit("\n```")))
        .when(variant == 2, F.concat(F.lit("Written out:\n"), plain, F.lit("\nThat is all of them.")))
        .when(variant == 3, F.concat(F.lit('{"from": {"page": 4}, '), _plan_text(), F.lit("}")))
        .when(variant == 4, F.concat(F.lit('{"hint": "see {table} 3", '), _plan_text(), F.lit("}")))
        .when(variant == 5, F.concat(plain, F.lit(' or else {"later": 2}')))
        .when(variant == 6, F.concat(F.lit("{torn page} followed by "), plain))
        .otherwise(F.lit("nothing was written down"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: (run_id, pos, step), with case and spacing variants of the same step."""
    kind, k5 = F.col("event_type"), (_k() % 5).cast("string")
    plain = F.concat(F.lit("Check "), kind, F.lit(" "), k5)
    way = F.col("event_id") % 3
    step = (
        F.when(way == 0, F.upper(plain))
        .when(way == 1, F.concat(F.lit("Check  "), kind, F.lit("  "), k5))
        .otherwise(plain)
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), step.alias("step"), "ts",
        "event_type", "props",
    )


def executed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: every step with its tool result."""
    return with_result(planned_steps(spark, sf_dir)).select("run_id", "pos", F.col("step").alias("task"), "result")


def past_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: the completed steps, by a rule on the step's number."""
    return executed_steps(spark, sf_dir).where(F.col("pos") % 5 == 0)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()


def run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision text per run, in five forms."""
    way = F.col("run_id") % 5
    text = (
        F.when(way == 0, F.concat(F.lit('{"action": "response", "response": "run '), F.col("run_id").cast("string"), F.lit(' is done"}')))
        .when(way == 1, F.lit('Next: {"action": "plan", "steps": ["check  CLICK 0", "Check view 9", 7, "check view 9"]}'))
        .when(way == 2, F.lit('{"response": "fine as it is"}'))
        .when(way == 3, F.lit('{"action": "response", "response": ""}'))
        .otherwise(F.lit("I would go on."))
    )
    return runs(spark, sf_dir).withColumn("text", text)


def job_changes_of(orders: DataFrame) -> DataFrame:
    """B: creates and updates derived from one order each; batch or stream."""
    key = F.col("o_orderkey")
    failed = key % 10 == 0
    score = (key % 100).cast("double") / 100
    result = F.concat(F.lit('{"confidence_score": '), score.cast("string"), F.lit("}"))
    no_value = F.lit(None).cast("string")

    def status(name: str) -> list[Column]:
        return [F.lit("status"), F.lit(name)]

    prompt = F.create_map(F.lit("prompt"), F.concat(F.lit("order "), key.cast("string")))
    moved = F.col("o_orderstatus").isin("P", "F")
    done = F.col("o_orderstatus") == "F"
    changes = [  # when, seq, op, hours, fields
        (key % 17 != 0, 0, "create", 0, prompt),
        (moved, 1, "update", 1, F.create_map(*status("running"))),
        (done & ~failed, 2, "update", 2, F.create_map(*status("done"), F.lit("result"), result)),
        (done & failed, 2, "update", 2, F.create_map(*status("error"), F.lit("error"), F.lit("tool failed"))),
        (key % 7 == 0, 3, "update", 30, F.create_map(*status("reopened"), F.lit("result"), no_value)),
        (key % 11 == 0, 4, "create", 60, prompt),
    ]
    whens, seqs, ops, hours, fields = zip(*changes, strict=True)

    def of_way(values: list[Column]) -> Column:
        found = F
        for i, value in enumerate(values):
            found = found.when(F.col("way") == i, value)
        return found

    # Only the number of a change is exploded: its columns are made after it, for the rows and uses that need them.
    ways = F.array(*[F.when(when, F.lit(i)) for i, when in enumerate(whens)])
    return (
        orders.withColumn("at0", utc_instant(F.col("o_orderdate")))
        .withColumn("way", F.explode(ways))
        .where(F.col("way").isNotNull())
        .select(
            key.cast("string").alias("job_id"),
            of_way([F.lit(n).cast("long") for n in seqs]).alias("seq"),
            of_way([F.lit(name) for name in ops]).alias("op"),
            of_way(list(fields)).alias("changes"),
            of_way([F.col("at0") + F.expr(f"interval {n} hours") for n in hours]).alias("at"),
        )
    )


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_changes_of(table(spark, sf_dir, "orders"))


def span_events_of(events: DataFrame) -> DataFrame:
    """V: a start and an end per event, ``value`` milliseconds apart."""
    begin = utc_instant(F.col("ts"))
    end = F.timestamp_micros(F.unix_micros(begin) + F.round(F.col("value") * 1000).cast("long"))
    name = F.concat(F.lit("step."), F.col("event_type"))

    def mark(suffix: str, at: Column) -> Column:
        return F.struct(F.concat(name, F.lit(suffix)).alias("event"), at.alias("ts"))

    return events.select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.explode(F.array(mark(".start", begin), mark(".end", end))).alias("e"),
    ).select("trace_id", "e.*")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_events_of(table(spark, sf_dir, "events"))


def broken_span_events_of(events: DataFrame) -> DataFrame:
    """V with names that recur in a trace of four events, starts without end and ends without start."""
    marks = span_events_of(events)
    number = F.col("trace_id").cast("long")
    kept = F.when(F.col("event").endswith(".start"), number % 11 != 0).otherwise(number % 7 != 0)
    return marks.where(kept).withColumn("trace_id", F.floor(number / 4).cast("string"))


def poisoned_evidence_of(events: DataFrame) -> DataFrame:
    """Observations per event, some with a level out of range or none."""
    return event_evidence_of(events).withColumns(
        {
            "task": F.when(F.col("event_id") % 11 == 0, F.col("task") + 5).otherwise(F.col("task")),
            "tool": F.when(F.col("event_id") % 13 != 0, F.col("tool")),
            "outcome": F.when(F.col("event_id") % 17 == 0, F.lit(-1)).otherwise(F.col("outcome")),
        }
    )


def event_evidence_of(events: DataFrame) -> DataFrame:
    """An observation per event, all levels from its numbers; batch or stream."""
    k = _k()
    return events.select(
        "event_id",
        utc_instant(F.col("ts")).alias("ts"),
        (k % 5).cast("int").alias("task"),
        (F.floor(k / 5) % 5).cast("int").alias("data"),
        (F.col("event_id") % 5).cast("int").alias("tool"),
        (F.col("user_id") % 5).cast("int").alias("outcome"),
    )


def executed_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: the steps whose event isn't an error."""
    rows = with_result(planned_steps(spark, sf_dir)).where(F.col("event_type") != "error")
    return rows.select("run_id", "pos", F.col("step").alias("task"), "result")


def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events as errors of their run, at the event's place."""
    found = errors(spark, sf_dir).withColumnRenamed("event_id", "pos")
    place = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("run_id"))
    return found.join(place, "pos")


def empty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to tasks, some empty and some missing."""
    key = F.col("o_orderkey")
    answer = F.when(key % 5 == 0, F.lit("")).when(key % 5 != 1, F.concat(F.lit("order of "), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Price order "), key.cast("string")).alias("task"), answer.alias("answer")
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows with class and message."""
    way = _k() % 4
    message = (
        F.when(way == 0, "Connection refused by host")
        .when(way == 1, "the host ACTIVELY REFUSED it")
        .when(way == 2, "value out of range")
        .otherwise("failed to connect")
    )
    cls = F.when(way == 2, "ValueError").otherwise("APIError")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        "event_id", cls.alias("error_class"), message.alias("message")
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of which some are blank."""
    way = F.col("o_orderkey") % 9
    text = (
        F.when(way == 0, F.lit("   "))
        .when(way == 1, F.lit(" \t\n"))
        .when(way == 2, F.lit(""))
        .otherwise(F.concat(F.lit("  Explain order "), F.col("o_orderkey").cast("string"), F.lit("\n")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("prompt"))


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: embeddings as signals, label modulo five as outcome."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("signals"),
        (F.col("label") % 5).cast("int").alias("outcome"),
    )
