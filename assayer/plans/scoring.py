"""From raw answers or tool outputs to confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import signals
from assayer.operators.agreement import STEP, step_agreement
from assayer.operators.posterior import resolve
from assayer.operators.runs import default_answer
from assayer.operators.skew import MIN_HEAVY_ROWS


def score_steps(
    samples: DataFrame,
    table: DataFrame,
    keys: list[str] = STEP,
    idx: str = "sample_idx",
    min_heavy_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """Answers to steps: agreement, evidence, resolution, confidence, conflict.

    ``confidence`` is P(CERTAIN) + P(HIGH); ``map_confidence`` the MAP's own.
    With a ``task_text`` key an empty consensus is replaced by its sentence.
    """
    resolved = resolve(step_agreement(samples, keys, idx, min_heavy_rows), table)
    scored = resolved.withColumnRenamed("confidence", "map_confidence").withColumn(
        "confidence", F.col("good_probability")
    )
    if "task_text" in keys:
        scored = scored.withColumn("answer", default_answer(F.col("answer"), F.col("task_text")))
    return scored


def score_tool_outputs(observations: DataFrame, table: DataFrame, result: str = "result") -> DataFrame:
    """Tool outputs: keyword evidence, gate, resolution, gated confidence.

    Ungated text has confidence 1 whatever its evidence; gated text has the MAP
    probability, not P(CERTAIN) + P(HIGH).
    """
    levels = observations.withColumns(
        {"_ev": signals.keyword_evidence(F.col(result)), "gated": signals.is_gated(F.col(result))}
    ).withColumns({c: F.col(f"_ev.{c}") for c in ("task", "data", "tool")}).drop("_ev")
    resolved = resolve(levels, table, strict=False)
    return resolved.withColumnRenamed("confidence", "map_confidence").withColumn(
        "confidence", F.when(~F.col("gated"), F.lit(1.0)).otherwise(F.col("map_confidence"))
    )
