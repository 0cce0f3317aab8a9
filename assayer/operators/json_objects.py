"""JSON recovery over tables of model output, plan rows and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import json_text


def recover_json(outputs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``obj``: the first JSON object in the text as JSON text, else NULL.

    Rows settled natively hand the Arrow function a NULL, so Python sees only
    the texts whose first brace does not open a valid object.
    """
    options = F.when(F.col(column).contains("{"), json_text.braced_candidates(F.col(column)))
    tried = outputs.withColumn("_options", options).withColumn(
        "_native", json_text.native_object(F.col("_options"))
    )
    rest = F.when(F.col("_native").isNull(), F.col("_options"))
    scanned = tried.withColumn("_scanned", json_text.scanned_object(rest))
    return scanned.withColumn(
        "obj", F.coalesce("_native", json_text.canonical(F.col("_scanned")))
    ).drop("_options", "_native", "_scanned")


def every_object(outputs: DataFrame, column: str = "text") -> DataFrame:
    """One row per JSON object in a text, with its ``place`` and ``length`` in code points, and ``obj``.

    Objects inside others are part of them. A text without an object has no row; the row's other
    columns stay. Fences need no care here: an object is found wherever it stands.
    """
    asked = outputs.where(F.col(column).contains("{"))
    found = asked.lateralJoin(json_text.objects_of(F.col(column).outer()))
    return found.withColumn("obj", json_text.canonical(F.col("obj")))


def unparseable(recovered: DataFrame, column: str = "text", width: int = 200) -> DataFrame:
    """Rows without an object, with the start of their text for the report."""
    return recovered.where(F.col("obj").isNull()).withColumn(
        "excerpt", F.substring(F.col(column), 1, width)
    )


def _field(parsed: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", kind)


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _steps(parsed: Column) -> Column:
    """The string elements of ``steps`` in order; anything else gives none."""
    items = F.coalesce(_field(parsed, "steps", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(items, _is_string), lambda v: v.cast("string"))


def _parsed(recovered: DataFrame) -> DataFrame:
    """The object as a variant, parsed once."""
    return recovered.withColumn("_v", F.try_parse_json("obj"))


def plan_rows(recovered: DataFrame) -> DataFrame:
    """One row per step with its position; the row's other columns stay."""
    rest = [c for c in recovered.columns if c != "obj"]
    steps = _parsed(recovered).withColumn("_steps", _steps(F.col("_v")))
    return _exploded(steps, rest, "_steps")


def _exploded(df: DataFrame, rest: list[str], column: str) -> DataFrame:
    """One row per element.  The plain form would first filter on the array's size,
    and so evaluate the whole chain behind it a second time."""
    rows = df.select(*rest, F.posexplode_outer(column).alias("pos", "step"))
    return rows.where(F.col("pos").isNotNull())


def decisions(recovered: DataFrame) -> DataFrame:
    """Adds ``action`` ('response', 'plan' or 'unparseable'), ``response`` and ``steps``.

    An object without an action is a response; any action but 'response' is a
    plan.  An empty response is NULL, so that the caller can fall back.
    """
    action, response = F.col("_action"), F.col("_response")
    named = F.when(_is_string(action), action.cast("string"))
    as_text = F.when(_is_string(response), response.cast("string")).otherwise(F.to_json(response))
    # JSON texts that count as no answer.
    blank = as_text.isin("", "null", "false", "0", "[]", "{}")
    fields = _parsed(recovered).withColumns(
        {
            "_action": _field(F.col("_v"), "action", "variant"),
            "_response": _field(F.col("_v"), "response", "variant"),
        }
    )
    chosen = fields.withColumn(
        "action",
        F.when(F.col("obj").isNull(), "unparseable")
        .when(action.isNull() | (named == "response"), "response")
        .otherwise("plan"),
    )
    return chosen.withColumns(
        {
            "response": F.when((F.col("action") == "response") & ~blank, as_text),
            "steps": F.when(F.col("action") == "plan", _steps(F.col("_v"))),
        }
    ).drop("_v", "_action", "_response")


def decided_steps(decided: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, pos, step) of the plans among the decisions."""
    return _exploded(decided, [key], "steps").withColumn("pos", F.col("pos").cast("long"))
