"""Readers with explicit schemas; no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schema
from assayer.functions.times import from_log_text

TABLES = {
    "observations": schema.OBSERVATION,
    "evidence": schema.EVIDENCE,
    "answers": schema.ANSWER_SAMPLE,
    "signals": schema.SIGNALS,
    "tool_observations": schema.TOOL_OBSERVATION,
    "model_outputs": schema.MODEL_OUTPUT,
    "job_changes": schema.JOB_CHANGE,
}
_LOG_COLUMNS = ["ts", "level", "logger", "event"]


def read_table(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Any input table of the library from parquet, ORC, JSON or CSV files."""
    return spark.read.schema(TABLES[kind]).format(fmt).load(path)


def stream_table(
    spark: SparkSession, kind: str | T.StructType, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The same as a file stream."""
    fields = TABLES[kind] if isinstance(kind, str) else kind
    return spark.readStream.schema(fields).format(fmt).options(**options).load(path)


def parse_log(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) of JSON log lines; batch or stream.

    The four fixed fields become columns, the rest stays in ``fields``; nested
    values there are JSON text.
    """
    parsed = lines.withColumn("_f", F.from_json(F.col(column), "map<string,string>"))
    named = F.try_element_at(F.col("_f"), F.lit("event"))
    good = F.coalesce(named.isNotNull(), F.lit(False))
    events = parsed.where(good).select(
        from_log_text(F.try_element_at("_f", F.lit("ts"))).alias("ts"),
        *[F.try_element_at("_f", F.lit(c)).alias(c) for c in _LOG_COLUMNS[1:]],
        F.map_filter("_f", lambda k, _: ~k.isin(*_LOG_COLUMNS)).alias("fields"),
    )
    return events, parsed.where(~good).drop("_f")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_log(spark.read.text(path))


def stream_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_log(spark.readStream.text(path))
