"""Table schemas and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# The five ordinal states, best first, and the three parents.
STATES = ("CERTAIN", "HIGH", "MEDIUM", "LOW", "AMBIGUOUS")
PARENTS = ("TaskStatus", "DataQuality", "ToolReliability")
N_LEVELS = 5
N_CONTEXTS = 125
CONFLICT_LEVEL = 2  # MEDIUM or worse counts as a conflict
JOB_TTL_SECONDS = 86_400

# Column names of the three parents in every evidence table.
LEVELS = ["task", "data", "tool"]

OBSERVATION = T.StructType(
    [
        T.StructField("task", T.IntegerType()),
        T.StructField("data", T.IntegerType()),
        T.StructField("tool", T.IntegerType()),
        T.StructField("outcome", T.IntegerType()),
        T.StructField("count", T.LongType()),
    ]
)
EVIDENCE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("data", T.IntegerType()),
        T.StructField("tool", T.IntegerType()),
    ]
)
ANSWER_SAMPLE = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("step_idx", T.LongType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("answer", T.StringType()),
    ]
)
SIGNALS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("signals", T.ArrayType(T.DoubleType())),
        T.StructField("outcome", T.IntegerType()),
    ]
)
TOOL_OBSERVATION = T.StructType(
    [
        T.StructField("obs_id", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("result", T.StringType()),
    ]
)
MODEL_OUTPUT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]
)
JOB_CHANGE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),  # 'create' or 'update'
        T.StructField("changes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("at", T.TimestampType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
