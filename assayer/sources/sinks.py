"""Writers for resolutions and conflict events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.ordinal import distribution_map
from assayer.operators.metrics import conflict_events


def summary_record() -> Column:
    """A resolution as one struct: state, confidence, distribution, interval, size."""
    return F.struct(
        "state",
        "state_index",
        "confidence",
        distribution_map(F.col("theta")).alias("distribution"),
        F.array("credible_low", "credible_high").alias("credible_interval"),
        "effective_sample_size",
    )


def write_resolutions(resolved: DataFrame, path: str, keep: list[str], mode: str = "errorifexists") -> None:
    """Parquet with the kept columns and one ``summary`` struct per row."""
    resolved.select(*keep, summary_record().alias("summary")).write.mode(mode).parquet(path)


def write_conflict_events(
    resolved: DataFrame, path: str, flag: str = "is_conflict", mode: str = "errorifexists"
) -> None:
    """JSON lines, one per flagged row."""
    conflict_events(resolved, flag).write.mode(mode).text(path)
