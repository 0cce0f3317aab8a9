"""Table access, folds and counters that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into one fold; a NULL key is in none."""
    checksum = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(checksum % folds == fold, F.lit(False))


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text), F.lit(""))
