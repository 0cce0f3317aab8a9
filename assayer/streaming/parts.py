"""Streams whose state is a table of mergeable parts.

A fold whose parts may be merged in any order (maxima of structs led by a sequence number, minima,
counts) needs no state store. Each micro-batch is folded by itself and written to a folder of its own, so a batch
that is repeated after a failure does no harm; whoever reads merges what is there. Rows may come
in any order and as late as they like: no watermark drops them.

:func:`compact` replaces the parts read so far by their merge and moves out what has ended,
so that the table of the living stays as small as they are few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.operators import jobs, metrics
from assayer.schema import JOB_TTL_SECONDS
from assayer.session import exists, scoped


@dataclass(frozen=True)
class Fold:
    """``parts`` folds rows, ``merge`` folds parts; both give one row per key in the same columns."""

    parts: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def job_fold(ttl_seconds: int = JOB_TTL_SECONDS) -> Fold:
    """Changes of jobs by TTL-long slots."""
    return Fold(lambda changes: jobs.slot_parts(changes, ttl_seconds), jobs.merged_slots)


SPANS = Fold(metrics.span_parts, metrics.merged_spans)


def absorb(stream: DataFrame, folder: str, fold: Fold) -> DataFrame:
    """Fold all that the stream has now into the table at ``folder``, and return the table's parts.

    The folder holds the progress too: called again with a source that has grown, it goes on
    where it stopped.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fold.parts(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return parts(stream.sparkSession, folder, fold, stream.schema)


def _shape(spark: SparkSession, fold: Fold, rows: StructType) -> StructType:
    made = fold.parts(spark.createDataFrame([], rows)).schema
    return StructType([StructField(f.name, f.dataType) for f in made])


def _merged_upto(spark: SparkSession, folder: str) -> int:
    """The last batch that a finished compaction holds, or -1."""
    if not exists(spark, f"{folder}/merged"):
        return -1
    upto = spark.read.schema(StructType([StructField("upto", LongType())])).parquet(f"{folder}/merged")
    found = [r["upto"] for r in upto.distinct().collect()]  # one number per compaction that is still there
    return max((n for n in found if exists(spark, f"{folder}/merged/upto={n}/_SUCCESS")), default=-1)


def parts(spark: SparkSession, folder: str, fold: Fold, rows: StructType) -> DataFrame:
    """All parts there are, those of ended keys aside. ``rows`` is the schema of what is folded."""
    shape, upto = _shape(spark, fold, rows), _merged_upto(spark, folder)
    found = spark.createDataFrame([], shape)
    if exists(spark, f"{folder}/parts"):
        new = spark.read.schema(StructType([*shape, StructField("batch", LongType())])).parquet(f"{folder}/parts")
        found = new.where(F.col("batch") > upto).drop("batch")
    if upto >= 0:
        found = found.unionByName(spark.read.schema(shape).parquet(f"{folder}/merged/upto={upto}"))
    return found


def compact(
    spark: SparkSession,
    folder: str,
    fold: Fold,
    rows: StructType,
    ended: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> None:
    """Merge the parts so far; ``ended`` splits them into (merged parts of the living, finished rows).

    Finished rows go to ``folder/ended``, one folder for each compaction. A compaction that fails half-way
    is taken up again by the next: it counts from its success mark on.
    """
    if not exists(spark, f"{folder}/parts"):
        return
    batches = spark.read.schema(StructType([StructField("batch", LongType())])).parquet(f"{folder}/parts")
    last = batches.agg(F.max("batch")).first()[0]
    if last is None or last <= _merged_upto(spark, folder):
        return
    found = parts(spark, folder, fold, rows)
    with scoped():  # nothing reads after the writes what ``ended`` has settled for them
        if ended:
            merged, finished = ended(found)
            finished.write.mode("overwrite").parquet(f"{folder}/ended/upto={last}")
        else:
            merged = fold.merge(found)
        merged.write.mode("overwrite").parquet(f"{folder}/merged/upto={last}")


def ended_rows(spark: SparkSession, folder: str, shape: StructType) -> DataFrame:
    """What compactions have moved out."""
    if not exists(spark, f"{folder}/ended"):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{folder}/ended").select(shape.names)
