"""Running a stream over what is there now, into the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.session import exists, fresh_dir

_BATCH = StructField("batch", LongType())



def append_to_table(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Append-mode run of all available input; returns the written rows.

    With a ``folder`` a later call goes on where this one stopped.
    """
    spark = stream.sparkSession
    folder = folder or fresh_dir(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def snapshot_to_table(
    stream: DataFrame, label: str, mode: str = "complete", keys: list[str] | None = None, folder: str | None = None
) -> DataFrame:
    """Complete- or update-mode run; returns the final state.

    Each micro-batch overwrites its own folder, so a repeated batch does no harm.
    In update mode the newest row per key is the state. With a ``folder`` a later call
    goes on where this one stopped.
    """
    spark = stream.sparkSession
    folder = folder or fresh_dir(spark, label)
    out = f"{folder}/batches"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not exists(spark, out):  # nothing has arrived yet
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(StructType([*stream.schema, _BATCH])).parquet(out)
    if mode == "update":
        newest = F.max_by(F.struct(*stream.columns), "batch").alias("row")
        return written.groupBy(*keys).agg(newest).select("row.*")
    last = written.agg(F.max("batch").alias("batch")).scalar()
    return written.where(F.col("batch") == last).drop("batch")


def valid_and_quarantined(
    stream: DataFrame,
    label: str,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    work: Callable[[DataFrame], DataFrame],
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(work on the valid rows of every micro-batch, quarantined rows), both as tables of what there is now.

    One reading of each micro-batch goes to two sinks, and each batch has a folder of its own in both, which is
    overwritten if the batch is repeated: a row is in one of them, once. A row
    that can't be used never ends the stream. ``work`` sees one micro-batch, so what
    it adds up has to be added up again over the batches.
    """
    spark = stream.sparkSession
    folder = folder or fresh_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split(batch)
            work(good).write.mode("overwrite").parquet(f"{folder}/valid/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    good, bad = split(spark.createDataFrame([], stream.schema))

    def table(name: str, shape: StructType) -> DataFrame:
        if not exists(spark, f"{folder}/{name}"):
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(f"{folder}/{name}").select(shape.names)

    return table("valid", work(good).schema), table("quarantine", bad.schema)
