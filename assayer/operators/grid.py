"""Conjugate counting over any grid of discrete bins; only visited cells are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.ordinal import mixed_radix

# A table of at most this many cells may be broadcast; it is known from the
# grid's shape before any data is read.
BROADCAST_CELLS = 100_000


def cell_of(bins: Column, n_bins: int) -> Column:
    return mixed_radix(bins, n_bins)


def grid_counts(
    binned: DataFrame, n_bins: int, n_outcomes: int = 5, bins: str = "bins", outcome: str = "outcome"
) -> DataFrame:
    """(cell, outcome, n) for visited cells."""
    label = F.col(outcome)
    checked = F.when(label.between(0, n_outcomes - 1), label).otherwise(
        F.raise_error(F.lit("outcome out of range")).cast("int")
    )
    return (
        binned.select(cell_of(F.col(bins), n_bins).alias("cell"), checked.alias("outcome"))
        .groupBy("cell", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def grid_predictive(counts: DataFrame, n_outcomes: int = 5, prior: float = 1.0) -> DataFrame:
    """(cell, alpha, theta, prediction) for visited cells.

    The most frequent outcome wins, the lowest on ties.
    """
    alpha = [
        (F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)) + prior).cast("double")
        for k in range(n_outcomes)
    ]
    total = F.aggregate("alpha", F.lit(0.0), lambda acc, a: acc + a)
    return (
        counts.groupBy("cell")
        .agg(F.array(*alpha).alias("alpha"))
        .select(
            "cell",
            "alpha",
            F.transform("alpha", lambda a: a / total).alias("theta"),
            (F.array_position("alpha", F.array_max("alpha")) - 1).cast("int").alias("prediction"),
        )
    )


def grid_predict(
    binned: DataFrame, predictive: DataFrame, n_factors: int, n_bins: int, bins: str = "bins"
) -> DataFrame:
    """Adds ``prediction``; an unvisited cell is uniform and so predicts 0."""
    table = predictive.select("cell", "prediction")
    if n_bins**n_factors <= BROADCAST_CELLS:
        table = F.broadcast(table)
    return (
        binned.withColumn("cell", cell_of(F.col(bins), n_bins))
        .join(table, "cell", "left")
        .withColumn("prediction", F.coalesce("prediction", F.lit(0)))
    )


def state_reduction(raw_dim: int, n_factors: int, n_bins: int = 5) -> tuple[int, int]:
    """(cells of the raw grid, cells of the reduced grid)."""
    return n_bins**raw_dim, n_bins**n_factors


def accuracy(predicted: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: rows, share predicted right, share of the most frequent outcome."""
    per_class = predicted.groupBy(F.col(outcome).alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("prediction") == F.col(outcome)).cast("long")).alias("hits"),
    )
    return per_class.agg(
        F.sum("n").alias("n_rows"),
        F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy"),
        F.try_divide(F.max("n"), F.sum("n")).alias("majority_baseline"),
    )
