"""Reduce, then reason: standardise, PCA, quantile bins, conjugate grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import grid
from assayer.operators.quantiles import bin_of, quantiles


def pca_projector(n_components: int) -> Estimator:
    """Standardise (mean 0, deviation 1; constant columns become 0), then PCA."""
    return Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="scaled"),
            PCA(k=n_components, inputCol="scaled", outputCol="latent"),
        ]
    )


def _sign(seed: int, axis: int, place: Column) -> Column:
    """1 or -1 for an axis and a dimension, by a rule that any engine can follow."""
    mixed = ((place * 73 + axis * 31 + seed * 17 + 1) * 48_271) % 2_147_483_647
    mixed = (mixed * 48_271) % 2_147_483_647
    return F.when(mixed % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


class RandomSigns(Estimator):
    """Random projection onto ``k`` axes of signs, each divided by the root of the dimension.

    Nothing is learnt but the dimension, so any two fits with one seed agree, and the projection
    needs no table: the signs follow from the seed.
    """

    def __init__(self, k: int, seed: int = 0, inputCol: str = "raw", outputCol: str = "latent"):  # noqa: N803
        super().__init__()
        self.k, self.seed, self.columns = k, seed, (inputCol, outputCol)

    def _fit(self, dataset: DataFrame) -> RandomSignsModel:
        return RandomSignsModel(self.k, self.seed, self.columns)


class RandomSignsModel(Transformer):
    def __init__(self, k: int, seed: int, columns: tuple[str, str]):
        super().__init__()
        self.k, self.seed, self.columns = k, seed, columns

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = vector_to_array(F.col(self.columns[0]))

        def axis(number: int) -> Column:
            signed = F.transform(values, lambda x, i: x * _sign(self.seed, number, i.cast("long")))
            return F.aggregate(signed, F.lit(0.0), lambda total, x: total + x) / F.sqrt(F.size(values))

        return dataset.withColumn(self.columns[1], array_to_vector(F.array(*[axis(n) for n in range(self.k)])))


@dataclass
class LatentProjection:
    """A fitted projection: the model, axis signs, and bin edges per axis.

    All of it is small (features x components and components x bins) and is
    fitted once, so it lives on the driver like any Spark ML model.
    """

    model: PipelineModel
    signs: list[float]
    n_bins: int
    edges: list[list[float]] = field(default_factory=list)

    @property
    def n_components(self) -> int:
        return len(self.signs)

    def project(self, df: DataFrame, signals: str = "signals") -> DataFrame:
        """Adds ``z``, the latent coordinates as an array."""
        prepared = df.withColumn("raw", array_to_vector(F.col(signals)))
        latent = self.model.transform(prepared).withColumn("_z", vector_to_array("latent"))
        z = F.array(*[F.get("_z", F.lit(i)) * s for i, s in enumerate(self.signs)])
        return latent.withColumn("z", z).drop("raw", "scaled", "latent", "_z")

    def to_bins(self, df: DataFrame, signals: str = "signals") -> DataFrame:
        """Adds ``bins``, one bin number per axis."""
        axes = [
            bin_of(F.get("z", F.lit(i)), [F.lit(e) for e in edges]) for i, edges in enumerate(self.edges)
        ]
        return self.project(df, signals).withColumn("bins", F.array(*axes)).drop("z")

    def axes(self) -> list[tuple[int, int, float]]:
        """(axis, dimension, loading) of a linear projector that has principal components, signs applied."""
        loadings = self.model.stages[-1].pc.toArray()
        return [(k, j, float(loadings[j, k] * s)) for k, s in enumerate(self.signs) for j in range(len(loadings))]

    def explained_variance(self) -> float | None:
        """Share of variance kept, where the projector reports one."""
        last = self.model.stages[-1]
        return float(np.sum(last.explainedVariance.toArray())) if hasattr(last, "explainedVariance") else None


def _axis_signs(model: PipelineModel, n_components: int) -> list[float]:
    """Signs that make the largest loading of each axis positive.

    A principal axis is only defined up to its sign; fixing it makes refits agree.
    """
    last = model.stages[-1]
    if not hasattr(last, "pc"):
        return [1.0] * n_components
    loadings = last.pc.toArray()
    peaks = loadings[np.abs(loadings).argmax(axis=0), np.arange(n_components)]
    return [1.0 if p >= 0 else -1.0 for p in peaks]


def quantile_edges(df: DataFrame, values: str, n_axes: int, n_bins: int) -> DataFrame:
    """(axis, fraction, value): inner bin edges of each element of an array column."""
    axes = df.select(F.posexplode(F.slice(values, 1, n_axes)).alias("axis", "z"))
    return quantiles(axes, "z", [i / n_bins for i in range(1, n_bins)], by=["axis"])


def with_bins(df: DataFrame, values: str, edges: DataFrame, n_axes: int, n_bins: int) -> DataFrame:
    """Adds ``bins`` from an edge table, which stays inside the plan as one scalar."""
    # n_axes arrays of n_bins - 1 numbers
    row = edges.agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("axis") == a, F.col("value")))).alias(f"e{a}")
            for a in range(n_axes)
        ]
    )
    found = row.select(F.struct("*")).scalar()
    axes = [
        bin_of(F.get(values, F.lit(a)), [F.get(found[f"e{a}"], F.lit(i)) for i in range(n_bins - 1)])
        for a in range(n_axes)
    ]
    return df.withColumn("bins", F.array(*axes))


def fit_projection(
    train: DataFrame,
    n_components: int = 3,
    n_bins: int = 5,
    signals: str = "signals",
    projector: Estimator | None = None,
) -> LatentProjection:
    """Learn scaling, axes and bin edges from the training rows.

    ``projector`` may be any estimator from vector column ``raw`` to vector
    column ``latent``.
    """
    estimator = projector or pca_projector(n_components)
    model = estimator.fit(train.select(array_to_vector(F.col(signals)).alias("raw")))
    if not isinstance(model, PipelineModel):
        model = PipelineModel([model])
    fitted = LatentProjection(model, _axis_signs(model, n_components), n_bins)
    table = quantile_edges(fitted.project(train, signals), "z", n_components, n_bins)
    # n_components x (n_bins - 1) numbers
    edges = {(r["axis"], r["fraction"]): r["value"] for r in table.collect()}
    fitted.edges = [
        [edges[axis, i / n_bins] for i in range(1, n_bins)] for axis in range(n_components)
    ]
    return fitted


def update_grid(
    projection: LatentProjection, df: DataFrame, n_outcomes: int = 5, signals: str = "signals"
) -> DataFrame:
    """Grid counts of labelled signals."""
    return grid.grid_counts(projection.to_bins(df, signals), projection.n_bins, n_outcomes)


def predict(
    projection: LatentProjection,
    counts: DataFrame,
    df: DataFrame,
    n_outcomes: int = 5,
    signals: str = "signals",
) -> DataFrame:
    """Adds ``bins``, ``cell`` and ``prediction``."""
    table = grid.grid_predictive(counts, n_outcomes)
    return grid.grid_predict(
        projection.to_bins(df, signals), table, projection.n_components, projection.n_bins
    )


def evaluation_report(
    projection: LatentProjection, predicted: DataFrame, raw_dim: int, outcome: str = "outcome"
) -> DataFrame:
    """One row with sizes, variance kept, accuracy and majority baseline.

    The number of raw states is a decimal text, as it outgrows every number type; the
    ratio of compression is given as its logarithm.
    """
    naive, reduced = grid.state_reduction(raw_dim, projection.n_components, projection.n_bins)
    variance = projection.explained_variance()
    return grid.accuracy(predicted, outcome).select(
        F.lit(raw_dim).alias("raw_dim"),
        F.lit(str(naive)).alias("naive_raw_states"),
        F.lit(math.log10(naive)).alias("log10_naive_raw_states"),
        F.lit(reduced).cast("long").alias("latent_states"),
        F.lit(math.log10(naive) - math.log10(reduced)).alias("log10_compression_ratio"),
        F.lit(None if variance is None else round(variance, 3)).cast("double").alias("explained_variance"),
        F.round("accuracy", 3).alias("test_accuracy"),
        F.round("majority_baseline", 3).alias("majority_baseline"),
    )
