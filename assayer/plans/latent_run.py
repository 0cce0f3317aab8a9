"""Fit on the first rows, evaluate on the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assayer.operators import latent
from assayer.operators.quantiles import split_ordered


def hold_out_evaluation(
    signals: DataFrame,
    raw_dim: int,
    order_key: str = "id",
    fraction: float = 0.7,
    n_components: int = 3,
    n_bins: int = 5,
    n_outcomes: int = 5,
) -> DataFrame:
    """Report of a model fitted on the first ``fraction`` of rows by ``order_key``."""
    train, test = split_ordered(signals, order_key, fraction)
    projection = latent.fit_projection(train, n_components, n_bins)
    counts = latent.update_grid(projection, train, n_outcomes)
    predicted = latent.predict(projection, counts, test, n_outcomes)
    return latent.evaluation_report(projection, predicted, raw_dim)
