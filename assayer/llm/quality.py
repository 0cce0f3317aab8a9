"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a dozen transformed statistics. Class means and covariances come
from sums over all labelled rows of the learning folds, taken by Spark; covariances
are shrunk to the pooled one and to a sphere. The score is the posterior from the
difference of Gaussian log-densities, each by the cached Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import in_fold, whole_text
from assayer.session import settled

FEATURES = (
    "log_words",
    "symbols",
    "exclamations",
    "capitals",
    "repeats",
    "distinct",
    "word_length",
    "digits",
    "stops",
    "line_length",
    "common_lines",
)
SHRINK_TO_POOLED = 0.05
SHRINK_TO_SPHERE = 0.02
#: Added to variances: statistics differ by no less than this.
NOISE = 1e-3

_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]", dtype=np.uint8)


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; an empty one has those of no words."""
    raw = text.encode()
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    capitals, small = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = text.split("\n")
    return [
        np.log1p(len(words)),
        np.sqrt(seen[_SYMBOLS].sum() / size),
        np.sqrt(seen[33] / size),
        np.sqrt(capitals / max(1, capitals + small)),
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.log((len(set(words)) + 1) / (n + 1)),
        np.log((len(text) + 1) / n),
        np.sqrt(seen[48:58].sum() / size),
        np.sqrt((seen[46] + seen[44]) / n),
        np.log1p(len(text) / len(lines)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
    ]


def with_statistics(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, x`` and the columns to carry: the statistics of every row, NULL texts as empty ones."""
    return docs.select(F.col(doc_id).alias("doc_id"), *carry, statistics_of(text).alias("x"))


def statistics_of(text: str) -> Column:
    def measure(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([statistics(t) for t in texts])

    measure.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(measure, "array<double>")(whole_text(text))


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean and inverse Cholesky factor; ``None`` where a class has no rows."""

    log_priors: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:  # one class at most was seen: its prior is all that is known
            return np.full(len(x), 1 / (1 + np.exp(self.log_priors[0] - self.log_priors[1])))
        density = []
        for prior, mean, factor in zip(self.log_priors, self.means, self.factors, strict=True):
            whitened = (x - mean) @ factor.T
            density.append(prior + np.log(np.diag(factor)).sum() - 0.5 * (whitened**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, label: str = "label") -> Discriminant:
    """From rows ``x, label`` by sums that Spark takes over all of them."""
    d = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()
    by_class = {int(r[label]): r for r in found}
    n = np.array([by_class[k]["n"] if k in by_class else 0 for k in (0, 1)], dtype=float)
    log_priors = tuple(np.log((n + 1) / (n.sum() + 2)))
    if not n.all():
        return Discriminant(log_priors, None, None)
    means, scatters = [], []
    for k in (0, 1):
        row = by_class[k]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = row[f"p{i}_{j}"] / n[k]
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    pooled = (n[0] * scatters[0] + n[1] * scatters[1]) / n.sum()
    factors = []
    for scatter in scatters:
        own = (1 - SHRINK_TO_POOLED) * scatter + SHRINK_TO_POOLED * pooled
        own = (1 - SHRINK_TO_SPHERE) * own + SHRINK_TO_SPHERE * np.diag(np.diag(pooled)) + NOISE * np.eye(d)
        factors.append(np.linalg.inv(np.linalg.cholesky(own)))
    return Discriminant(log_priors, tuple(means), tuple(factors))


def scored(model: Discriminant, x: Column) -> Column:
    def score(series: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(series.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    score.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(x)


def learnt(rows: DataFrame, labels: DataFrame, label: str, doc_id: str, folds: int, fold: int) -> Discriminant:
    """The model of the labelled rows ``doc_id, x`` outside the held-out fold."""
    truth = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    return fit(rows.where(~in_fold("doc_id", folds, fold)).join(truth, "doc_id"))


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 4,
    fold: int = 2,
    threshold: float = 0.7,
) -> DataFrame:
    """The rows of ``docs``, all their columns, that :func:`quality_scores` predicts to be good.

    Statistics are taken twice, to learn and to decide, so that no text is moved or written. Each row
    is judged by its own text, whatever its id; clashing column names do no harm.
    """
    model = learnt(with_statistics(docs, doc_id, text), labels, label, doc_id, folds, fold)
    return docs.where(scored(model, statistics_of(text)) >= threshold)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 4,
    fold: int = 2,
    threshold: float = 0.7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, behind ``doc_id`` the columns to carry.

    Learns from all labelled rows outside the held-out fold. Of several labels of
    one document the greatest counts; NULL labels do not. Repeated rows are scored each.
    Without rows of both classes every score is the prior.
    """
    rows = settled(with_statistics(docs, doc_id, text, carry), "statistics")
    model = learnt(rows, labels, label, doc_id, folds, fold)
    return rows.select(
        "doc_id", *carry, in_fold("doc_id", folds, fold).alias("held_out"), scored(model, F.col("x")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
