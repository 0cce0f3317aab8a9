"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words (present or not) and word beginnings (how often, by
the square root of the text's words) is trained from confirmed toxic texts and a
sample of all texts without regard to labels. The risk is the
class-prior-corrected one: what unlabelled texts lose as negatives, less what
positives would add to it, is kept from falling below zero by descending the other
way whenever it does.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import in_fold, whole_text
from assayer.session import settled

BUCKETS = 1 << 18
#: Bounds of the samples that the model is fitted on.
POSITIVE_ROWS = 3_000
UNLABELLED_ROWS = 9_000
#: Used where no labelled row tells the share of toxic texts.
DEFAULT_PRIOR = 0.1
#: A bucket that fewer toxic texts hold gets no weight; so many get one, by their share in the likelihood ratio.
LEAST_TEXTS = 3
WEIGHTED = 400
#: Lengths of word beginnings, in bytes.
BEGINNINGS = range(3, 9)

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their values, as described above."""
    words = Counter(_WORD.findall(text.lower()))
    found: dict[int, float] = {}
    scale = 1 / max(1, words.total()) ** 0.5
    for word, times in words.items():
        raw = word.encode()
        at = zlib.crc32(raw[: BEGINNINGS.start - 1])
        for k in BEGINNINGS:
            if len(raw) < k:
                break
            at = zlib.crc32(raw[k - 1 : k], at)
            bucket = at % BUCKETS
            found[bucket] = found.get(bucket, 0) + times * scale
        found[BUCKETS + zlib.crc32(raw) % BUCKETS] = 1
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        margin = np.array([self.weights[at] @ values for at, values in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(
    positive: list[tuple[np.ndarray, np.ndarray]],
    unlabelled: list[tuple[np.ndarray, np.ndarray]],
    prior: float,
    steps: int = 200,
    rate: float = 0.1,
    ridge: float = 1e-4,
) -> Linear:
    """Minimises ``prior * P[l(z)] + max(0, U[l(-z)] - prior * P[l(-z)])`` for the logistic loss ``l``."""
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Linear(np.zeros(2 * BUCKETS), bias)
    rows = positive + unlabelled
    n, p = len(rows), len(positive)
    flat = np.concatenate([at for at, _ in rows]).astype(np.int64)  # of an empty list the type is lost
    value = np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(n), [len(at) for at, _ in rows])
    columns, at = np.unique(flat, return_inverse=True)
    share = np.r_[np.full(p, 1 / p), np.full(n - p, 1 / (n - p))]
    is_p = np.arange(n) < p

    w, moment, square = (np.zeros(len(columns) + 1) for _ in range(3))
    w[-1] = bias
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[:-1][at] * value, minlength=n) + w[-1]
        falls, rises = -_sigmoid(-z), _sigmoid(z)  # derivatives of l(z) and of l(-z)
        loss = share * np.logaddexp(0, z)
        negative = loss[~is_p].sum() - prior * loss[is_p].sum()
        corrected = share * np.where(is_p, -prior * rises, rises)
        g = share * np.where(is_p, prior * falls, 0) + corrected if negative >= 0 else -corrected
        gradient = np.r_[np.bincount(at, weights=g[row] * value, minlength=len(columns)) + ridge * w[:-1], g.sum()]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w = w - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(2 * BUCKETS)
    weights[columns] = w[:-1]
    return Linear(weights, float(w[-1]))


def _measured(docs: DataFrame) -> DataFrame:
    def measure(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            yield pd.DataFrame([features(t) for t in texts], columns=["at", "value"])

    measure.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.select("doc_id", F.pandas_udf(measure, "at array<int>, value array<float>")("text").alias("x"))


def telling(sample: DataFrame) -> list[int]:
    """The buckets that get a weight, from rows ``p, at, value``, summed by Spark."""
    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    if len(sizes) < 2:
        return []
    each = sample.select("p", F.explode(F.arrays_zip("at", "value")).alias("e")).select("p", "e.*")
    value = F.col("value").cast("double")
    sums = each.groupBy("at").agg(
        (F.sum(F.when(F.col("p"), value).otherwise(0.0)) / sizes[True]).alias("mean_p"),
        (F.sum(F.when(F.col("p"), 0.0).otherwise(value)) / sizes[False]).alias("mean_u"),
        F.sum(F.col("p").cast("long")).alias("holders"),
    )
    ratio = (F.col("mean_p") + 0.5 / sizes[True]) / (F.col("mean_u") + 0.5 / sizes[False])
    gain = sums.where(F.col("holders") >= LEAST_TEXTS).select("at", (F.col("mean_p") * F.ln(ratio)).alias("gain"))
    return [r["at"] for r in gain.where("gain > 0").orderBy(F.desc("gain"), "at").limit(WEIGHTED).collect()]


def _sample(ids: DataFrame, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` ids, those of the smallest hashes."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 4,
    fold: int = 2,
    threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Fitted outside the held-out fold, on at most ``POSITIVE_ROWS`` toxic and
    ``UNLABELLED_ROWS`` other texts; the class prior comes from all labelled rows. Of several
    labels of one document the greatest counts; NULL labels do not, NULL and empty texts
    score what no word gives. Without positives every score is the prior.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    learning = rows.where(~in_fold("doc_id", folds, fold) & F.col("doc_id").isNotNull())
    truth = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    truth = truth.where(~in_fold("doc_id", folds, fold))
    known = truth.agg(F.count("*").alias("n"), F.sum((F.col("label") == 1).cast("long")).alias("p")).first()
    prior = float(np.clip((known["p"] or 0) / known["n"], 0.001, 0.9)) if known["n"] else DEFAULT_PRIOR

    # the bound on both samples bounds this broadcast
    ids = learning.select("doc_id").distinct()
    positive = _sample(ids.join(truth.where("label = 1"), "doc_id", "left_semi"), POSITIVE_ROWS, "p").withColumn("p", F.lit(True))
    unlabelled = _sample(ids, UNLABELLED_ROWS, "u").withColumn("p", F.lit(False))
    chosen = settled(positive.unionByName(unlabelled), "sample")
    texts = learning.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sample = settled(_measured(texts), "features").join(F.broadcast(chosen), "doc_id").select("p", "x.at", "x.value")
    # only what gets a weight goes to the driver
    buckets = telling(sample)
    weighed = F.filter(F.arrays_zip("at", "value"), lambda e: e["at"].isin(buckets))
    sample = sample.select("p", weighed.alias("e")).select("p", "e.at", "e.value").toPandas()
    sets = {p: list(zip(g["at"], g["value"], strict=True)) for p, g in sample.groupby("p")}
    model = fit(sets.get(True, []), sets.get(False, []), prior)
    return rows.select(
        "doc_id", in_fold("doc_id", folds, fold).alias("held_out"), scored(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(model: Linear, text: Column) -> Column:
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(model.score([features(t) for t in texts]), dtype=float)

    score.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)
