"""How far do the repeated answers to one question agree?

Mean pairwise cosine and medoid need no pairs.  With unit vectors u_i and their
sum S, the cosines of sample i with all others add up to ``u_i . S - 1``, and
the total over all samples is ``S . S`` less one per non-empty sample.  So one
number per sample, ``u_i . S``, carries both results.

Ordinary questions: rows are shuffled once, by question; the per-token sums, the
per-sample sums and the per-question results then all run inside the partition.
Heavy questions, by samples or by bytes (see :mod:`assayer.operators.skew`): the tokens are spread over
(question, token), pre-aggregated, and joined back with a salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import ordinal, text
from assayer.operators.skew import MIN_HEAVY_ROWS, MIN_HEAVY_WEIGHT, join_lookup, split_heavy

STEP = ["run_id", "step_idx"]


def bag_of_words(samples: DataFrame, column: str = "answer") -> DataFrame:
    """One row per (sample, token) with its count; the row's other columns stay."""
    rest = [c for c in samples.columns if c != column]
    words = samples.select(*rest, text.tokens(F.col(column)).alias("_words"))
    counted = words.select(*rest, F.inline_outer(text.bag(F.col("_words"))))
    return counted.where(F.col("token").isNotNull())


def _bags(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace texts by bags; in two steps, so that each text is split once."""
    rest = [c for c in df.columns if c not in columns]
    words = df.select(*rest, *[text.tokens(F.col(c)).alias(name) for c, name in columns.items()])
    return words.select(*rest, *[text.bag(F.col(name)).alias(name) for name in columns.values()])


def sample_norms(samples: DataFrame, column: str = "answer") -> DataFrame:
    """Token count, distinct tokens and vector length per sample."""
    rest = [c for c in samples.columns if c != column]
    return _bags(samples, {column: "_bag"}).select(
        *rest,
        F.aggregate("_bag", F.lit(0), lambda acc, e: acc + e["tf"]).alias("n_tokens"),
        F.size("_bag").alias("n_distinct"),
        text.bag_norm(F.col("_bag")).alias("norm"),
    )


def pair_cosine(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine and number of shared tokens of two texts in the same row."""
    rest = [c for c in pairs.columns if c not in (left, right)]
    return _bags(pairs, {left: "_a", right: "_b"}).select(
        *rest,
        text.bag_cosine(F.col("_a"), F.col("_b")).alias("cosine"),
        F.size(text.shared_tokens(F.col("_a"), F.col("_b"))).alias("n_shared"),
    )


def text_vectors(samples: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds ``vector`` (bag of words), its ``length``, and what the report needs."""
    clean = samples.withColumn(answer, text.strip(F.coalesce(F.col(answer), F.lit(""))))
    read = clean.withColumns(
        {"_words": text.tokens(F.col(answer)), "_normal": text.normalise(F.col(answer))}
    )
    bags = read.withColumns(
        {
            "vector": text.bag(F.col("_words")),
            "usable": (~text.is_refusal(F.col(answer), F.size("_words"))).cast("double"),
            "form": text.bounded_key(F.col("_normal")),
        }
    )
    return bags.withColumn("length", text.bag_norm(F.col("vector"))).drop("_words", "_normal")


def array_vectors(samples: DataFrame, values: str) -> DataFrame:
    """Adds ``vector`` and ``length`` for numeric arrays (embeddings), an entry per dimension.

    A zero vector counts as empty.  Every sample is usable and its own form.
    """
    entries = F.transform(
        values, lambda x, i: F.struct(i.cast("string").alias("token"), x.cast("double").alias("tf"))
    )
    sized = samples.withColumn("vector", entries).withColumn("length", text.bag_norm(F.col("vector")))
    return sized.withColumns(
        {
            "vector": F.when(F.col("length") > 0, F.col("vector")).otherwise(F.slice("vector", 1, 0)),
            "usable": F.lit(1.0),
            "form": F.sha2(F.to_json(F.struct(values)), 256),
            "answer": F.lit(None).cast("string"),
        }
    ).drop(values)


def _entries(vectors: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """One row per (sample, token); the first also carries the sample's attributes.

    An empty sample gets one entry of weight 0 under a token of its own, which
    adds nothing and keeps empty samples apart from each other.
    """
    attrs = F.struct("usable", "form", "answer", (F.size("vector") > 0).cast("int").alias("filled"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return (
        vectors.select(*keys, idx, "length", attrs.alias("attrs"), F.posexplode_outer("vector"))
        .select(
            *keys,
            idx,
            F.coalesce(
                text.bounded_key(F.col("col.token")), F.concat(F.lit("#"), F.col(idx))
            ).alias("token"),
            F.coalesce(F.col("col.tf") / F.col("length"), F.lit(0.0)).alias("w"),
            F.when(first, F.col("attrs")).alias("attrs"),
        )
    )


def _per_sample(scored: DataFrame, keys: list[str], idx: str) -> DataFrame:
    return (
        scored.groupBy(*keys, idx)
        .agg(
            F.sum(F.col("w") * F.col("s")).alias("dot"),
            F.first("attrs", ignorenulls=True).alias("attrs"),
        )
        .select(*keys, idx, "dot", "attrs.*")
        .withColumn("score", F.round(F.col("dot") - F.col("filled"), 9))
    )


def _per_question(samples: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Aggregates only, so a heavy question is combined before it is shuffled."""
    best = F.max_by(F.struct(F.col(idx), F.col("answer")), F.struct(F.col("score"), -F.col(idx)))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("dot").alias("dots"),
        F.sum("filled").alias("filled"),
        F.avg("usable").alias("answerability"),
        F.countDistinct("form").alias("n_distinct"),
        best.alias("best"),
        F.max("score").alias("medoid_score"),
    )


def _ordinary_scores(vectors: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """For rows already partitioned by ``keys``: nothing below shuffles again."""
    total = F.sum("w").over(Window.partitionBy(*keys, "token"))
    return _per_sample(_entries(vectors, keys, idx).withColumn("s", total), keys, idx)


def _heavy_scores(vectors: DataFrame, keys: list[str], idx: str, min_rows: int) -> DataFrame:
    """Tokens summed with a combined aggregate, then joined back past frequent ones."""
    rows = _entries(vectors, keys, idx)
    pair = [*keys, "token"]
    sums = rows.groupBy(*pair).agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("rows"))
    # true for every group; naming both results keeps the aggregate whole wherever
    # it is used, so that its uses share one exchange
    sums = sums.where(F.col("s").isNotNull() & (F.col("rows") > 0))
    joined = join_lookup(rows, sums.drop("rows"), pair, "inner", [idx], min_rows, sums.drop("s"))
    return _per_sample(joined, keys, idx)


def vector_agreement(
    samples: DataFrame,
    vectorise: Callable[[DataFrame], DataFrame],
    keys: list[str] = STEP,
    idx: str = "sample_idx",
    min_heavy_rows: int = MIN_HEAVY_ROWS,
    weight: Column | None = None,
    min_heavy_weight: float = MIN_HEAVY_WEIGHT,
) -> DataFrame:
    """One row per question: size, consistency, answerability, dispersion, medoid.

    ``vectorise`` adds ``vector`` (array of (token, tf), maybe empty), its Euclidean
    ``length``, ``usable``, ``form`` and ``answer``; any similarity that is the cosine
    of sparse vectors fits.  It is applied after the shuffle, so that the raw rows
    travel and not the larger vectors.  ``idx`` is a number unique within the question.
    ``weight`` is a sample's size in bytes, so that a few huge answers make a question heavy too.
    """
    ordinary, heavy = split_heavy(samples, keys, min_heavy_rows, weight, min_heavy_weight)
    together = vectorise(ordinary.repartition(*keys))
    found = _per_question(_ordinary_scores(together, keys, idx), keys, idx).unionByName(
        _per_question(_heavy_scores(vectorise(heavy), keys, idx, min_heavy_rows), keys, idx)
    )
    n = F.col("n_samples")
    pairs = n * (n - 1)
    return found.select(
        *keys,
        "n_samples",
        F.when(n == 1, F.lit(1.0))
        .otherwise(F.round(F.try_divide(F.col("dots") - F.col("filled"), pairs), 9))
        .alias("consistency"),
        "answerability",
        "n_distinct",
        F.when(n == 1, F.lit(0.0))
        .otherwise(F.try_divide((F.col("n_distinct") - 1).cast("double"), n - 1))
        .alias("distinct_ratio"),
        F.col(f"best.{idx}").alias("medoid_idx"),
        F.col("best.answer").alias("answer"),
        "medoid_score",
    )


def step_agreement(
    samples: DataFrame,
    keys: list[str] = STEP,
    idx: str = "sample_idx",
    min_heavy_rows: int = MIN_HEAVY_ROWS,
    min_heavy_bytes: float = MIN_HEAVY_WEIGHT,
) -> DataFrame:
    """:func:`vector_agreement` of answer texts, plus the three evidence levels."""
    size = F.octet_length("answer")
    return with_evidence(vector_agreement(samples, text_vectors, keys, idx, min_heavy_rows, size, min_heavy_bytes))


def with_evidence(agreement: DataFrame) -> DataFrame:
    """Refusals, disagreement and dispersion as levels 0..4."""
    def level(bad: Column) -> Column:
        return ordinal.round_level(F.round(bad * 4.0, 9))

    return agreement.withColumns(
        {
            "task": level(1.0 - F.col("answerability")),
            "data": level(1.0 - F.col("consistency")),
            "tool": level(F.col("distinct_ratio")),
        }
    )
