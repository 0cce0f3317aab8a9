"""Conjugate counting, posterior table, and lookup of full or partial evidence.

Data size only matters in :func:`conjugate_counts` (one partial/final
aggregate with at most 625 groups) and :func:`resolve` (one broadcast join with
at most 216 rows).  Everything between works on fixed-size tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import ordinal
from assayer.functions.beta import beta_quantile
from assayer.schema import LEVELS, N_CONTEXTS, N_LEVELS
from assayer.session import shuffle_partitions

OUTCOMES = range(N_LEVELS)


@dataclass(frozen=True)
class Prior:
    """Shape of the informative prior; ``strength=0`` makes it flat."""

    strength: float = 8.0
    spread: float = 1.0


def contexts(spark: SparkSession) -> DataFrame:
    """The 125 combinations of parent levels."""
    task, data, tool = ordinal.context_levels(F.col("ctx"))
    return spark.range(N_CONTEXTS).select(F.col("id").cast("int").alias("ctx")).select(
        "ctx", task.alias("task"), data.alias("data"), tool.alias("tool")
    )


def prior_table(spark: SparkSession, prior: Prior = Prior()) -> DataFrame:
    """(ctx, task, data, tool, alpha): 1 plus a bump around the mean level."""
    centre = (F.col("task") + F.col("data") + F.col("tool")) / 12.0 * 4.0
    bump = F.array(
        *[F.exp(-0.5 * F.pow((F.lit(float(k)) - centre) / prior.spread, F.lit(2.0))) for k in OUTCOMES]
    )
    total = F.aggregate("bump", F.lit(0.0), lambda acc, b: acc + b)
    return (
        contexts(spark)
        .withColumn("bump", bump)
        .withColumn("alpha", F.transform("bump", lambda b: 1.0 + prior.strength * b / total))
        .drop("bump")
    )


def split_valid(observations: DataFrame, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with the first offending column).

    With ``partial`` the rows are evidence: they need no outcome, and a NULL level is one not observed.
    """
    def offends(c: str) -> Column:
        wrong = ~ordinal.is_level(F.col(c))
        return wrong & F.col(c).isNotNull() if partial else wrong

    bad = F.coalesce(*[F.when(offends(c), F.lit(c)) for c in ([*LEVELS] if partial else [*LEVELS, "outcome"])])
    marked = observations.withColumn("bad_column", bad)
    return (
        marked.where(F.col("bad_column").isNull()).drop("bad_column"),
        marked.where(F.col("bad_column").isNotNull()),
    )


def conjugate_counts(observations: DataFrame, strict: bool = True) -> DataFrame:
    """(task, data, tool, outcome, n).  ``count`` is optional and defaults to 1."""
    keys = [*LEVELS, "outcome"]
    weight = F.col("count") if "count" in observations.columns else F.lit(1)
    if strict:
        levels = [ordinal.checked_level(F.col(c), c).alias(c) for c in keys]
    else:
        observations, _ = split_valid(observations)
        levels = [F.col(c) for c in keys]
    return (
        observations.select(*levels, F.coalesce(weight, F.lit(1)).cast("long").alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )


def posterior_alpha(prior: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Prior plus counts; no counts gives back the prior.  Always 125 rows."""
    if counts is None:
        return prior
    seen = counts.groupBy(*LEVELS).agg(
        *[F.sum(F.when(F.col("outcome") == k, F.col("n"))).alias(f"n{k}") for k in OUTCOMES]
    )
    added = F.array(*[F.coalesce(F.col(f"n{k}"), F.lit(0)).cast("double") for k in OUTCOMES])
    # at most 125 rows on the right: one per context
    return prior.join(F.broadcast(seen), LEVELS, "left").select(
        "ctx", *LEVELS, F.zip_with("alpha", added, lambda a, n: a + n).alias("alpha")
    )


def posterior_from(
    observations: DataFrame, prior: Prior = Prior(), strict: bool = True
) -> DataFrame:
    return posterior_alpha(
        prior_table(observations.sparkSession, prior), conjugate_counts(observations, strict)
    )


def cpt(alpha: DataFrame) -> DataFrame:
    """(ctx, task, data, tool, theta): predictive distribution per context."""
    return alpha.select("ctx", *LEVELS, _theta().alias("theta"))


def _theta() -> Column:
    total = F.aggregate("alpha", F.lit(0.0), lambda acc, a: acc + a)
    return F.transform("alpha", lambda a: a / total)


def cpt_long(alpha: DataFrame) -> DataFrame:
    """(ctx, task, data, tool, outcome, p), 625 rows."""
    return cpt(alpha).select(
        "ctx", *LEVELS, F.posexplode("theta").alias("outcome", "p")
    )


def cpt_check(alpha: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per context: does the column sum to one, is every concentration positive?"""
    total = F.aggregate("theta", F.lit(0.0), lambda acc, p: acc + p)
    return (
        alpha.withColumn("theta", _theta())
        .select("ctx", total.alias("p_sum"), F.array_min("alpha").alias("alpha_min"))
        .withColumn("valid", (F.abs(F.col("p_sum") - 1.0) <= tolerance) & (F.col("alpha_min") > 0))
    )


def marginal_cube(alpha: DataFrame) -> DataFrame:
    """Predictive for each of the 216 evidence patterns; NULL means unobserved.

    An unobserved parent is averaged out with equal weights, which is what
    ``cube`` does when every context is present exactly once.
    """
    a = [F.col("alpha")[k] for k in OUTCOMES]
    total = a[0] + a[1] + a[2] + a[3] + a[4]
    flat = alpha.select(
        *LEVELS,
        total.alias("total"),
        *[a[k].alias(f"a{k}") for k in OUTCOMES],
        *[(a[k] / total).alias(f"t{k}") for k in OUTCOMES],
    )
    return (
        flat.cube(*LEVELS)
        .agg(
            *[F.avg(f"t{k}").alias(f"t{k}") for k in OUTCOMES],
            *[F.avg(f"a{k}").alias(f"a{k}") for k in OUTCOMES],
            F.avg("total").alias("ess"),
        )
        .select(
            *LEVELS,
            F.array(*[F.col(f"t{k}") for k in OUTCOMES]).alias("theta"),
            F.array(*[F.col(f"a{k}") for k in OUTCOMES]).alias("alpha"),
            "ess",
        )
    )


def _normal_interval(a: Column, rest: Column, mass: float) -> tuple[Column, Column]:
    z = 1.96 if mass == 0.95 else NormalDist().inv_cdf((1.0 + mass) / 2.0)
    total = a + rest
    mean = a / total
    sd = F.sqrt(a * rest / (total * total * (total + 1.0)))
    return F.greatest(F.lit(0.0), mean - z * sd), F.least(F.lit(1.0), mean + z * sd)


def resolutions(alpha: DataFrame, interval: str = "normal", mass: float = 0.95) -> DataFrame:
    """Most likely state, confidence, interval and sample size per evidence pattern.

    ``interval`` is ``'beta'`` (exact quantiles) or ``'normal'``.  Probabilities
    are compared at 12 decimals so that sums taken in different order cannot
    break a tie; the lowest index wins.
    """
    if interval not in ("normal", "beta"):
        raise ValueError("interval must be 'normal' or 'beta'")
    ranked = F.transform("theta", lambda p: F.round(p, 12))
    top = marginal_cube(alpha).withColumn("state_index", ordinal.first_argmax(ranked))
    top = top.withColumn("a", F.get("alpha", F.col("state_index"))).withColumn(
        "rest", F.col("ess") - F.col("a")
    )
    if interval == "normal":
        low, high = _normal_interval(F.col("a"), F.col("rest"), mass)
    else:
        # 216 rows, but each a long computation: every task gets some
        top = top.repartition(shuffle_partitions(alpha.sparkSession), *LEVELS)
        tail = (1.0 - mass) / 2.0
        low, high = (beta_quantile(p, F.col("a"), F.col("rest")) for p in (tail, 1.0 - tail))
    return top.select(
        *LEVELS,
        ordinal.state_name(F.col("state_index")).alias("state"),
        "state_index",
        F.get("theta", F.col("state_index")).alias("confidence"),
        ordinal.good_probability(F.col("theta")).alias("good_probability"),
        ordinal.is_conflict_state(F.col("state_index")).alias("is_conflict"),
        "theta",
        low.alias("credible_low"),
        high.alias("credible_high"),
        F.col("ess").alias("effective_sample_size"),
    )


def resolve(evidence: DataFrame, table: DataFrame, strict: bool = True) -> DataFrame:
    """Attach the resolution of its (full or partial) evidence to every row.

    The table has 216 rows by construction, so it is broadcast; null-safe
    equality on the three levels still plans as a hash join.
    """
    if strict:
        evidence = evidence.withColumns(
            {c: ordinal.checked_level(F.col(c), c, nullable=True) for c in LEVELS}
        )
    right = table.withColumnsRenamed({c: f"_{c}" for c in LEVELS})
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
    return evidence.join(F.broadcast(right), match, "left").drop(*[f"_{c}" for c in LEVELS])


def network_query(
    alpha: DataFrame, target: str, evidence: dict[str, int] | None = None
) -> DataFrame:
    """P(target | evidence) in the joint of the three parents and the outcome.

    Parents are uniform, so each of the 625 cells weighs p / 125.  ``target`` and
    the evidence keys are among task, data, tool, outcome.
    """
    joint = cpt_long(alpha).select(*LEVELS, "outcome", (F.col("p") / N_CONTEXTS).alias("p"))
    known = {*LEVELS, "outcome"}
    for name, level in (evidence or {}).items():
        if name in known:
            joint = joint.where(F.col(name) == level)
    mass = joint.groupBy(F.col(target).cast("int").alias("level")).agg(F.sum("p").alias("p"))
    # at most five rows
    whole = F.sum("p").over(Window.partitionBy(F.lit(0)))
    return mass.select("level", (F.col("p") / whole).alias("p"))


def evidence_histogram(evidence: DataFrame) -> DataFrame:
    """Rows per context, 0 for contexts that never occur."""
    seen = (
        evidence.where(F.col("task").isNotNull() & F.col("data").isNotNull() & F.col("tool").isNotNull())
        .groupBy(*LEVELS)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        contexts(evidence.sparkSession)
        .join(F.broadcast(seen), LEVELS, "left")
        .select("ctx", *LEVELS, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )
