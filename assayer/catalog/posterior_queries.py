"""Counting, posterior table, lookup of full and partial evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.catalog import sql as q
from assayer.catalog.registry import query, r6, spread
from assayer.functions.ordinal import context_index, distribution_map, state_name
from assayer.operators import posterior
from assayer.schema import LEVELS
from assayer.session import fresh_dir, settled
from assayer.sources.sinks import write_resolutions

_POSTERIOR = (q.E, q.PRIOR, q.COUNTS, q.ALPHA)


def learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.posterior_from(fx.observations(spark, sf_dir))


@query(q.with_parts(q.E, q.COUNTS) + "SELECT * FROM counts")
def conjugate_counts(spark, sf_dir):
    return posterior.conjugate_counts(fx.observations(spark, sf_dir))


@query(
    q.with_parts(*_POSTERIOR)
    + """SELECT task, data, tool, task * 25 + data * 5 + tool AS ctx,
      round(max(a) FILTER (outcome = 0), 6) AS a0, round(max(a) FILTER (outcome = 1), 6) AS a1,
      round(max(a) FILTER (outcome = 2), 6) AS a2, round(max(a) FILTER (outcome = 3), 6) AS a3,
      round(max(a) FILTER (outcome = 4), 6) AS a4
    FROM alpha GROUP BY task, data, tool"""
)
def posterior_alpha(spark, sf_dir):
    return learnt(spark, sf_dir).select("ctx", *LEVELS, *spread("alpha", "a"))


@query(
    q.with_parts(*_POSTERIOR)
    + """SELECT task, data, tool, task * 25 + data * 5 + tool AS ctx, outcome, round(p, 6) AS p FROM cpt"""
)
def posterior_cpt(spark, sf_dir):
    return posterior.cpt_long(learnt(spark, sf_dir)).withColumn("p", r6("p"))


@query(
    q.with_parts(*_POSTERIOR, q.CUBE)
    + """SELECT task, data, tool, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2,
      round(p3, 6) AS p3, round(p4, 6) AS p4, round(ess, 6) AS ess FROM resolved"""
)
def marginal_cube(spark, sf_dir):
    cube = posterior.marginal_cube(learnt(spark, sf_dir))
    return cube.select(*LEVELS, *spread("theta", "p"), r6("ess"))


_RESOLVED_SQL = """SELECT x.l_orderkey, x.l_linenumber, x.task, x.data, x.tool, r.state, r.state_index,
  round(r.confidence, 6) AS confidence, round(r.good_probability, 6) AS good_probability, r.is_conflict,
  round(r.p0, 6) AS p0, round(r.p1, 6) AS p1, round(r.p2, 6) AS p2, round(r.p3, 6) AS p3, round(r.p4, 6) AS p4,
  round(r.credible_low, 6) AS credible_low, round(r.credible_high, 6) AS credible_high,
  round(r.ess, 6) AS effective_sample_size
"""


def _report_table(table: DataFrame, digits: int = 6) -> DataFrame:
    """The resolution table in report form: shaped once on its 216 rows, not per row."""
    named = table.withColumn("named", distribution_map(F.col("theta")))
    by_name = [
        F.round(F.element_at("named", name), 6).alias(f"p{i}")
        for i, name in enumerate(("CERTAIN", "HIGH", "MEDIUM", "LOW", "AMBIGUOUS"))
    ]
    return named.select(
        *LEVELS, "state", "state_index", r6("confidence"), r6("good_probability"), "is_conflict", *by_name,
        *[F.round(c, digits).alias(c) for c in ("credible_low", "credible_high")], r6("effective_sample_size"),
    )


def _resolved(spark, sf_dir, evidence: DataFrame, interval: str = "normal", digits: int = 6) -> DataFrame:
    table = _report_table(posterior.resolutions(learnt(spark, sf_dir), interval), digits)
    return posterior.resolve(evidence.select("l_orderkey", "l_linenumber", *LEVELS), table)


@query(
    q.with_parts(*_POSTERIOR, q.CUBE)
    + _RESOLVED_SQL
    + "FROM e x JOIN resolved r ON " + q.SAME_EVIDENCE
)
def resolve_full(spark, sf_dir):
    return _resolved(spark, sf_dir, fx.observations(spark, sf_dir))


@query(
    q.with_parts(*_POSTERIOR, q.PARTIAL, q.CUBE)
    + _RESOLVED_SQL
    + "FROM pe x JOIN resolved r ON " + q.SAME_EVIDENCE
)
def resolve_partial(spark, sf_dir):
    return _resolved(spark, sf_dir, fx.partial_evidence(spark, sf_dir))


@query(
    q.with_parts(*_POSTERIOR, q.PARTIAL, q.CUBE, q.EXACT_INTERVAL)
    + _RESOLVED_SQL.replace("round(r.credible_low, 6)", "round(b.low, 4)").replace("round(r.credible_high, 6)", "round(b.high, 4)")
    + "FROM pe x JOIN resolved r ON " + q.SAME_EVIDENCE + """
    JOIN exact b ON x.task IS NOT DISTINCT FROM b.task AND x.data IS NOT DISTINCT FROM b.data
      AND x.tool IS NOT DISTINCT FROM b.tool"""
)
def resolve_exact_interval(spark, sf_dir):
    """Exact Beta quantiles, four decimals; the SQL integrates the density."""
    return _resolved(spark, sf_dir, fx.partial_evidence(spark, sf_dir), "beta", digits=4)


@query(
    q.with_parts(q.E, q.COUNTS)
    + """, lv AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
    full_alpha AS (
      SELECT t.k AS task, d.k AS data, r.k AS tool, o.k AS outcome, 1.0 + coalesce(c.n, 0) AS a
      FROM lv t, lv d, lv r, lv o LEFT JOIN counts c ON c.task = t.k AND c.data = d.k AND c.tool = r.k AND c.outcome = o.k)
    SELECT task * 25 + data * 5 + tool AS ctx, outcome, round(a / sum(a) OVER (PARTITION BY task, data, tool), 6) AS p
    FROM full_alpha"""
)
def flat_prior_cpt(spark, sf_dir):
    """A prior without a bump: one pseudo-count everywhere."""
    alpha = posterior.posterior_from(fx.observations(spark, sf_dir), posterior.Prior(strength=0.0))
    return posterior.cpt_long(alpha).select("ctx", "outcome", r6("p"))


@query(
    q.with_parts(*_POSTERIOR, q.PARTIAL, q.CUBE)
    + """SELECT x.l_orderkey, x.l_linenumber, r.state, round(r.confidence, 6) AS confidence, round(r.p0, 6) AS p_certain,
      round(r.credible_low, 6) AS credible_low, round(r.credible_high, 6) AS credible_high,
      round(r.ess, 6) AS effective_sample_size
    FROM pe x JOIN resolved r ON """ + q.SAME_EVIDENCE
)
def written_resolutions(spark, sf_dir):
    """Resolutions written to Parquet with their summary records, read back field by field."""
    resolved = posterior.resolve(
        fx.partial_evidence(spark, sf_dir).select("l_orderkey", "l_linenumber", *LEVELS),
        posterior.resolutions(learnt(spark, sf_dir)),
    )
    path = fresh_dir(spark, "resolutions")
    write_resolutions(resolved, path, ["l_orderkey", "l_linenumber"])
    found = spark.read.parquet(path)
    interval = F.col("summary.credible_interval")
    return found.select(
        "l_orderkey",
        "l_linenumber",
        "summary.state",
        r6(F.col("summary.confidence"), "confidence"),
        r6(F.element_at("summary.distribution", "CERTAIN"), "p_certain"),
        r6(F.get(interval, F.lit(0)), "credible_low"),
        r6(F.get(interval, F.lit(1)), "credible_high"),
        r6(F.col("summary.effective_sample_size"), "effective_sample_size"),
    )


@query(
    q.with_parts(*_POSTERIOR)
    + """, joint AS (SELECT *, p / 125 AS w FROM cpt)
    SELECT 'task' AS target, 'outcome=4' AS given, task AS level,
      round(sum(w) / (SELECT sum(w) FROM joint WHERE outcome = 4), 6) AS p
    FROM joint WHERE outcome = 4 GROUP BY task
    UNION ALL
    SELECT 'tool', 'task=0,outcome=2', tool,
      round(sum(w) / (SELECT sum(w) FROM joint WHERE outcome = 2 AND task = 0), 6)
    FROM joint WHERE outcome = 2 AND task = 0 GROUP BY tool
    UNION ALL
    SELECT 'outcome', 'data=4', outcome,
      round(sum(w) / (SELECT sum(w) FROM joint WHERE data = 4), 6)
    FROM joint WHERE data = 4 GROUP BY outcome"""
)
def network_query(spark, sf_dir):
    alpha = settled(learnt(spark, sf_dir), "posterior")

    def ask(target: str, given: dict[str, int]) -> DataFrame:
        told = ",".join(f"{k}={v}" for k, v in given.items())
        return posterior.network_query(alpha, target, given).select(
            F.lit(target).alias("target"), F.lit(told).alias("given"), "level", r6("p")
        )

    return (
        ask("task", {"outcome": 4})
        .unionByName(ask("tool", {"task": 0, "outcome": 2}))
        .unionByName(ask("outcome", {"data": 4}))
    )


@query(
    q.with_parts(*_POSTERIOR)
    + """SELECT task * 25 + data * 5 + tool AS ctx, round(sum(p), 6) AS p_sum, round(min(a), 6) AS alpha_min,
      abs(sum(p) - 1.0) <= 1e-9 AND min(a) > 0 AS valid
    FROM cpt GROUP BY task, data, tool"""
)
def cpt_check(spark, sf_dir):
    return posterior.cpt_check(learnt(spark, sf_dir)).select("ctx", r6("p_sum"), r6("alpha_min"), "valid")


@query(
    q.with_parts(q.E)
    + """SELECT task * 25 + data * 5 + tool AS ctx, task, data, tool, CAST(count(*) AS BIGINT) AS n
    FROM e GROUP BY task, data, tool"""
)
def evidence_histogram(spark, sf_dir):
    return posterior.evidence_histogram(fx.observations(spark, sf_dir))


@query(
    q.with_parts(q.E, q.SHIFTED)
    + """SELECT l_orderkey, l_linenumber, task, data, tool, outcome,
      CASE WHEN task NOT BETWEEN 0 AND 4 THEN 'task' ELSE 'outcome' END AS bad_column
    FROM se WHERE task NOT BETWEEN 0 AND 4 OR outcome NOT BETWEEN 0 AND 4"""
)
def quarantine_ranges(spark, sf_dir):
    _, bad = posterior.split_valid(fx.shifted_observations(spark, sf_dir))
    return bad.select("l_orderkey", "l_linenumber", *LEVELS, "outcome", "bad_column")


@query(
    q.with_parts(q.E, q.SHIFTED)
    + """SELECT task, data, tool, outcome, CAST(count(*) AS BIGINT) AS n FROM se
    WHERE task BETWEEN 0 AND 4 AND outcome BETWEEN 0 AND 4 GROUP BY ALL"""
)
def lenient_counts(spark, sf_dir):
    return posterior.conjugate_counts(fx.shifted_observations(spark, sf_dir), strict=False)


@query(
    q.with_parts(q.E)
    + """SELECT task * 25 + data * 5 + tool AS ctx, CAST(count(*) AS BIGINT) AS n,
      ['CERTAIN', 'HIGH', 'MEDIUM', 'LOW', 'AMBIGUOUS'][outcome + 1] AS outcome_name
    FROM e GROUP BY 1, 3"""
)
def context_outcomes(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    ctx = context_index(F.col("task"), F.col("data"), F.col("tool")).alias("ctx")
    return rows.groupBy(ctx, state_name(F.col("outcome")).alias("outcome_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
