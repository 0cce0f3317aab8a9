"""Agreement of answers, keyword evidence, JSON recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.catalog import sql as q
from assayer.catalog.posterior_queries import learnt
from assayer.catalog.registry import query, r6
from assayer.functions import signals
from assayer.operators import agreement, json_objects, posterior, runs
from assayer.plans.scoring import score_steps, score_tool_outputs

_TALK = (q.ANSWERS, q.BAGS, q.AGREEMENT)
_PRIOR_ONLY = (q.PRIOR, q.ALPHA_OF_PRIOR, q.CUBE)


# every conversation is one step, so its number alone is the question's key
_KEYS = ["run_id"]


def _step_0():
    return F.lit(0).cast("long").alias("step_idx")


def _prior_resolutions(spark):
    return posterior.resolutions(posterior.prior_table(spark))


@query(q.with_parts(q.ANSWERS, q.BAGS) + "SELECT * FROM bags")
def bag_of_words(spark, sf_dir):
    return agreement.bag_of_words(fx.answers(spark, sf_dir))


@query(
    q.with_parts(q.ANSWERS, q.BAGS)
    + """SELECT c.run_id, c.step_idx, c.sample_idx, CAST(coalesce(sum(tf), 0) AS INTEGER) AS n_tokens,
      CAST(count(tf) AS INTEGER) AS n_distinct, round(coalesce(sqrt(sum(tf * tf)), 0.0), 6) AS norm
    FROM c LEFT JOIN bags USING (run_id, step_idx, sample_idx) GROUP BY ALL"""
)
def sample_norms(spark, sf_dir):
    return agreement.sample_norms(fx.answers(spark, sf_dir)).withColumn("norm", r6("norm"))


@query(
    """WITH t AS (
      SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations),
    g AS (SELECT conv_id, turn, token, count(*) AS tf FROM t GROUP BY ALL),
    len AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS len FROM g GROUP BY ALL),
    dots AS (
      SELECT a.conv_id, a.turn, sum(a.tf * b.tf) AS dot, count(*) AS shared
      FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.token = b.token GROUP BY ALL)
    SELECT c.conv_id, c.turn, round(coalesce(d.dot / (la.len * lb.len), 0.0), 6) AS cosine,
      CAST(coalesce(d.shared, 0) AS INTEGER) AS n_shared
    FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
    LEFT JOIN dots d ON d.conv_id = c.conv_id AND d.turn = c.turn
    LEFT JOIN len la ON la.conv_id = c.conv_id AND la.turn = c.turn
    LEFT JOIN len lb ON lb.conv_id = p.conv_id AND lb.turn = p.turn"""
)
def pair_cosine(spark, sf_dir):
    found = agreement.pair_cosine(fx.adjacent_turns(spark, sf_dir), "text", "previous")
    return found.withColumn("cosine", r6("cosine"))


@query(
    q.with_parts(*_TALK)
    + """SELECT run_id, step_idx, n_samples, round(consistency, 6) AS consistency,
      round(answerability, 6) AS answerability, n_distinct, round(distinct_ratio, 6) AS distinct_ratio,
      task, data, tool FROM agreement"""
)
def step_agreement(spark, sf_dir):
    return agreement.step_agreement(fx.answers(spark, sf_dir), _KEYS).select(
        "run_id", _step_0(), "n_samples", r6("consistency"), r6("answerability"), "n_distinct",
        r6("distinct_ratio"), "task", "data", "tool",
    )


@query(
    q.with_parts(*_TALK)
    + """SELECT run_id, step_idx, medoid_idx, answer, round(medoid_score, 6) AS medoid_score FROM agreement"""
)
def medoid_answer(spark, sf_dir):
    return agreement.step_agreement(fx.answers(spark, sf_dir), _KEYS).select(
        "run_id", _step_0(), "medoid_idx", "answer", r6("medoid_score")
    )


_STEP_SQL = """SELECT x.run_id, x.step_idx, x.answer, x.task, x.data, x.tool, r.state, r.is_conflict,
  round(r.confidence, 6) AS map_confidence, round(r.good_probability, 6) AS confidence,
  round(r.credible_low, 6) AS credible_low, round(r.credible_high, 6) AS credible_high
FROM agreement x JOIN resolved r ON """ + q.SAME_EVIDENCE


@query(q.with_parts(*_TALK, q.E, q.PRIOR, q.COUNTS, q.ALPHA, q.CUBE) + _STEP_SQL)
def step_confidence(spark, sf_dir):
    table = posterior.resolutions(learnt(spark, sf_dir))
    return score_steps(fx.answers(spark, sf_dir), table, _KEYS).select(
        "run_id", _step_0(), "answer", "task", "data", "tool", "state", "is_conflict",
        r6("map_confidence"), r6("confidence"), r6("credible_low"), r6("credible_high"),
    )


@query(
    q.with_parts(*_TALK, *_PRIOR_ONLY)
    + """SELECT round(avg(good_probability) FILTER (run_id % 2 = 0), 6) AS confidence_a,
      round(avg(good_probability) FILTER (run_id % 2 = 1), 6) AS confidence_b,
      round(avg(good_probability) FILTER (run_id % 2 = 0) - avg(good_probability) FILTER (run_id % 2 = 1), 6) AS gap
    FROM agreement x JOIN resolved r ON """ + q.SAME_EVIDENCE
)
def cohort_gap(spark, sf_dir):
    scored = score_steps(fx.answers(spark, sf_dir), _prior_resolutions(spark), _KEYS)
    gap = runs.cohort_gap(scored.withColumn("cohort", F.col("run_id") % 2), "cohort", 0, 1)
    return gap.select(r6("confidence_a"), r6("confidence_b"), r6("gap"))


@query(
    """WITH v AS (
      SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
    u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY label, vec_id)) AS w FROM v),
    s AS (SELECT label, dim, sum(w) AS s FROM u GROUP BY ALL),
    score AS (
      SELECT label, vec_id, round(sum(w * s) - 1, 9) AS score, sum(w * s) AS dot
      FROM u JOIN s USING (label, dim) GROUP BY ALL),
    best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1),
    agg AS (SELECT label, count(*) AS n, sum(dot) AS dots FROM score GROUP BY label)
    SELECT label, CAST(n AS BIGINT) AS n_samples, vec_id AS medoid_idx,
      round(CASE WHEN n = 1 THEN 1.0 ELSE (dots - n) / (n * (n - 1)) END, 6) AS consistency
    FROM agg JOIN best USING (label)"""
)
def embedding_agreement(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    found = agreement.vector_agreement(
        rows, lambda df: agreement.array_vectors(df, "embedding"), ["label"], "vec_id"
    )
    return found.select(
        "label", "n_samples", "medoid_idx", r6("consistency")
    )


@query(
    q.with_parts(q.O, q.KEYWORDS)
    + "SELECT event_id AS obs_id, task, data, tool FROM kw"
)
def keyword_evidence(spark, sf_dir):
    found = fx.tool_observations(spark, sf_dir).withColumn("ev", signals.keyword_evidence(F.col("result")))
    return found.select("obs_id", "ev.task", "ev.data", "ev.tool")


@query(
    q.with_parts(q.O, q.KEYWORDS)
    + "SELECT event_id AS obs_id, result FROM kw WHERE gated"
)
def conflict_gate(spark, sf_dir):
    return fx.tool_observations(spark, sf_dir).where(signals.is_gated(F.col("result"))).select("obs_id", "result")


@query(
    q.with_parts(q.O, q.KEYWORDS, *_PRIOR_ONLY)
    + """SELECT x.event_id AS obs_id, x.gated, r.state,
      round(CASE WHEN x.gated THEN r.confidence ELSE 1.0 END, 6) AS confidence
    FROM kw x JOIN resolved r ON """ + q.SAME_EVIDENCE
)
def gated_confidence(spark, sf_dir):
    scored = score_tool_outputs(fx.tool_observations(spark, sf_dir), _prior_resolutions(spark))
    return scored.select("obs_id", "gated", "state", r6("confidence"))


@query(
    q.with_parts(q.MODEL)
    + """SELECT id, CASE variant WHEN 7 THEN NULL
      WHEN 3 THEN '{"from":{"page":4},' || tail
      WHEN 4 THEN '{"hint":"see {table} 3",' || tail
      ELSE '{' || tail END AS obj FROM m"""
)
def json_recovery(spark, sf_dir):
    return json_objects.recover_json(fx.model_outputs(spark, sf_dir)).select("id", "obj")


@query(
    q.with_parts(q.MODEL)
    + """SELECT id, 0 AS pos, o_orderstatus AS step FROM m WHERE variant <> 7
    UNION ALL SELECT id, 1, o_orderpriority FROM m WHERE variant <> 7"""
)
def plan_rows(spark, sf_dir):
    recovered = json_objects.recover_json(fx.model_outputs(spark, sf_dir))
    return json_objects.plan_rows(recovered).select("id", "pos", "step")


@query(q.with_parts(q.MODEL) + "SELECT id, 'nothing was written down' AS excerpt FROM m WHERE variant = 7")
def unparseable(spark, sf_dir):
    recovered = json_objects.recover_json(fx.model_outputs(spark, sf_dir))
    return json_objects.unparseable(recovered).select("id", "excerpt")


@query(
    """WITH r AS (SELECT DISTINCT user_id AS run_id FROM events)
    SELECT run_id, CASE run_id % 5 WHEN 4 THEN 'unparseable' WHEN 1 THEN 'plan' ELSE 'response' END AS action,
      CASE run_id % 5 WHEN 0 THEN 'run ' || run_id || ' is done' WHEN 2 THEN 'fine as it is' END AS response,
      CASE run_id % 5 WHEN 1 THEN 3 END AS n_steps FROM r"""
)
def decision_rows(spark, sf_dir):
    found = json_objects.decisions(json_objects.recover_json(fx.run_decisions(spark, sf_dir)))
    return found.select("run_id", "action", "response", F.size("steps").alias("n_steps"))


@query(
    q.with_parts(q.MODEL)
    + """, held AS (
      SELECT id, CASE variant WHEN 1 THEN 25 WHEN 2 THEN 13 WHEN 6 THEN 24 ELSE 0 END AS place,
        CASE variant WHEN 3 THEN '{"from": {"page": 4}, ' WHEN 4 THEN '{"hint": "see {table} 3", ' ELSE '{' END
          || '"steps": ["' || o_orderstatus || '", "' || o_orderpriority || '"]}' AS given,
        CASE variant WHEN 3 THEN '{"from":{"page":4},' || tail WHEN 4 THEN '{"hint":"see {table} 3",' || tail
          ELSE '{' || tail END AS obj, variant
      FROM m WHERE variant <> 7)
    SELECT id, place, length(given)::INTEGER AS length, obj FROM held
    UNION ALL SELECT id, length(given)::INTEGER + 9, 12, '{"later":2}' FROM held WHERE variant = 5"""
)
def json_objects_of_text(spark, sf_dir):
    """Every object of a text and where it stands."""
    return json_objects.every_object(fx.model_outputs(spark, sf_dir)).select("id", "place", "length", "obj")
