import pytest
from pyspark.sql import functions as F

from assayer.functions import signals as S
from assayer.operators.posterior import prior_table, resolutions
from assayer.plans.scoring import score_tool_outputs

KNOWN = {
    "catalogue lookup: found 5 matching entries": ((0, 0, 0), False, 1.0),
    "3 rows retrieved, their dates in conflict": ((3, 4, 0), True, 0.312327),
    "outcome uncertain, since 2 registers disagree": ((4, 4, 0), True, 0.315919),
    "second retry failed with an error": ((4, 4, 4), True, 0.427907),
    "a partial log and accounts that contradict it": ((4, 4, 1), False, 1.0),
    "plain text": ((4, 0, 1), False, 1.0),
    "not found": ((0, 0, 1), False, 1.0),
    "timeout on a partial sync, stale copies in conflict, owner missing": ((4, 4, 4), True, 0.427907),
    "mast_error: the lookout failed to answer": ((4, 4, 4), True, 0.427907),
    "VALIDATE ٣": ((4, 0, 0), False, 1.0),
}


def test_known_answers(spark):
    df = spark.createDataFrame([(t,) for t in KNOWN], "result string")
    scored = score_tool_outputs(df, resolutions(prior_table(spark)))
    rows = {r.result: r for r in scored.collect()}
    assert len(rows) == len(KNOWN)
    for result, (levels, gated, confidence) in KNOWN.items():
        r = rows[result]
        assert (r.task, r.data, r.tool) == levels, result
        assert r.gated == gated
        assert r.confidence == pytest.approx(confidence, abs=1e-6)


def test_missing_result_reads_as_none(spark):
    df = spark.createDataFrame([(None,)], "result string")
    ev = df.select(S.keyword_evidence(F.col("result")).alias("e")).first().e
    assert (ev.task, ev.data, ev.tool) == (4, 0, 1)


@pytest.mark.parametrize("term, weight", S.CONFLICT_WEIGHTS.items())
def test_every_weight_is_in_range(term, weight):
    assert 0 <= weight <= 4 and term == term.lower()


def test_unavailable(spark):
    rows = [("RuntimeError", "Connection error"), ("ValueError", "bad"), ("X", "host ACTIVELY refused it")]
    df = spark.createDataFrame(rows, "c string, m string")
    assert [r[0] for r in df.select(S.is_unavailable(F.col("c"), F.col("m"))).collect()] == [True, False, True]


def test_signals_stay_in_generated_code(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("r")).repartition(2)
    plan = df.select(S.keyword_evidence(F.col("r")).alias("e"), S.is_gated(F.col("r")).alias("g"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text


def test_missing_texts_are_ungated_and_available(spark):
    df = spark.createDataFrame([(None, None), ("Timeout", None), (None, "fine")], "kind string, message string")
    rows = df.select(S.is_gated(F.col("message")), S.is_unavailable(F.col("kind"), F.col("message"))).collect()
    assert all(v is not None for r in rows for v in r)
    assert [r[0] for r in rows] == [False, False, False]
