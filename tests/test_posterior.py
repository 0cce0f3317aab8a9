import pytest
from pyspark.sql import functions as F

from assayer.functions import ordinal
from assayer.operators import posterior as P
from assayer.schema import LEVELS, OBSERVATION, STATES

# level sum: (state, confidence, good, exact interval, normal interval)
KNOWN = {
    0: ("CERTAIN", 0.427907, 0.717713, (0.1842, 0.6926), (0.1687, 0.6871)),
    1: ("CERTAIN", 0.364278, 0.684442, (0.1371, 0.6309), (0.1122, 0.6164)),
    2: ("HIGH", 0.338272, 0.636422, (0.1192, 0.6043), (0.0904, 0.5861)),
    3: ("HIGH", 0.337734, 0.572847, (0.1188, 0.6037), (0.0900, 0.5855)),
    4: ("HIGH", 0.315919, 0.496709, (0.1045, 0.5807), (0.0724, 0.5594)),
    5: ("MEDIUM", 0.312327, 0.415163, (0.1022, 0.5769), (0.0696, 0.5551)),
    6: ("MEDIUM", 0.324689, 0.337655, (0.1102, 0.5900), (0.0794, 0.5700)),
    7: ("MEDIUM", 0.312327, 0.272509, (0.1022, 0.5769), (0.0696, 0.5551)),
    8: ("LOW", 0.315919, 0.224062, (0.1045, 0.5807), (0.0724, 0.5594)),
    9: ("LOW", 0.337734, 0.192040, (0.1188, 0.6037), (0.0900, 0.5855)),
    10: ("LOW", 0.338272, 0.173074, (0.1192, 0.6043), (0.0904, 0.5861)),
    11: ("AMBIGUOUS", 0.364278, 0.162889, (0.1371, 0.6309), (0.1122, 0.6164)),
    12: ("AMBIGUOUS", 0.427907, 0.157863, (0.1842, 0.6926), (0.1687, 0.6871)),
}


def evidence(spark, *triples):
    return spark.createDataFrame(triples, "task int, data int, tool int")


def observed(spark, rows):
    return spark.createDataFrame(rows, OBSERVATION)


def resolved(spark, alpha, triple, **kw):
    return P.resolve(evidence(spark, triple), P.resolutions(alpha, **kw)).first()


def test_contexts_are_a_bijection(spark):
    rows = P.contexts(spark).withColumn(
        "again", ordinal.context_index(F.col("task"), F.col("data"), F.col("tool"))
    ).collect()
    assert len({(r.task, r.data, r.tool) for r in rows}) == 125
    assert all(r.ctx == r.again for r in rows)


@pytest.mark.parametrize("interval", ["beta", "normal"])
def test_known_answers_of_the_prior(spark, interval):
    table = P.resolutions(P.prior_table(spark), interval)
    rows = P.resolve(P.contexts(spark), table).collect()
    assert len(rows) == 125
    for r in rows:
        state, confidence, good, exact, normal = KNOWN[r.task + r.data + r.tool]
        low, high = exact if interval == "beta" else normal
        assert r.state == state and STATES[r.state_index] == state
        assert r.confidence == pytest.approx(confidence, abs=1e-6)
        assert r.good_probability == pytest.approx(good, abs=1e-6)
        assert (r.credible_low, r.credible_high) == pytest.approx((low, high), abs=6e-5)
        assert r.effective_sample_size == pytest.approx(13.0)
        assert r.credible_low <= r.confidence <= r.credible_high
        assert sum(r.theta) == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize(
    "triple, state, theta, interval",
    [
        ((None, None, None), "MEDIUM", (0.139912, 0.224316, 0.271543, 0.224316, 0.139912), (0.038566, 0.504521)),
        ((None, 4, None), "LOW", (0.094752, 0.158103, 0.258605, 0.286409, 0.202131), (0.049593, 0.523224)),
        ((0, None, 1), "HIGH", (0.243461, 0.317655, 0.233969, 0.122411, 0.082504), (0.073778, 0.561533)),
    ],
)
def test_partial_evidence(spark, triple, state, theta, interval):
    r = resolved(spark, P.prior_table(spark), triple)
    assert r.state == state
    assert r.theta == pytest.approx(theta, abs=1e-6)
    assert (r.credible_low, r.credible_high) == pytest.approx(interval, abs=1e-6)


def test_observations_move_the_posterior_and_reset_undoes_it(spark):
    prior = P.prior_table(spark)
    counts = P.conjugate_counts(observed(spark, [(2, 2, 2, 0, 50)]))
    alpha = P.posterior_alpha(prior, counts)
    before, after = (resolved(spark, a, (2, 2, 2)) for a in (prior, alpha))
    assert after.theta[0] > before.theta[0] + 0.3
    assert after.theta == pytest.approx((0.816443, 0.046883, 0.066999, 0.046883, 0.022792), abs=1e-6)
    assert (after.credible_low, after.credible_high) == pytest.approx((0.721598, 0.911288), abs=1e-6)
    assert after.effective_sample_size == pytest.approx(63)
    part = resolved(spark, alpha, (None, 2, None))
    assert part.state == "MEDIUM" and part.effective_sample_size == pytest.approx(15)
    assert (part.credible_low, part.credible_high) == pytest.approx((0.035529, 0.458048), abs=1e-6)
    assert P.posterior_alpha(prior).collect() == prior.collect()


def test_counts_add_up_and_default_to_one(spark):
    rows = observed(spark, [(1, 1, 1, 0, None), (1, 1, 1, 0, 19)])
    assert P.conjugate_counts(rows).collect()[0].n == 20
    alpha = P.posterior_from(rows)
    assert resolved(spark, alpha, (1, 1, 1)).effective_sample_size == pytest.approx(33)
    assert P.conjugate_counts(rows.drop("count")).collect()[0].n == 2


def test_out_of_range_values(spark):
    rows = observed(spark, [(0, 0, 0, 5, 1), (0, 0, 0, 1, 1), (None, 0, 0, 1, 1)])
    with pytest.raises(Exception, match="out of range"):
        P.conjugate_counts(rows).collect()
    good, bad = P.split_valid(rows)
    assert good.count() == 1
    assert {r.bad_column for r in bad.collect()} == {"outcome", "task"}
    assert P.conjugate_counts(rows, strict=False).collect()[0].n == 1
    with pytest.raises(Exception, match="out of range"):
        resolved(spark, P.prior_table(spark), (5, 0, 0))


def test_flat_prior_and_parameters(spark):
    rows = P.prior_table(spark, P.Prior(strength=0.0)).collect()
    assert all(a == 1.0 for r in rows for a in r.alpha)
    narrow = P.prior_table(spark, P.Prior(strength=20.0, spread=0.2)).where("ctx = 0").first()
    assert narrow.alpha[0] == pytest.approx(21, abs=1e-3)
    # every outcome ties under a flat prior: the first one wins
    assert resolved(spark, P.prior_table(spark, P.Prior(strength=0.0)), (3, 1, 2)).state == "CERTAIN"


def test_cube_equals_averaging_by_hand(spark):
    alpha = P.posterior_from(
        observed(spark, [(t, d, r, (t * d + r) % 5, 3 * t + d + 1) for t in range(5) for d in range(5) for r in range(5)])
    )
    cells = {(r.task, r.data, r.tool): r.alpha for r in alpha.collect()}
    cube = {tuple(r[c] for c in LEVELS): r for r in P.marginal_cube(alpha).collect()}
    assert len(cube) == 216
    for pattern, row in cube.items():
        match = [a for k, a in cells.items() if all(p in (None, v) for p, v in zip(pattern, k))]
        for k in range(5):
            assert row.theta[k] == pytest.approx(sum(a[k] / sum(a) for a in match) / len(match))
            assert row.alpha[k] == pytest.approx(sum(a[k] for a in match) / len(match))
        assert row.ess == pytest.approx(sum(sum(a) for a in match) / len(match))


def test_network_query(spark):
    prior = P.prior_table(spark)
    rows = {r.level: r.p for r in P.network_query(prior, "task", {"outcome": 4}).collect()}
    assert [rows[k] for k in range(5)] == pytest.approx(
        [0.135445, 0.156163, 0.187666, 0.231786, 0.288940], abs=1e-6
    )
    whole = {r.level: r.p for r in P.network_query(prior, "outcome", {"data": 4, "unknown": 1}).collect()}
    assert whole[3] == pytest.approx(0.286409, abs=1e-6)
    assert P.cpt_long(prior).count() == 625
    assert P.cpt_check(prior).where("valid").count() == 125


def test_resolve_keeps_every_row_and_joins_by_hash(spark):
    rows = evidence(spark, (None, 1, 2), (0, 0, 0), (None, 1, 2))
    df = P.resolve(rows, P.resolutions(P.prior_table(spark)))
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_beta_quantile_against_commons_math(spark):
    from assayer.functions.beta import beta_quantile

    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution.BetaDistribution
    cases = [(1.5, 9.0), (0.6, 0.7), (40.0, 3.0), (5000.0, 20000.0), (1e6, 2.5)]
    df = spark.createDataFrame(cases, "a double, b double").select(
        "a", "b", beta_quantile(0.025, F.col("a"), F.col("b")).alias("q")
    )
    for r in df.collect():
        assert r.q == pytest.approx(jvm(r.a, r.b).inverseCumulativeProbability(0.025), rel=1e-6)
