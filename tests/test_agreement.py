import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import agreement as A
from assayer.operators.posterior import prior_table, resolutions
from assayer.plans.scoring import score_steps

SCHEMA = "run_id long, step_idx long, sample_idx long, answer string"
CONSENSUS = [
    "Herons nest in the tall alders.",
    "In the tall alders herons nest.",
    "Herons, tall birds, nest in the alders.",
    "Copper roofs turn green with age.",
]
DIVERGENT = [
    "Herons nest in the alders by the weir.",
    "Tram fares rise every second winter.",
    "Basalt columns crack into hexagons.",
    "A violin of 1716 hangs above her desk.",
]
REFUSALS = ["That I don't know.", "I am not sure.", "Unable to.", "I cannot tell you."]


def samples(spark, *questions):
    rows = [(i, 0, j, a) for i, answers in enumerate(questions) for j, a in enumerate(answers)]
    return spark.createDataFrame(rows, SCHEMA)


def vector(s):
    return Counter(re.findall("[a-z0-9]+", s.lower()))


def cosine(a, b):
    if not a or not b:
        return 0.0
    dot = sum(v * b[t] for t, v in a.items())
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def by_pairs(answers):
    """Mean pairwise cosine and medoid, pair by pair."""
    bags = [vector(a.strip()) for a in answers]
    n = len(bags)
    totals = [round(sum(cosine(bags[i], bags[j]) for j in range(n) if j != i), 9) for i in range(n)]
    mean = sum(totals) / (n * (n - 1)) if n > 1 else 1.0
    return mean, max(range(n), key=lambda i: (totals[i], -i))


@pytest.mark.parametrize("min_heavy", [1, 10**9])
def test_known_answers(spark, min_heavy):
    questions = [CONSENSUS, DIVERGENT, REFUSALS, ["", ""], ["a b", "a  B"], ["Forty geese at noon."]]
    rows = A.step_agreement(samples(spark, *questions), min_heavy_rows=min_heavy).collect()
    got = {r.run_id: (r.consistency, r.medoid_idx, (r.task, r.data, r.tool)) for r in rows}
    want = [
        (0.475273, 0, (0, 2, 4)),
        (0.0, 0, (0, 4, 4)),
        (0.116202, 1, (4, 4, 4)),
        (0.0, 0, (4, 4, 0)),
        (1.0, 0, (0, 0, 0)),
        (1.0, 0, (0, 0, 0)),
    ]
    assert len(got) == len(want)
    for i, (consistency, medoid, levels) in enumerate(want):
        assert got[i][0] == pytest.approx(consistency, abs=1e-6)
        assert got[i][1:] == (medoid, levels)


@pytest.mark.parametrize("min_heavy", [1, 10**9])
def test_one_question_with_most_rows_equals_pairs(spark, min_heavy):
    rng = random.Random(7)
    words = ["the", "of", "paris", "état", "x1", "42", "FRANCE", "b" * 80, "c" * 80]

    def answer():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))

    questions = [[answer() for _ in range(120)]] + [
        [answer() for _ in range(rng.randint(1, 6))] for _ in range(40)
    ]
    rows = A.step_agreement(samples(spark, *questions), min_heavy_rows=min_heavy).collect()
    assert len(rows) == len(questions)
    for r in rows:
        mean, medoid = by_pairs(questions[r.run_id])
        assert r.consistency == pytest.approx(mean, abs=1e-8)
        assert r.medoid_idx == medoid
        assert r.answer == questions[r.run_id][medoid].strip()
        assert r.n_samples == len(questions[r.run_id])


def test_heavy_branch_takes_only_heavy_questions(spark):
    from assayer.operators.skew import heavy_keys, key_counts, split_heavy

    df = samples(spark, *[["a b"] * (200 if i == 0 else 2) for i in range(100)])
    heavy = heavy_keys(key_counts(df, ["run_id"]), ["run_id"], 1).collect()
    assert [r.run_id for r in heavy] == [0] and heavy[0].fan > 1
    ordinary, hot = split_heavy(df, ["run_id"], 1)
    assert (ordinary.count(), hot.count()) == (198, 200)
    assert split_heavy(df, ["run_id"])[1].count() == 0


def test_ordinary_questions_are_shuffled_once(spark):
    rows = samples(spark, CONSENSUS, DIVERGENT).repartition(4).withColumn("run_id", F.col("run_id") + 0)
    done = A.text_vectors(rows.repartition("run_id"))
    scored = A._per_question(A._ordinary_scores(done, ["run_id"], "sample_idx"), ["run_id"], "sample_idx")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_in_expressions(spark):
    texts = ["  Hello\tWORLD \n hello ", "　\xa0x\x1fy ", "", "Äpfel 日本 1a-2B", None, "it's  İ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select(
        "i", text.strip(t).alias("s"), text.normalise(t).alias("n"), text.tokens(t).alias("k"),
        text.bag(text.tokens(t)).alias("b"),
    ).orderBy("i").collect()
    for raw, r in zip(texts, rows):
        if raw is None:
            assert r.s is None and r.n is None
            continue
        assert r.s == raw.strip()
        assert r.n == re.sub(r"\s+", " ", raw.strip().lower())
        assert r.k == re.findall("[a-z0-9]+", raw.lower())
        assert {e.token: e.tf for e in r.b} == dict(vector(raw))


def test_pair_cosine(spark):
    pairs = [("a a b", "b a"), ("", "x"), ("q", "z"), (CONSENSUS[0], CONSENSUS[2])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string")
    for r in A.pair_cosine(df, "l", "r").collect():
        a, b = (vector(x) for x in pairs[r.i])
        assert r.cosine == pytest.approx(cosine(a, b))
        assert r.n_shared == len(set(a) & set(b))


def test_refusals(spark):
    texts = ["one", "I AM NOT SURE about it", "As an AI model I think", "I don’t know it", "ok then"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.is_refusal(F.col("t"))).collect()] == [True, True, True, False, False]


def test_half_even_rounding(spark):
    from assayer.functions.ordinal import round_level

    df = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 1.5, 2.5, 3.5, 9.0, None)], "x double")
    assert [r[0] for r in df.select(round_level(F.col("x"))).collect()] == [0, 0, 2, 2, 4, 4, None]


def test_disagreement_lowers_confidence(spark):
    table = resolutions(prior_table(spark))
    rows = score_steps(samples(spark, [CONSENSUS[0]] * 4, DIVERGENT), table).collect()
    got = {r.run_id: r for r in rows}
    assert got[0].confidence == pytest.approx(0.717713, abs=1e-6) and not got[0].is_conflict
    assert got[1].confidence < got[0].confidence and got[1].is_conflict
    named = samples(spark, [""]).withColumn("task_text", F.lit("count"))
    row = score_steps(named, table, ["run_id", "task_text"]).first()
    assert row.answer == "(no result produced for: count)"


def test_embedding_vectors(spark):
    vectors = [[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vectors)], "k int, i long, v array<float>")
    r = A.vector_agreement(df, lambda d: A.array_vectors(d, "v"), ["k"], "i").first()
    assert r.consistency == pytest.approx(2 * math.sqrt(0.5) / 6)
    assert (r.medoid_idx, r.n_samples) == (0, 3)
