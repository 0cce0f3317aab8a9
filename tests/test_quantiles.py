import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import quantiles as Q

FRACTIONS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 0.95, 1.0]


def cases():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=801),
        "ties": rng.integers(0, 4, 500).astype(float),
        "one": np.array([7.5]),
        "same": np.full(64, -2.0),
        "tails": rng.standard_cauchy(700) * 10.0 ** rng.integers(-200, 200, 700),
        "signs": np.array([-0.0, 0.0, -1e-310, 1e-310, -1.0, 1.0, 5e-324]),
        "infinite": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]),
        "close": 1.0 + np.arange(300) * 2.0**-52,
    }


@pytest.mark.parametrize("exact_rows", [1_000_000, 3])
def test_equal_to_numpy(spark, monkeypatch, exact_rows):
    """The small limit forces the refinement rounds."""
    monkeypatch.setattr(Q, "EXACT_ROWS", exact_rows)
    data = cases()
    rows = [(name, float(v)) for name, vs in data.items() for v in vs] + [("normal", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "name string, v double").repartition(5)
    got = {(r["name"], r.fraction): r.value for r in Q.quantiles(df, "v", FRACTIONS, ["name"]).collect()}
    assert len(got) == len(data) * len(FRACTIONS)
    for name, vs in data.items():
        if name == "infinite":
            assert got[name, 0.5] == 2.0
            continue
        want = np.percentile(vs, [100 * f for f in FRACTIONS])
        have = np.array([got[name, f] for f in FRACTIONS])
        assert have == pytest.approx(want, rel=1e-12, abs=0), name


def test_ungrouped(spark):
    df = spark.range(1001).select((F.col("id") * 0.5).alias("v"))
    assert [r.value for r in Q.quantiles(df, "v", [0.25]).collect()] == [125.0]


@pytest.mark.parametrize("start", [0, 2**60])
@pytest.mark.parametrize("n, fraction", [(10, 0.7), (11, 0.7), (7, 0.5), (1, 0.7), (3, 1.0)])
def test_ordered_split(spark, start, n, fraction):
    df = spark.range(n).select((F.col("id") * 3 + start).alias("k")).repartition(3)
    train, test = Q.split_ordered(df, "k", fraction)
    keys = sorted(start + 3 * i for i in range(n))
    cut = int(fraction * n)
    assert sorted(r.k for r in train.collect()) == keys[:cut]
    assert sorted(r.k for r in test.collect()) == keys[cut:]


def test_split_reaches_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    train, _ = Q.split_ordered(spark.read.parquet(str(tmp_path / "t")), "id")
    assert "PushedFilters: [IsNotNull(id), LessThan(id,700)]" in train._jdf.queryExecution().toString()


@pytest.mark.parametrize("bins", [100_000, 10])
def test_any_number_of_groups(spark, monkeypatch, bins):
    """With the small limit the bins are joined and not broadcast."""
    monkeypatch.setattr(Q, "BROADCAST_BINS", bins)
    df = spark.range(6000).select((F.col("id") % 500).alias("g"), ((F.col("id") * 7919) % 6000).cast("double").alias("v"))
    got = {r.g: r.value for r in Q.quantiles(df, "v", [0.5], ["g"]).collect()}
    want = {}
    for i in range(6000):
        want.setdefault(i % 500, []).append((i * 7919) % 6000)
    assert got == {g: float(np.percentile(v, 50)) for g, v in want.items()}


def test_no_rows_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, v double")
    assert [tuple(r) for r in Q.quantiles(df, "v", [0.5], ["g"]).collect()] == [(None, 0.5, 2.0)]
    assert Q.quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0
