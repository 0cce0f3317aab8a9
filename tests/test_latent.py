import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.sql import functions as F

from assayer.operators import grid, latent
from assayer.operators.quantiles import split_ordered
from assayer.plans.latent_run import hold_out_evaluation

SCHEMA = "id long, signals array<double>, outcome int"


def correlated(n=2000, raw_dim=8, hidden=3, noise=0.6, seed=0):
    """Many channels, few causes; the outcome is the quintile of the causes' sum."""
    rng = np.random.default_rng(seed)
    causes = rng.normal(size=(n, hidden))
    x = causes @ rng.normal(size=(hidden, raw_dim)) + noise * rng.normal(size=(n, raw_dim))
    total = causes.sum(axis=1)
    y = np.searchsorted(np.quantile(total, [0.2, 0.4, 0.6, 0.8]), total, side="right")
    return x, y


@pytest.fixture(scope="module")
def data():
    return correlated()


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(i, list(map(float, v)), int(k)) for i, (v, k) in enumerate(zip(x, y))], SCHEMA).repartition(4)


def numpy_bins(train, x, k=3, n_bins=5):
    """The same projection by eigenvectors in numpy."""
    mean, sd = train.mean(axis=0), train.std(axis=0)
    z = (train - mean) / sd
    values, axes = np.linalg.eigh(np.cov(z.T))
    axes = axes[:, np.argsort(values)[::-1][:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    fitted, latent_x = z @ axes, (x - mean) / sd @ axes
    qs = np.arange(1, n_bins) / n_bins
    bins = [np.searchsorted(np.quantile(fitted[:, i], qs), latent_x[:, i], side="right") for i in range(k)]
    return np.stack(bins, axis=1), np.sort(values)[::-1][:k].sum() / values.sum()


def test_bins_equal_numpy(rows, data):
    x, y = data
    cut = int(0.7 * len(x))
    train, test = split_ordered(rows, "id")
    assert (train.count(), test.count()) == (cut, len(x) - cut)
    projection = latent.fit_projection(train)
    want, variance = numpy_bins(x[:cut], x)
    got = {r.id: r.bins for r in projection.to_bins(rows).select("id", "bins").collect()}
    same = np.mean([list(want[i]) == got[i] for i in range(len(x))])
    assert same > 0.999  # a value on an edge may fall either way
    assert projection.explained_variance() == pytest.approx(variance, abs=1e-9)
    assert variance > 0.7


def test_report_beats_the_baseline_and_repeats(rows):
    a, b = (hold_out_evaluation(rows, 8).first() for _ in range(2))
    assert a == b
    assert a.naive_raw_states == "390625" and a.latent_states == 125
    assert abs(10**a.log10_compression_ratio - 3125) < 1e-6
    assert a.explained_variance > 0.7
    assert a.test_accuracy > a.majority_baseline + 0.2


def test_another_projector_fits(rows):
    """A bare estimator from ``raw`` to ``latent`` is enough."""
    plain = PCA(k=2, inputCol="raw", outputCol="latent")
    projection = latent.fit_projection(rows, n_components=2, n_bins=3, projector=plain)
    bins = projection.to_bins(rows).select(F.explode("bins").alias("b")).agg(F.min("b"), F.max("b")).first()
    assert tuple(bins) == (0, 2)


def test_constant_signals_do_not_break_scaling(spark):
    rows = spark.createDataFrame([(i, [float(i), 3.0, -float(i % 7)], i % 5) for i in range(50)], SCHEMA)
    assert latent.fit_projection(rows, n_components=2).to_bins(rows).where(F.size("bins") == 2).count() == 50


def test_grid(spark):
    binned = spark.createDataFrame([([1, 2], 3)] * 10 + [([0, 0], 2), ([0, 0], 1)], "bins array<int>, outcome int")
    counts = grid.grid_counts(binned, 3, 4)
    table = grid.grid_predictive(counts, 4)
    rows = {r.cell: r for r in table.collect()}
    assert rows[5].alpha == [1.0, 1.0, 1.0, 11.0] and rows[5].prediction == 3
    assert sum(rows[5].theta) == pytest.approx(1.0)
    assert rows[0].prediction == 1  # a tie goes to the lower outcome
    asked = spark.createDataFrame([([1, 2],), ([2, 2],)], "bins array<int>")
    assert [r.prediction for r in grid.grid_predict(asked, table, 2, 3).orderBy("cell").collect()] == [3, 0]
    assert grid.state_reduction(8, 3) == (390_625, 125)
    with pytest.raises(Exception, match="out of range"):
        grid.grid_counts(binned, 3, 2).collect()


def test_axes_are_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 7)) + 0.3 * rng.normal(size=(300, 7))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, signals array<double>")
    projection = latent.fit_projection(df)
    axes = np.zeros((3, 7))
    for k, j, v in projection.axes():
        axes[k, j] = v
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    covariance = z.T @ z / (len(z) - 1)
    for v in axes:
        value = v @ covariance @ v
        assert np.abs(covariance @ v - value * v).max() < 1e-6
        assert v[np.abs(v).argmax()] > 0
    assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)


def test_random_signs_follow_from_the_seed(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, signals array<double>")

    def z(seed):
        model = latent.fit_projection(df, projector=latent.RandomSigns(3, seed=seed))
        return np.array([r.z for r in model.project(df).orderBy("id").collect()])

    def sign(seed, axis, j):
        mixed = ((j * 73 + axis * 31 + seed * 17 + 1) * 48_271) % 2_147_483_647
        return 1.0 if mixed * 48_271 % 2_147_483_647 % 2 == 0 else -1.0

    table = np.array([[sign(4, k, j) for k in range(3)] for j in range(5)])
    assert np.allclose(z(4), x @ table / np.sqrt(5)) and not np.allclose(z(4), z(5))
    assert (z(4) == z(4)).all()
