"""Quantile grid and the latent model."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.catalog import sql as q
from assayer.catalog.registry import query, r6
from assayer.operators import grid, latent
from assayer.operators.quantiles import split_ordered
from assayer.plans.latent_run import hold_out_evaluation

_AXES, _BINS = 3, 5


def _split(spark, sf_dir):
    return split_ordered(fx.signal_rows(spark, sf_dir), "id")


def _factors(rows):
    """Three fixed linear factors of all dimensions: the sums over every third one."""
    def every_third(first):
        taken = F.filter("signals", lambda _, i: i % _AXES == first)
        return F.round(F.aggregate(taken, F.lit(0.0), lambda total, x: total + x), 9)

    return rows.withColumn("signals", F.array(*[every_third(a) for a in range(_AXES)]))


def _factor_split(spark, sf_dir):
    return [_factors(part) for part in _split(spark, sf_dir)]


def _edges(train):
    return latent.quantile_edges(train, "signals", _AXES, _BINS)


def _binned(rows, edges):
    return latent.with_bins(rows, "signals", edges, _AXES, _BINS)


@query(
    q.with_parts(q.SIGNALS)
    + """SELECT axis, unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS fraction, round(unnest(q), 6) AS value FROM (
      SELECT axis, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS q FROM (
        SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS axis, CAST(unnest(embedding) AS DOUBLE) AS v
        FROM split WHERE is_train) GROUP BY axis)"""
)
def quantile_edges(spark, sf_dir):
    """Edges of every dimension."""
    train, _ = _split(spark, sf_dir)
    dims = train.agg(F.max(F.size("signals")).alias("d")).head()["d"] or 0
    return latent.quantile_edges(train, "signals", dims, _BINS).withColumn("value", r6("value"))


@query(q.with_parts(q.SIGNALS) + "SELECT id, b0, b1, b2, cell FROM cells")
def quantile_bins(spark, sf_dir):
    train, _ = _factor_split(spark, sf_dir)
    rows = _binned(_factors(fx.signal_rows(spark, sf_dir)), _edges(train))
    return rows.select(
        "id",
        *[F.get("bins", F.lit(a)).alias(f"b{a}") for a in range(_AXES)],
        grid.cell_of(F.col("bins"), _BINS).alias("cell"),
    )


@query(q.with_parts(q.SIGNALS) + "SELECT id FROM split WHERE is_train")
def ordered_split(spark, sf_dir):
    return _split(spark, sf_dir)[0].select("id")


@query(q.with_parts(q.SIGNALS) + "SELECT * FROM grid")
def grid_counts(spark, sf_dir):
    train, _ = _factor_split(spark, sf_dir)
    return grid.grid_counts(_binned(train, _edges(train)), _BINS)


def _predicted(spark, sf_dir):
    train, test = _factor_split(spark, sf_dir)
    edges = _edges(train)
    table = grid.grid_predictive(grid.grid_counts(_binned(train, edges), _BINS))
    return grid.grid_predict(_binned(test, edges), table, _AXES, _BINS)


@query(q.with_parts(q.SIGNALS) + "SELECT id, cell, outcome, prediction FROM predicted")
def grid_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("id", "cell", "outcome", "prediction")


@query(
    q.with_parts(q.SIGNALS)
    + """SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(CAST(prediction = outcome AS DOUBLE)), 6) AS accuracy,
      (SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM predicted GROUP BY outcome)) AS majority_baseline
    FROM predicted"""
)
def holdout_eval(spark, sf_dir):
    return grid.accuracy(_predicted(spark, sf_dir)).select(
        "n_rows", r6("accuracy"), r6("majority_baseline")
    )


def _bins(rows, *more):
    return rows.select("id", *[F.get("bins", F.lit(a)).alias(f"b{a}") for a in range(_AXES)], *more)


_RECURSIVE = "WITH RECURSIVE"


def _latent_sql(fit: str, rows: str, *parts: str) -> str:
    return q.with_parts(q.SIGNAL_ROWS, q.pca(fit, rows), *parts).replace("WITH", _RECURSIVE, 1)


@query(_latent_sql("signals", "signals", q.latent_bins()) + "SELECT id, b0, b1, b2 FROM bins")
def latent_fit(spark, sf_dir):
    """Bins of every row under a fitted projection; the SQL finds the axes by matrix powers."""
    rows = fx.signal_rows(spark, sf_dir)
    return _bins(latent.fit_projection(rows).to_bins(rows))


@query(
    _latent_sql("signals", "signals")
    + """SELECT axis, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v), 6) AS loading FROM axis"""
)
def latent_axes(spark, sf_dir):
    """Loadings of the axes, the largest of each positive."""
    axes = latent.fit_projection(fx.signal_rows(spark, sf_dir)).axes()
    return spark.createDataFrame(axes, "axis int, dim int, loading double").withColumn("loading", r6("loading"))


_LEARNT_SQL = _latent_sql("train", "placed", q.latent_bins("id IN (SELECT id FROM train)"), q.LATENT_VOTES)


@query(_LEARNT_SQL + "SELECT id, cell, outcome, prediction FROM guessed")
def latent_predict(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    projection = latent.fit_projection(train)
    counts = latent.update_grid(projection, train)
    return latent.predict(projection, counts, test).select("id", "cell", "outcome", "prediction")


@query(
    _LEARNT_SQL
    + """SELECT CAST(len(m) AS INTEGER) AS raw_dim, CASE len(m) WHEN 64 THEN '""" + str(5**64) + """' END AS naive_raw_states,
      round(len(m) * log10(5), 9) AS log10_naive_raw_states, CAST(125 AS BIGINT) AS latent_states,
      round((len(m) - 3) * log10(5), 9) AS log10_compression_ratio,
      round((SELECT sum(value) FROM axis) / list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])), 3) AS explained_variance,
      (SELECT round(avg(CAST(prediction = outcome AS DOUBLE)), 3) FROM guessed) AS test_accuracy,
      (SELECT round(max(n) / sum(n), 3) FROM (SELECT count(*) AS n FROM guessed GROUP BY outcome)) AS majority_baseline
    FROM covariance"""
)
def latent_report(spark, sf_dir):
    rows = fx.signal_rows(spark, sf_dir)
    raw_dim = rows.select(F.size("signals").alias("d")).head()["d"]
    report = hold_out_evaluation(rows, raw_dim)
    return report.withColumns({c: F.round(c, 9) for c in ("log10_naive_raw_states", "log10_compression_ratio")})


_SEED = 7


@query(
    f"""WITH signs AS (
      SELECT axis, j, CASE WHEN (((j * 73 + axis * 31 + {_SEED} * 17 + 1) * 48271) % 2147483647 * 48271) % 2147483647 % 2 = 0
        THEN 1.0 ELSE -1.0 END AS s FROM range({_AXES}) AS a(axis), range(64) AS b(j)),
    rowed AS (SELECT axis, list(s ORDER BY j) AS r FROM signs GROUP BY axis),
    z AS (
      SELECT vec_id AS id, {", ".join(f"list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT r FROM rowed WHERE axis = {k})::DOUBLE[]) / 8 AS z{k}" for k in range(_AXES))}
      FROM embeddings),
    edge AS (SELECT {", ".join(f"quantile_cont(z{k}, [0.2, 0.4, 0.6, 0.8]) AS e{k}" for k in range(_AXES))} FROM z)
    SELECT id, {", ".join(f"round(z{k}, 6) AS z{k}, CAST(len(list_filter(e{k}, lambda e: e <= z{k})) AS INTEGER) AS b{k}" for k in range(_AXES))}
    FROM z, edge"""
)
def random_projection_bins(spark, sf_dir):
    """Another projector in place of PCA: signs from a stored seed."""
    rows = fx.signal_rows(spark, sf_dir)
    projection = latent.fit_projection(rows, projector=latent.RandomSigns(_AXES, seed=_SEED))
    latents = projection.project(rows).select("id", "z")
    z = [F.round(F.get("z", F.lit(a)), 6).alias(f"z{a}") for a in range(_AXES)]
    return _bins(projection.to_bins(rows).join(latents, "id"), *z)
