"""What must hold for plans at any size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from assayer.operators.skew import heavy_keys, join_lookup, key_counts

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in driver.queries() if not n.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_no_query_multiplies_tables(spark, name):
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan  # row-at-a-time Python
    assert "Join Cross" not in plan


def test_columns_are_pruned(spark):
    plan = driver.queries()["conjugate_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "ReadSchema" in line]
    assert scans and all("l_extendedprice" not in line and "o_totalprice" not in line for line in scans)


def skewed(spark, hot=6000, cold=300):
    return spark.range(hot + cold).select(
        F.when(F.col("id") < hot, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )


def test_few_heavy_keys_and_bounded_fans(spark):
    even = spark.range(10_000).select((F.col("id") % 5).alias("k"))
    rows = heavy_keys(key_counts(even, ["k"]), ["k"], 1).collect()
    limit = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(rows) == 5 and sum(r.fan for r in rows) <= 2 * limit
    many = spark.range(10_000).select((F.col("id") % 500).alias("k"))
    assert heavy_keys(key_counts(many, ["k"]), ["k"], 1).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_past_a_heavy_key_equals_a_join(spark, how):
    rows = skewed(spark)
    lookup = spark.range(-1, 6100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = join_lookup(rows, lookup, ["k"], how, ["v"], min_rows=1)
    want = rows.join(lookup, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_heavy_key_is_spread(spark):
    """With AQE off and no broadcast of the lookup, count rows per task."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = spark.range(-1, 6300).select(F.col("id").alias("k"), F.lit(1).alias("w"))
        joined = join_lookup(skewed(spark), lookup, ["k"], "inner", ["v"], min_rows=1)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6300 and max(sizes) < 3000
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def test_a_few_huge_answers_make_a_question_heavy(spark):
    from assayer.operators.agreement import step_agreement
    from assayer.operators.skew import split_heavy

    huge = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, 0, i, f"{huge} {i}") for i in range(6)] + [(k, 0, i, f"short answer {k}") for k in range(2, 60) for i in range(3)]
    samples = spark.createDataFrame(rows, "run_id long, step_idx long, sample_idx long, answer string").repartition(4)
    size = F.octet_length("answer")
    ordinary, heavy = split_heavy(samples, ["run_id"], weight=size, min_weight=1000)
    assert {r.run_id for r in heavy.collect()} == {1} and ordinary.count() == len(rows) - 6
    assert split_heavy(samples, ["run_id"], weight=size)[1].count() == 0  # small in all
    spread = step_agreement(samples, min_heavy_bytes=1000)
    plain = step_agreement(samples)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
