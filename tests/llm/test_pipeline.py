"""The pipeline end to end, and its stages' contract."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).persist()
        out.append((name, docs, kept))
        docs = kept
    return out


def test_stages_keep_columns_and_drop_whole_rows(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_nothing_secret_is_left(stages):
    _, before, after = stages[3]
    assert before.count() == after.count()
    assert after.where(F.col("text").rlike("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}")).count() == 0
    assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_all_that_is_left_is_packed(stages):
    _, before, pieces = stages[4]
    assert pieces.select("doc_id").distinct().count() == before.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.fixture(scope="module")
def unnamed(spark, tmp_path_factory):
    """Tables in which a NULL id, or one id in several rows, meets every decision."""
    def words(seed, n=60):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)) + "."

    junk = lambda seed: " ".join(w + "***" for w in words(seed).split())
    texts = [(i, words(i)) for i in range(1, 60)] + [(i, junk(i)) for i in range(60, 120)]
    sf = str(tmp_path_factory.mktemp("unnamed"))
    labels = [(i, int(i < 60), 0) for i in range(1, 120)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{sf}/learnt.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, words(900, 20))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, words, junk


def rows_of(spark, rows):
    fields = "doc_id long, text string, n_chars long"
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows], fields)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_decides_row_by_row(spark, unnamed):
    sf, words, junk = unnamed
    learnt = [tuple(r) for r in spark.read.parquet(f"{sf}/learnt.parquet").collect()]
    more = [(None, words(300)), (None, junk(301)), (500, words(302)), (500, junk(303))]
    kept = left(corpus_pipeline.keep_quality(spark, rows_of(spark, learnt + more), sf))
    assert [r for r in kept if r[0] in (None, 500)] == sorted([more[0], more[2]], key=str)


def test_one_row_of_each_class_stays(spark, unnamed):
    sf, words, _ = unnamed
    a, b, c = words(310), words(311), words(312)
    docs = [(None, a), (7, a), (7, a), (9, a), (None, b), (None, b), (8, c), (8, c), (4, ""), (4, ""), (None, "")]
    kept = left(corpus_pipeline.keep_one_of_each(spark, rows_of(spark, docs), sf))
    assert kept == sorted([(7, a), (None, b), (8, c), (4, ""), (None, "")], key=str)


def test_leaks_go_without_an_id(spark, unnamed):
    sf, words, _ = unnamed
    leak = f"{words(320)} {words(900, 20)} {words(321)}"
    docs = [(None, leak), (None, words(322)), (5, leak), (6, words(323)), (6, leak)]
    kept = left(corpus_pipeline.drop_leaks(spark, rows_of(spark, docs), sf))
    assert kept == sorted([docs[1], docs[3]], key=str)


def test_secrets_go_without_an_id(spark, unnamed):
    sf, words, _ = unnamed
    docs = [(None, "password = abcdef123 " + words(330)), (None, words(331)), (3, "token: 0123456789ab"), (3, words(332))]
    done = corpus_pipeline.redact_secrets(spark, rows_of(spark, docs), sf)
    assert left(done) == sorted([(None, "[REDACTED] " + words(330)), docs[1], (3, "[REDACTED]"), docs[3]], key=str)
    assert done.where(F.col("n_chars") != F.length("text")).count() == 0


def test_rows_without_an_id_are_packed(spark, unnamed):
    sf, words, _ = unnamed
    pieces = corpus_pipeline.pack(spark, rows_of(spark, [(None, words(340)), (None, words(341)), (2, words(342))]), sf)
    assert sorted(str(r.doc_id) for r in pieces.collect()) == ["2", "None", "None"]
