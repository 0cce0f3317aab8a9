"""Registered queries of the operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import sql
from assayer.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@_register
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.packing import packed_documents

    placed = packed_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_register
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import secret_scan as scan

    found = scan.findings(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(scan.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(scan.of_kind(F.col("spans"), rule.kind).alias(f"n_{rule.kind}") for rule in scan.BASE),
        F.sha2(scan.listed(base), 256).alias("base_sha256"),
        scan.listed(F.col("spans")).alias("spans"),
    )


@_register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


@_register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.language import languages

    return languages(table(spark, sf_dir, "documents"))


@_register
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.main_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@_register
def op7_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.vector_graph import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))


@_register
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.vector_codes import code_digest

    return code_digest(table(spark, sf_dir, "embeddings"))


@_register
def op12_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.distance_tree import hard_negatives

    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


SQL["op2_secret_scan"] = sql.secret_scan()
SQL["op11_vector_codes"] = sql.vector_codes()
SQL["op13_hard_negatives"] = sql.HARD_NEGATIVES
