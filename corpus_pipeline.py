"""From raw documents to packed sequences, stage after stage.

Each stage works on all that its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontam, minhash, packing, quality, secret_scan
from assayer.llm.common import table
from assayer.session import release, scoped, settled

#: A row's number within a stage.
ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, on which decisions are joined, whatever the ids are.

    A row's number is a hash of its place, the file and the row in it, so nothing is written for a table
    that is read from Parquet; any other is written once. The rare case of two rows with one
    number is found by counting, and another seed taken.
    """
    seed = 0
    while True:
        try:
            placed = docs.withColumn(ROW, F.xxhash64(F.lit(seed), "_metadata.file_path", "_metadata.row_index"))
        except AnalysisException:
            docs = settled(docs, "numbered")
            continue
        n = placed.agg(F.count("*"), F.count_distinct(ROW)).first()
        if n[0] == n[1]:
            return placed
        if seed:
            docs = settled(docs, "numbered")
        seed += 1


def _without(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    return numbered.join(rows.hint("shuffle_hash"), ROW, "left_anti").drop(ROW)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each by its own text."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, 0.8) the row of the smallest id stays.

    NULL ids come last. Rows without words are in no class; of those that repeat an id one stays.
    """
    numbered = _numbered(docs)
    with scoped() as keep:
        classes = minhash.near_duplicates(numbered, doc_id=ROW).withColumnRenamed("doc_id", ROW)
        named = classes.join(numbered.select(ROW, "doc_id"), ROW)
        alone = F.col("n_shingles") == 0
        named = named.select(
            ROW,
            F.when(~alone | F.col("doc_id").isNull(), F.col("component_id")).alias("component"),
            F.when(alone, F.col("doc_id")).alias("wordless"),
            F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW).alias("place"),
        )
        named = settled(named, "classes")
        several = named.groupBy("component", "wordless").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
        several = several.select(F.col("component").alias("_c"), F.col("wordless").alias("_w"), F.col(f"first.{ROW}").alias("stays"))
        same = F.col("component").eqNullSafe(F.col("_c")) & F.col("wordless").eqNullSafe(F.col("_w"))
        dropped = keep(settled(named.join(several, same).where(F.col(ROW) != F.col("stays")).select(ROW), "duplicates"))
    return _without(numbered, dropped)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    numbered = _numbered(docs)
    with scoped() as keep:
        found = decontam.leaks(numbered, table(spark, sf_dir, "benchmark"), doc_id=ROW)
        leaked = keep(settled(found.select(F.col("doc_id").alias(ROW)).distinct(), "leaked"))
    return _without(numbered, leaked)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced by a mark; ``n_chars`` follows the text. Every document stays."""
    numbered = _numbered(docs)
    with scoped() as keep:
        found = secret_scan.findings(numbered, path=ROW).where(F.size("spans") > 0)
        holders = keep(settled(found.select(F.col("path").alias(ROW)), "holders"))
    marked = numbered.join(holders.withColumn("_found", F.lit(True)).hint("shuffle_hash"), ROW, "left")
    # the others' texts don't pass the rules
    marked = marked.withColumn("_secret", F.when(F.col("_found"), F.col("text")))
    changed = secret_scan.redacted(marked, "_secret").withColumn("text", F.coalesce("_secret", "text"))
    if "n_chars" in docs.columns:
        length = F.length("_secret").cast("long")
        changed = changed.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return changed.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their sequence and place."""
    placed = packing.packed_documents(docs, with_ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No stage but the secret scan is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scoped() as keep:
            made = keep(settled(stage(spark, docs, sf_dir), f"stage-{name}"))
        release(docs)
        docs = made
    return docs
