"""Benchmark decontamination by fingerprints of item-sized windows.

A window of a text has as many words as an item. Only windows that share a word shingle with an item
of their size can be similar to it, and a shared shingle says where such a window begins, so
windows are taken there. Which items a window resembles its 64-bit SimHash tells: it is looked up in an
index of fingerprint blocks of all items of that size. With one block more than the radius has
bits, any two fingerprints within the radius agree on a block, so none is
missed. What is found is verified by the exact similarity of the shingle multisets,
each shingle weighing as often as it occurs. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import settled

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
#: Rows of a table of the items (some 40 bytes each) that are broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000

# a text has less than 2^31 shingles, so no lane runs over into the next
_LANES, _LANE_BITS = 2, 32
_EDGES = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]


def words_of(text: Column) -> Column:
    """Words of letters and digits in lower case; a NULL text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hashed shingles in order; fewer words make one shingle, none make none."""
    n = F.size(words)
    several = F.transform(
        F.sequence(F.lit(1), n - (SHINGLE_WORDS - 1)),
        lambda i: F.xxhash64(*(F.element_at(words, (i + k).cast("int")) for k in range(SHINGLE_WORDS))),
    )
    none = F.array().cast("array<bigint>")
    return F.when(n >= SHINGLE_WORDS, several).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(none)


def with_shingles(rows: DataFrame) -> DataFrame:
    """Adds the shingles ``x`` of ``text`` and drops it. The words are a column of their own, so each text is split once:
    a predicate on the shingles must not be pushed below it, which is why they are exploded by outer generators."""
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("x", shingles_of(F.col("words"))).drop("words", "text")


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, fingerprint`` of shingle rows ``keys, h``: the sign of each bit's sum.

    Two 32-bit counters share one sum, so that thirty-two sums count all bits.
    """
    lane = sum(1 << (_LANE_BITS * i) for i in range(_LANES))
    wide = F.col("h")
    sums = [F.sum(F.shiftrightunsigned(wide, j).bitwiseAND(F.lit(lane))).alias(f"s{j}") for j in range(_LANE_BITS)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = []
    for j in range(_LANE_BITS):
        for i in range(_LANES):
            ones = F.shiftrightunsigned(F.col(f"s{j}"), _LANE_BITS * i).bitwiseAND(F.lit((1 << _LANE_BITS) - 1))
            bits.append(F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), _LANE_BITS * i + j)).otherwise(F.lit(0).cast("long")))
    fingerprint = bits[0]
    for bit in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(bit)
    return counted.select(*keys, "n", fingerprint.alias("fingerprint"))


def _blocks() -> Column:
    """The blocks of ``fingerprint`` by number."""
    return F.array(
        *(
            F.shiftrightunsigned(F.col("fingerprint"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            for lo, hi in zip(_EDGES, _EDGES[1:], strict=False)
        )
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, similarity, distance, first_word``: the best window of each leaked item.

    A document leaks an item if a window of the item's size has at least ``SIMILARITY``
    to it; of equal ones the first counts. A text shorter than an item is one window.
    Texts and items without words match nothing, NULL ids are ignored, and so are other columns. Rows that
    repeat an id are each sought by themselves, and the best window of all of them counts; rows
    repeated in full are one. An empty table on either side gives no rows.
    """
    named = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null")
    # each text of an item is sought by itself
    inside = with_shingles(_versions(named).withColumnRenamed("key", "item_id"))
    inside = inside.dropDuplicates(["item_id"])
    inside = settled(inside.select("item_id", F.size("x").alias("size"), F.posexplode_outer("x").alias("offset", "h")), "item-shingles")
    inside = inside.where("h is not null")
    counted = inside.agg(F.count("*").alias("shingles"), F.count_distinct("item_id").alias("items")).first()

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    rows = _versions(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null"))
    rows = rows.withColumnRenamed("key", "doc_id")
    each = with_shingles(rows).select("doc_id", F.size("x").alias("n"), F.posexplode_outer("x").alias("at", "h"))
    # of a shingle that an item repeats the first and the last place are enough to find where the item begins
    ends = inside.groupBy("item_id", "size", "h").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    seeds = ends.select("size", "h", F.explode(F.array_distinct(F.array("low", "high"))).alias("offset")).distinct()
    hits = each.join(small(settled(seeds, "seeds"), counted["shingles"]), "h")
    first = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("n") - F.col("size")))
    windows = settled(hits.select("doc_id", "size", first.alias("first")).distinct(), "windows")

    wanted = windows.groupBy("doc_id").agg(F.collect_set(F.struct("size", "first")).alias("wanted"))
    again = rows.join(settled(wanted, "wanted").hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id"])
    cut = with_shingles(again).select("doc_id", "x", F.explode("wanted").alias("w")).where(F.size("x") > F.col("w.first"))
    cut = cut.select("doc_id", "w.*", F.slice("x", F.col("w.first") + 1, F.col("w.size")).alias("x"))
    keys = ["doc_id", "size", "first"]
    cut = settled(cut.select(*keys, F.explode_outer("x").alias("h")), "window-shingles")

    index = _fingerprints(inside, ["item_id", "size"])
    index = index.select("item_id", "size", F.col("fingerprint").alias("of_item"), F.posexplode(_blocks()).alias("block", "value"))
    prints = _fingerprints(cut, keys).select(*keys, "n", "fingerprint", F.posexplode(_blocks()).alias("block", "value"))
    met = prints.join(small(settled(index, "index"), counted["items"] * (RADIUS + 1)), ["size", "block", "value"])
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item")))
    near = met.where(distance <= RADIUS).groupBy(*keys, "item_id").agg(F.first("n").alias("n"), F.first(distance).alias("distance"))
    near = settled(near, "near")

    held = inside.groupBy("item_id", "h").agg(F.count("*").alias("in_item"))
    of_window = cut.groupBy(*keys, "h").agg(F.count("*").alias("times"))
    common = of_window.join(near, keys).join(small(settled(held, "item-counts"), counted["shingles"]), ["item_id", "h"])
    found = common.groupBy(*keys, "item_id").agg(
        F.sum(F.least("times", "in_item")).alias("common"), F.first("n").alias("n"), F.first("distance").alias("distance")
    )
    similarity = F.col("common") / (F.col("n") + F.col("size") - F.col("common"))
    verified = found.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY)
    best = verified.groupBy(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id")).agg(
        F.max(F.struct("similarity", (-F.col("first")).alias("before"), "distance")).alias("best")
    )
    return best.select(
        "doc_id", "item_id", "best.similarity", F.col("best.distance").cast("long").alias("distance"), (-F.col("best.before")).cast("long").alias("first_word")
    )


def _versions(rows: DataFrame) -> DataFrame:
    """``key, text``: rows of one id and one text have one key, rows of one id and different texts have different ones."""
    return rows.select(F.struct("id", F.md5(F.coalesce("text", F.lit(""))).alias("version")).alias("key"), "text")
