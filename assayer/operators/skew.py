"""Heavy keys: finding them, and joining past them.

With P shuffle partitions, a key is *heavy* when it holds more than one part in 4P
of all rows, or of their weight where the rows differ in size.  By that definition there are
fewer than 8P of them, whatever the data, so a list of heavy keys is always safe to
broadcast; every other key fits comfortably into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import shuffle_partitions

MIN_HEAVY_ROWS = 100_000
#: Weights are bytes.
MIN_HEAVY_WEIGHT = 64 << 20


def key_counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, rows, weight): reads the key columns and the weight only and combines before the shuffle."""
    total = F.sum(weight.cast("double")) if weight is not None else F.lit(0.0)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), total.alias("weight"))


def heavy_keys(
    counts: DataFrame, keys: list[str], min_rows: int = MIN_HEAVY_ROWS, min_weight: float = MIN_HEAVY_WEIGHT
) -> DataFrame:
    """(keys, fan) of the keys that would overload one task.

    ``fan`` is the number of tasks a key is worth, by its rows or by its weight.  Over all heavy
    keys the fans add up to less than 16P.  The totals are taken from the same counts, so their
    exchange is shared.
    """
    limit = 4 * shuffle_partitions(counts.sparkSession)

    def share(column: str, least: float) -> Column:
        total = counts.agg(F.sum(column).alias("total")).scalar()
        return F.when(F.col(column) >= least, F.try_divide(F.col(column) * limit, total))

    shares = [share("rows", min_rows)]
    shares += [share("weight", min_weight)] if "weight" in counts.columns else []
    known = counts.withColumn("share", F.greatest(*shares, F.lit(0.0)))
    return known.where(F.col("share") > 1).select(*keys, F.ceil("share").cast("int").alias("fan"))


def split_heavy(
    df: DataFrame,
    keys: list[str],
    min_rows: int = MIN_HEAVY_ROWS,
    weight: Column | None = None,
    min_weight: float = MIN_HEAVY_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of heavy keys).

    Without heavy keys AQE sees the empty broadcast and drops the second part.
    """
    heavy = F.broadcast(heavy_keys(key_counts(df, keys, weight), keys, min_rows, min_weight).select(*keys))
    return df.join(heavy, keys, "left_anti"), df.join(heavy, keys, "left_semi")


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    spread_by: list[str],
    min_rows: int = MIN_HEAVY_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that holds each key at most once.

    Rows of a heavy key are spread over ``fan`` tasks by a hash of ``spread_by``
    (columns that tell them apart), and its one lookup row is copied that often.
    A hash, unlike a random number, sends a re-run row to the same place.
    ``counts`` saves a pass where the rows per key are known already.
    """
    heavy = F.broadcast(heavy_keys(key_counts(rows, keys) if counts is None else counts, keys, min_rows))
    fan = F.coalesce("fan", F.lit(1))
    spread = rows.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), fan).cast("int")
    )
    copies = lookup.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), fan - 1))
    )
    return spread.drop("fan").join(copies.drop("fan"), [*keys, "_salt"], how).drop("_salt")
