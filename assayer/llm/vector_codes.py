"""Compression of vectors to one byte a part, by Lloyd rounds that follow the entries that move.

Every part of every vector keeps the entry it is assigned to and its exact squared distance.
When the entries have been replaced by the means of their parts, most of them have not moved:

* a part whose own entry stayed compares its stored distance with the entries that moved, only;
* a part whose own entry moved looks at all entries again.

Both give what a full scan gives, the lowest index of the nearest entries included, since all
numbers are integers. Each round is one pass that assigns and writes, and one that adds up
per task before the shuffle; the driver sees one row per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.session import release, settled

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Up to here sums of squares are exact in double precision, and beyond the second in no type of the result.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62


def finite(x: Column) -> Column:
    """Whether a vector is there and holds numbers only."""
    each = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(each, F.lit(False))


def whole_numbers(x: Column, scale: int) -> Column:
    """Components times a scale, rounded down."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * scale))


class Codebook:
    """Entries of each part, and which of them moved in the last replacement."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.ones(entries.shape[:2], bool) if moved is None else moved

    def replaced(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """Each entry becomes the mean of its parts, rounded down; entries without parts stay."""
        entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            entries[part, entry] = np.asarray(total, dtype=np.int64) // n
        return Codebook(entries, (entries != self.entries).any(axis=2))

    def assigned(self, x: np.ndarray, part: int, code: np.ndarray | None, far: np.ndarray | None, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of one part's rows, given those of the round before."""
        entries = self.entries[part].astype(kind)

        def nearest(rows: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, others = x[rows].astype(kind), entries[among]
            d = (own * own).sum(axis=1)[:, None] - 2 * (own @ others.T) + (others * others).sum(axis=1)
            at = d.argmin(axis=1)  # the first of equals
            return among[at], d[np.arange(len(rows)), at].astype(np.int64)

        everything = np.arange(len(entries))
        if code is None:
            return nearest(np.arange(len(x)), everything)
        code, far = code.copy(), far.copy()
        lost = self.moved[part][code]
        again, still, active = np.flatnonzero(lost), np.flatnonzero(~lost), np.flatnonzero(self.moved[part])
        if len(again):
            code[again], far[again] = nearest(again, everything)
        if len(still) and len(active):
            other, d = nearest(still, active)
            won = (d < far[still]) | ((d == far[still]) & (other < code[still]))
            code[still[won]], far[still[won]] = other[won], d[won]
        return code, far


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


def _assign(rows: DataFrame, book: Codebook, kind: type) -> DataFrame:
    """Adds or renews ``code`` and ``far``, an entry and a distance for each part."""
    first = "code" not in rows.columns
    state = [T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("far", T.ArrayType(T.LongType()))]
    schema = T.StructType(rows.schema.fields + state) if first else rows.schema

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _stacked(frame["x"]).reshape(len(frame), PARTS, -1)
            old = (None, None) if first else (_stacked(frame["code"]), _stacked(frame["far"]))
            got = [book.assigned(x[:, p], p, *((None, None) if first else (old[0][:, p], old[1][:, p])), kind) for p in range(PARTS)]
            code, far = (np.stack([g[i] for g in got], axis=1) for i in (0, 1))
            yield frame.assign(code=list(code.astype(np.int32)), far=list(far))

    return rows.mapInPandas(assign, schema)


def _sums(rows: DataFrame, width: int, entries: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and sum of the parts of each entry: added up within the task, then in Spark."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for frame in frames:
            if len(frame):
                x, code = _stacked(frame["x"]).reshape(len(frame), PARTS, -1), _stacked(frame["code"])
                for p in range(PARTS):
                    np.add.at(total[p], code[:, p], x[:, p])
                    n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            yield pd.DataFrame({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "total": list(total[part, entry])})

    made = rows.select("x", "code").mapInPandas(add, "part int, entry int, n long, total array<long>")
    each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    return {(r["part"], r["entry"]): (r["n"], list(r[3:])) for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()}


def vector_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    rounds: int = ROUNDS,
    entries: int = ENTRIES,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, far, error`` of every usable row, and the entries (part, entry, position).

    Rows whose vector is NULL or holds NULL or non-finite parts are left out. The others are cut into
    four parts of equal width; a vector shorter than the longest, or of a length that four
    doesn't divide, is filled up with zeros. The first entries are the parts of the rows with the
    smallest ids (NULL ids last, equal ids by their vector); fewer rows make fewer entries. Rows
    that repeat an id are rows of their own. An empty table gives an empty one and no entries.
    Components so large that squared distances don't fit a long raise ``ArithmeticError``.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("raw"))
    rows = rows.where(finite(F.col("raw"))).select("vec_id", "label", whole_numbers(F.col("raw"), SCALE).alias("x"))
    bounds = rows.agg(
        F.max(F.size("x")).alias("d"),
        F.max(F.array_max("x").cast("double")).alias("high"),
        F.min(F.array_min("x").cast("double")).alias("low"),
    ).first()
    width = -(-max(bounds["d"] or 0, 1) // PARTS)
    largest = width * (2 * max(abs(bounds["high"] or 0), abs(bounds["low"] or 0))) ** 2
    if largest >= EXACT_LONG:
        raise ArithmeticError("squared distances of these vectors do not fit a long")
    kind = np.float64 if largest < EXACT_DOUBLE else np.int64

    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width * PARTS) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", zeros))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    book = Codebook(np.array([r["x"] for r in start], np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2))

    state = settled(_assign(rows, book, kind), "codes")
    for _ in range(rounds if start else 0):
        book = book.replaced(_sums(state, width, len(start)))
        before, state = state, settled(_assign(state, book, kind), "codes")
        release(before)
    error = F.aggregate("far", F.lit(0).cast("long"), lambda a, v: a + v)
    return state.select("vec_id", "label", "code", "far", error.alias("error")), book.entries


def decoded(code: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in whole numbers of 1/1024."""
    return np.concatenate([entries[p][code[:, p]] for p in range(PARTS)], axis=1)


def listed(entries: np.ndarray) -> str:
    return ",".join(str(v) for v in entries.reshape(-1).tolist())


def code_digest(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: codes in hex, errors by row and by label."""
    found, entries = vector_codes(vectors)
    two = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    found = found.select("vec_id", "label", F.array_join(two, "").alias("code"), "error")
    of_label = found.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(listed(entries).encode()).hexdigest()
    joined = found.join(of_label, F.col("label").eqNullSafe(F.col("_l")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
