"""Packing of tokenised documents into sequences of bounded length.

Only the *number of pieces of each length* decides a packing, and there are at
most ``capacity`` lengths, so the plan is made from that histogram whatever the
size of the corpus: small sets that provably dominate every alternative are fixed
in bulk (a reduction due to Martello and Toth), the rest is placed best-fit
in bulk. Pieces get a rank among those of their length from per-task counters and
find their place in the plan by that rank; no piece is moved to be packed.
"""

from __future__ import annotations

import array
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import whole_text
from assayer.llm.tokens import VOCABULARY, Encoder
from assayer.session import settled

CAPACITY = 2048
END_ID = 0

PIECES = (
    "doc_id {id}, piece int, start long, length long, ids_crc32 long, ids array<int>, part long, nth long"
)


def tokenised_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document, one row each; ``ids`` is NULL unless asked for.

    A document is its ids and a closing id 0; NULL text counts as empty, so every
    row has at least one piece. A longer document is cut into full pieces behind a first
    piece that takes the remainder. ``part`` and ``nth`` number the pieces of each
    length within the task that made them.
    """
    kind = dict(docs.dtypes)[doc_id]

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seen = Encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for frame in frames:
            rows = []
            for key, whole in zip(frame["doc_id"], frame["text"], strict=True):
                ids = array.array("I", encoder.ids(whole))
                ids.append(END_ID)
                first = len(ids) % capacity or min(capacity, len(ids))
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : start + capacity if piece else first]
                    nth = seen[len(own)]
                    seen[len(own)] += 1
                    kept = np.asarray(own, dtype=np.int32) if with_ids else None
                    rows.append((key, piece, start, len(own), zlib.crc32(own.tobytes()), kept, part, nth))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInPandas(encode, PIECES.format(id=kind))


class _Counts:
    """Remaining pieces per length, with the next length up or down."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {w: c for w, c in histogram.items() if c > 0}
        self.lengths = sorted(self.n)

    def take(self, w: int, times: int) -> None:
        self.n[w] -= times
        if not self.n[w]:
            del self.n[w]
            self.lengths.pop(bisect_left(self.lengths, w))

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The ``k`` smallest pieces longer than ``above``, repeated lengths included."""
        out: list[int] = []
        for w in self.lengths[bisect_right(self.lengths, above) :]:
            out += [w] * min(self.n[w], k - len(out))
            if len(out) == k:
                break
        return out

    def at_most(self, room: int) -> int:
        """The greatest length that fits, or 0."""
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0


def _dominating(left: _Counts, w: int, capacity: int) -> tuple[int, ...] | None:
    """Companions with which ``w`` makes a set that dominates every set with ``w``."""
    left.take(w, 1)
    try:
        room = capacity - w
        largest = left.at_most(room)
        if not largest or largest == room:
            return (largest,) if largest else ()
        low = left.smallest(3)
        if len(low) < 2 or sum(low[:2]) > room:  # one companion at most: the largest is best
            return (largest,)
        if len(low) < 3 or sum(low) > room:  # two at most
            left.take(largest, 1)
            second = left.at_most(room - largest)
            left.n[largest] = left.n.get(largest, 0) + 1
            if left.n[largest] == 1:
                left.lengths.insert(bisect_left(left.lengths, largest), largest)
            if second:
                beyond = left.smallest(2, above=second)
                if len(beyond) < 2 or sum(beyond) > room:  # no pair has both above the second
                    return (largest, second)
        return None
    finally:
        left.n[w] = left.n.get(w, 0) + 1
        if left.n[w] == 1:
            left.lengths.insert(bisect_left(left.lengths, w), w)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Kinds of sequence as (how many, lengths in order), from the number of pieces of each length."""
    left, plan = _Counts(histogram), []
    changed = True
    while changed:
        changed = False
        for w in reversed(list(left.lengths)):
            while w in left.n:
                mates = _dominating(left, w, capacity)
                if mates is None:
                    break
                kind = (w, *mates)
                times = min(left.n[x] // kind.count(x) for x in set(kind))
                for x in kind:
                    left.take(x, times)
                plan.append((times, kind))
                changed = True

    open_kinds: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, times: int, kind: tuple[int, ...]) -> None:
        if not open_kinds[room] and room:
            rooms.insert(bisect_left(rooms, room), room)
        open_kinds[room].append((times, kind))

    for w in reversed(left.lengths):
        n = left.n[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = min(n, capacity // w)
                times = n // each
                put(capacity - each * w, times, (w,) * each)
                n -= times * each
                continue
            room = rooms[i]
            times, kind = open_kinds[room].pop()
            if not open_kinds[room]:
                rooms.pop(i)
            used = min(times, n)
            if times > used:
                put(room, times - used, kind)
            put(room - w, used, (*kind, w))
            n -= used
    return plan + [kind for kinds in open_kinds.values() for kind in kinds]


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """Per length four rows: first rank, first sequence, place in the sequence, and a closing rank."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for times, kind in plan:
        offset = 0
        for w in kind:
            slots[w].append((used[w], base, offset))
            used[w] += times
            offset += w
        base += times
    return {w: np.asarray(rows, dtype=np.int64).T for w, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length, part, nth``.

    Sequences hold at most ``capacity`` ids, gapless from 0. ``pieces`` must not change
    between reads, so give a written table. An empty table gives an empty one.
    """
    counts = settled(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    # one row per length: at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_sequences(histogram, capacity))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for w in np.unique(length):
            mine = length == w
            starts, bases, offsets = slots[int(w)]
            at = np.searchsorted(starts, rank[mine], side="right") - 1
            sequence[mine] = bases[at] + rank[mine] - starts[at]
            offset[mine] = offsets[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    place.__annotations__ = {"lengths": pd.Series, "ranks": pd.Series, "return": pd.DataFrame}
    placed = F.pandas_udf(place, "sequence_id long, offset long")("length", "rank")
    return ranked.withColumn("at", placed).select("*", "at.sequence_id", "at.offset").drop("at", "first", "rank", "part", "nth")


def packed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their places, ``ids`` among them if asked for."""
    made = tokenised_pieces(docs, doc_id, text, capacity, vocabulary, with_ids)
    if not with_ids:
        made = made.drop("ids")
    return pack(settled(made, "pieces"), capacity)
