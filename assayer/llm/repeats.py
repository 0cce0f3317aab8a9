"""Removal of byte strings that an earlier document has, by run-length indexes of what may repeat.

Every window of ``WINDOW`` bytes has a *least gram*: the smallest hash of its 16-byte grams. Equal windows
have equal least grams, so only windows whose least gram occurs in two different texts can
repeat, and windows with the same least gram can meet in one place, wherever they stand:

1. Equal texts are one text, that of the smallest id; the others go as a whole.
2. Least grams of each text, distinct and packed by bucket, tell which of them several texts have.
   What a batch of texts sees twice by itself is settled there, so a gram that a third of
   all texts have reaches its bucket once for each batch.
3. Neighbouring windows with the same least gram are a *stretch* of some 65 bytes. The stretches of a gram meet
   in one task, where equal ones are one, with the smallest id.
4. They are cut again by a longer gram. The cuts of a group, in the order of their ids, are parted in halves, and
   again; at each level a run-length index (:mod:`assayer.llm.run_index`) of all first halves is asked for
   the matching statistics of all second halves. A match of ``WINDOW`` bytes is a repeat.
5. A gram that very many texts have is settled by its windows: its stretches are combined before they move,
   and each window of the different ones finds its smallest id by a grouped minimum.
6. Marked windows go back to their texts; their union is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_text
from assayer.llm.run_index import RunIndex, flat
from assayer.session import release, settled, shuffle_partitions

WINDOW = 50
GRAM = 16
#: Grams of very many texts are broadcast up to so many.
BROADCAST_GRAMS = 1 << 20
#: Within a gram's stretches a longer one tells apart what can't be equal.
LONG_GRAM = 48
#: Bytes of text whose least grams meet in one bucket, and of candidate texts whose stretches meet in one task.
BUCKET_BYTES = 1 << 25
#: A text has a row for each bucket that holds grams of it, so there are no more than the bytes ask for.
LEAST_BUCKETS = 16
SHARD_BYTES = 1 << 22
#: A gram that more texts have than this is settled window by window; the stretches of one that has fewer are some
#: megabytes in one task.
MOST_TEXTS = 1 << 14
#: Windows of a stretch; a longer row of windows with one least gram is cut.
LONGEST = 128
#: Bytes that are hashed at a time.
HASHED = 1 << 20
#: Bytes of text that a batch holds when its least grams are compared.
BATCH_BYTES = 1 << 24

_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_grams(data: bytes, window: int = WINDOW) -> np.ndarray:
    """The least gram of each window; a gram is hashed by its two 8-byte words."""
    n = len(data) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    h = words[: len(data) - GRAM + 1] * _MIX
    h ^= h >> np.uint64(29)
    h = (h ^ words[8:]) * _MIX
    h ^= h >> np.uint64(32)
    width, done = window - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _packed_grams(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct least grams by bucket, and what a batch settles by itself (bucket below 0)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[bytes, np.ndarray]]]:
        held, size = {}, 0
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                if bytes(key) not in held:
                    data = _bytes(text)
                    held[bytes(key)] = np.unique(least_grams(data))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield list(held.items())
                        held, size = {}, 0
        yield list(held.items())

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in batches(frames):
            if not held:
                continue
            grams = np.concatenate([g for _, g in held])
            owner = np.repeat(np.arange(len(held)), [len(g) for _, g in held])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            first = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
            size = np.diff(np.append(np.flatnonzero(first), len(grams)))
            holders = np.repeat(size, size)
            several = holders > 1
            # the first text of a gram that the batch has several times speaks for it in the bucket
            sent = first.copy()
            out = []
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket[sent]):
                mine = np.flatnonzero(sent & (bucket == b))
                mine = mine[np.argsort(owner[mine], kind="stable")]
                texts, counts = np.unique(owner[mine], return_counts=True)
                keys = b"".join(held[t][0] for t in texts)
                out.append((int(b), keys, counts.astype(np.int32).tobytes(), grams[mine].tobytes(), holders[mine].astype(np.int32).tobytes()))
            known = np.flatnonzero(several)
            known = known[np.argsort(owner[known], kind="stable")]
            for t, own in zip(*_split(owner[known], grams[known]), strict=True):
                out.append((-1 - int(t) % buckets, held[t][0], b"", own.tobytes(), b""))
            yield pd.DataFrame(out, columns=["bucket", "keys", "counts", "grams", "holders"])

    return rows.mapInPandas(pack, "bucket int, keys binary, counts binary, grams binary, holders binary")


def _split(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values by owner; owners are in order."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    return owner[at], np.split(values, at[1:]) if len(at) else []


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """``key, grams``: of a bucket the grams that several texts have, by text; under no key those of very many texts."""
    direct = frame[frame["bucket"] < 0]
    out = [pd.DataFrame({"key": direct["keys"], "grams": direct["grams"]})]
    frame = frame[frame["bucket"] >= 0]
    if len(frame):
        keys = np.frombuffer(b"".join(frame["keys"]), "V16")
        counts = np.frombuffer(b"".join(frame["counts"]), np.int32)
        names, number = np.unique(keys, return_inverse=True)
        owner = np.repeat(number, counts)
        grams = np.frombuffer(b"".join(frame["grams"]), np.uint64)
        holders = np.frombuffer(b"".join(frame["holders"]), np.int32)
        order = np.lexsort((owner, grams))
        grams, owner, holders = grams[order], owner[order], holders[order].astype(np.int64)
        first = np.concatenate([[True], grams[1:] != grams[:-1]])
        group = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        last = np.append(start[1:], len(grams)) - 1
        shared = (owner[start] != owner[last]) | (np.maximum.reduceat(holders, start) > 1)
        kept = np.flatnonzero(shared[group])
        kept = kept[np.argsort(owner[kept], kind="stable")]
        texts, lists = _split(owner[kept], grams[kept])
        out.append(pd.DataFrame({"key": [names[t].tobytes() for t in texts], "grams": [own.tobytes() for own in lists]}))
        # a text that stands in several batches counts in each, which does no harm
        many = grams[start[np.add.reduceat(holders, start) > MOST_TEXTS]]
        if len(many):
            out.append(pd.DataFrame({"key": [None], "grams": [many.tobytes()]}))
    return pd.concat(out)


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"gram": np.frombuffer(b"".join(frame["packed"]), np.int64)})


def stretches(data: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and least gram of each stretch whose gram is among the shared ones, given in order."""
    grams = least_grams(data)
    if not len(grams):
        return np.zeros(0, int), np.zeros(0, int), grams
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    size = np.diff(np.append(edge, len(grams)))
    mine = shared[np.minimum(np.searchsorted(shared, grams[edge]), len(shared) - 1)] == grams[edge] if len(shared) else np.zeros(len(edge), bool)
    edge, size = edge[mine], size[mine]
    pieces = -(-size // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(edge, pieces) + nth * LONGEST
    count = np.minimum(LONGEST, np.repeat(edge + size, pieces) - start)
    return start, count, grams[start]


def _stretch_rows(texts: DataFrame) -> DataFrame:
    """``gram, piece, number, doc_id, start`` of all stretches of candidate texts ``number, doc_id, text, grams``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for i, (text, lists) in enumerate(zip(frame["text"], frame["grams"], strict=True)):
                data = _bytes(text)
                start, count, grams = stretches(data, np.sort(np.frombuffer(b"".join(lists), np.uint64)))
                pieces = [data[s : s + c + WINDOW - 1] for s, c in zip(start.tolist(), count.tolist(), strict=True)]
                found.append((np.full(len(start), i), start, grams, pieces))
            if not found:
                continue
            row, start, grams = (np.concatenate([f[k] for f in found]) for k in range(3))
            columns = {c: frame[c].to_numpy()[row] for c in ("number", "doc_id")}
            yield pd.DataFrame({"gram": grams.view(np.int64), "piece": [p for f in found for p in f[3]], **columns, "start": start})

    columns = texts.select("number", "doc_id", "text", "grams")
    return columns.mapInPandas(cut, "gram long, piece binary, number long, doc_id long, start long")


def _sub_stretches(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches cut again, by a longer least gram: ``owner, start, count, group`` of each piece.

    Pieces of one group have both grams in common; equal windows still meet.
    """
    raw = data.tobytes()
    n = len(raw) - WINDOW + 1
    long = np.empty(n, np.uint64)
    for at in range(0, n, HASHED):  # a slab at a time, as hashes take eight bytes for each
        slab = raw[at : at + HASHED + WINDOW - 1]
        words = np.ndarray((len(slab) - 7,), "<u8", slab, strides=(1,)).astype(np.uint64)
        h = np.zeros(len(slab) - LONG_GRAM + 1, np.uint64)
        for k in range(0, LONG_GRAM, 8):
            h = (h ^ words[k : k + len(h)]) * _MIX
            h ^= h >> np.uint64(31)
        width, done = WINDOW - LONG_GRAM + 1, 1
        while done < width:
            step = min(done, width - done)
            h = np.minimum(h[:-step], h[step:])
            done += step
        long[at : at + HASHED] = h
    owner = np.repeat(np.arange(len(starts)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    least = long[place]
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])]))
    count = np.diff(np.append(edge, len(owner)))
    # should two pairs of grams have one hash, they are one group: matches are of bytes all the same
    both = (gram[owner[edge]].astype(np.uint64) * _MIX) ^ least[edge]
    return owner[edge], place[edge], count, np.unique(both, return_inverse=True)[1]


def marked_windows(grams: np.ndarray, pieces: list[bytes], first: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each stretch, which of its windows a stretch of the same gram with a smaller id has.

    Stretches are cut by a longer gram, and equal cuts are one, with the smallest id. Then by halving: at each level
    the cuts of a group are parted by the rank of their id into blocks, and blocks into an earlier and a later
    half; all earlier halves make one index, under a tag each, and the later halves are matched with it.
    """
    out = [np.zeros(len(p) - window + 1, bool) for p in pieces]
    # a gram of one id alone has nothing to find
    order = np.lexsort((first, grams))
    edge = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1]])) if len(order) else order
    last = np.append(edge[1:], len(order)) - 1
    asked = np.sort(order[np.repeat(first[order[edge]] != first[order[last]], last - edge + 1)])
    if not len(asked):
        return out
    for i, marks in zip(asked.tolist(), _marked(grams[asked], [pieces[i] for i in asked.tolist()], first[asked], window), strict=True):
        out[i] = marks
    return out


def _marked(grams: np.ndarray, pieces: list[bytes], first: np.ndarray, window: int) -> list[np.ndarray]:
    data, lengths = flat(pieces)
    starts, windows = np.cumsum(lengths) - lengths, lengths - window + 1
    owner, start, count, group = _sub_stretches(data, starts, windows, grams)
    doc = first[owner]
    order = np.lexsort((doc, group))
    owner, start, count, group, doc = owner[order], start[order], count[order], group[order], doc[order]
    # groups of one id have nothing to find
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.flatnonzero(fresh)
    ends = np.append(begin[1:], len(group))
    several = np.repeat(doc[begin] != doc[ends - 1], ends - begin)
    owner, start, count, group, doc = (v[several] for v in (owner, start, count, group, doc))
    hit = np.zeros(len(data), bool)
    whole = data.tobytes()
    seen: dict[tuple[int, bytes], int] = {}
    same = np.array(
        [seen.setdefault((g, whole[s : s + n + window - 1]), i) for i, (g, s, n) in enumerate(zip(group.tolist(), start.tolist(), count.tolist(), strict=True))],
        np.int64,
    )
    own = np.flatnonzero(same == np.arange(len(same)))
    _halve(data, start[own], count[own], group[own], doc[own], hit, window)
    for i in np.flatnonzero(same != np.arange(len(same))).tolist():
        s, n, j = int(start[i]), int(count[i]), int(same[i])
        hit[s : s + n] |= True if doc[j] < doc[i] else hit[start[j] : start[j] + n]
    return [hit[s : s + n] for s, n in zip(starts.tolist(), windows.tolist(), strict=True)]


def _halve(
    data: np.ndarray, start: np.ndarray, count: np.ndarray, group: np.ndarray, doc: np.ndarray, hit: np.ndarray, window: int
) -> None:
    """Sets ``hit`` where a window of a cut is in a cut of its group with a smaller id; cuts are in the order of both."""
    if not len(group):
        return
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.cumsum(~fresh & np.concatenate([[False], doc[1:] != doc[:-1]]))
    rank -= rank[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    lengths = count + window - 1
    there = np.arange(len(group))
    for level in reversed(range(int(rank.max()).bit_length())):
        # what is marked as a whole is in an earlier cut, and so is all that it could mark
        total = np.concatenate([[0], np.cumsum(hit)])
        there = there[total[start[there] + count[there]] - total[start[there]] < count[there]]
        if not len(there):
            return
        block, late = rank[there] >> (level + 1), (rank[there] >> level) & 1
        _, tag = np.unique(group[there] * (int(block.max()) + 1) + block, return_inverse=True)
        both = (np.bincount(tag, late == 0) > 0) & (np.bincount(tag, late == 1) > 0)
        known, asked = (np.flatnonzero(both[tag] & (late == side)) for side in (0, 1))
        if len(asked):
            tag = np.unique(tag[np.concatenate([known, asked])], return_inverse=True)[1]
            known, asked = there[known], there[asked]
            place = []
            for who in (known, asked):
                size = lengths[who]
                place.append(np.repeat(start[who] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
            index = RunIndex(data[place[0]], lengths[known], tag[: len(known)], window)
            # cuts of one stretch overlap, so a place may stand here twice
            hit[place[1][index.reaches(data[place[1]], lengths[asked], tag[len(known) :], window)]] = True


SPANS = "number long, start long, windows long, marks binary"


def _by_index(rows: DataFrame, shards: int) -> DataFrame:
    """Spans of the marked windows of texts: ``marks`` has a byte of 0 or 1 for each, or is NULL where all are."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "number", "start"], ignore_index=True)
        seen: dict[tuple[int, bytes], int] = {}
        grams, doc = frame["gram"].to_numpy(), frame["doc_id"].to_numpy()
        which = np.array([seen.setdefault((g, bytes(p)), len(seen)) for g, p in zip(grams.tolist(), frame["piece"], strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
        strings = [p for _, p in seen]
        marks = marked_windows(grams[first], strings, doc[first])
        some = np.array([m.any() for m in marks])
        later = doc > doc[first][which]
        told = np.flatnonzero(later | some[which])
        windows = np.array([len(s) - WINDOW + 1 for s in strings], np.int64)
        return pd.DataFrame({
            "number": frame["number"].to_numpy()[told], "start": frame["start"].to_numpy()[told], "windows": windows[which[told]],
            "marks": [None if all_ else marks[w].astype(np.uint8).tobytes() for all_, w in zip(later[told].tolist(), which[told].tolist(), strict=True)],
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(settle, SPANS)


def _by_window(rows: DataFrame) -> DataFrame:
    """The same for grams that very many texts have, by SQL functions: no task holds all rows of a gram."""
    pieces = settled(rows.groupBy("piece").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "pieces")
    each = pieces.select("piece", "first", "last", F.explode(F.sequence(F.lit(0), F.length("piece") - WINDOW)).alias("i"))
    each = each.withColumn("w", F.expr(f"substring(piece, i + 1, {WINDOW})"))
    least = each.groupBy("w").agg(F.min("first").alias("least"))
    met = each.join(least, "w").groupBy("piece", "first", "last").agg(
        F.array_sort(F.collect_list(F.struct("i", (F.col("least") < F.col("first")).alias("m")))).alias("all")
    )
    marks = F.array_join(F.transform("all", lambda s: F.when(s["m"], F.lit("01")).otherwise(F.lit("00"))), "")
    some = F.exists("all", lambda s: s["m"])
    found = met.where((F.col("last") > F.col("first")) | some).select("piece", "first", F.unhex(marks).alias("marks"), some.alias("some"))
    later = F.col("doc_id") > F.col("first")
    told = rows.join(settled(found, "marked-pieces"), "piece").where(later | F.col("some"))
    windows = (F.length("piece") - (WINDOW - 1)).cast("long").alias("windows")
    return told.select("number", "start", windows, F.when(~later, F.col("marks")).alias("marks"))


def _covered(starts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Bytes of a text in a marked window, and the number of maximal runs of them."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    inside = np.cumsum(step)[:-1] > 0
    return inside, int((inside & ~np.concatenate([[False], inside[:-1]])).sum())


def _cut_texts(rows: DataFrame) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
                data = np.frombuffer(_bytes(text), np.uint8)
                starts = [np.zeros(0, np.int64)]
                for span in spans if spans is not None else ():
                    if span["marks"] is None:
                        starts.append(np.arange(span["start"], span["start"] + span["windows"]))
                    else:
                        starts.append(span["start"] + np.flatnonzero(np.frombuffer(span["marks"], np.uint8)))
                inside, runs = _covered(np.concatenate(starts), len(data))
                kept = data[~inside].tobytes()
                out.append((doc, len(data), int(inside.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` may be NULL where nothing goes.

    A text is its UTF-8 bytes, a NULL text empty. Each byte in a window of 50 bytes that also begins in a row with
    a smaller id is removed; windows are judged on the input. Rows with equal ids don't count for each
    other, whatever their texts. A NULL id is neither smaller nor greater than any: its row keeps all and
    takes nothing. Texts under 50 bytes keep all. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    seeking = rows.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW))

    firsts = settled(seeking.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n_bytes").alias("n")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    grams = _packed_grams(seeking.select("key", "text"), int(buckets))
    found = grams.groupBy("bucket").applyInPandas(_shared, "key binary, grams binary")
    shared = settled(found.groupBy("key").agg(F.collect_list("grams").alias("grams")), "shared-grams")
    info = settled(firsts.join(shared, "key", "left").drop("n"), "texts")
    many = settled(shared.where("key is null").select(F.explode("grams").alias("packed")).mapInPandas(_unpacked, "gram long"), "many")
    release(firsts, shared)

    told = rows.join(info.hint("shuffle_hash"), "key", "left")
    copy = F.col("first") < F.col("doc_id")
    seeks = F.coalesce((F.col("first") == F.col("doc_id")) & F.col("grams").isNotNull(), F.lit(False))
    told = told.select(
        F.monotonically_increasing_id().alias("number"), "doc_id", "n_bytes",
        F.coalesce(copy & (F.col("n_bytes") >= WINDOW), F.lit(False)).alias("copy"),
        F.when(~seeks, F.sha2("text", 256)).alias("sha"),
        F.when(seeks, F.col("text")).alias("text"),
        F.when(seeks, F.col("grams")).alias("grams"),
    )
    told = settled(told, "told")
    release(info)
    candidates = told.where("text is not null")

    size = candidates.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))
    n_many = many.count()
    kept = F.broadcast(many) if n_many <= BROADCAST_GRAMS else many
    pieces = _stretch_rows(candidates)
    spans = _by_index(pieces.join(kept, "gram", "left_anti") if n_many else pieces, int(shards))
    if n_many:
        heavy = settled(pieces.join(kept, "gram", "left_semi").drop("gram"), "heavy-stretches")
        spans = spans.unionByName(_by_window(heavy))
    spans = spans.groupBy("number").agg(F.collect_list(F.struct("start", "windows", "marks")).alias("spans"))
    spans = settled(spans, "spans")

    answers = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    nothing, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    settled_rows = told.where("text is null").select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(nothing).alias("n_removed"),
        F.col("copy").cast("long").alias("n_spans"),
        F.when(F.col("copy"), empty).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit(b"")).alias("kept"),
    )
    whole = candidates.join(spans.hint("shuffle_hash"), "number", "left")
    return settled_rows.select(answers).unionByName(_cut_texts(whole))
