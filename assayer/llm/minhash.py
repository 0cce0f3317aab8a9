"""Near-duplicate documents by MinHash bands, verified on full shingle sets.

1. Every text becomes a set of hashed word shingles; equal sets share a digest and are
   represented by their smallest id, so copies never meet in pairs.
2. Minima of universal hashes are cut into bands. In each bucket of equal bands every
   document is paired only with the bucket's most central one, which meets most others over all
   its buckets, and the pairs are verified: the original of many edited copies
   links with all of them, while two copies need not be similar.
3. Components of the verified links leave few buckets with more than one component.
   There the rest is compared, in blocks of bounded size, by signatures and then on full
   sets within the task.
4. Components of all links are the classes. No bucket or group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_text
from assayer.llm.components import components
from assayer.session import settled

BANDS = 28
ROWS = 5
#: Documents, and shingles, of a block in which a bucket's rest is compared.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Estimates this far below the threshold (six standard deviations) are not verified.
MARGIN = 0.2

_M = np.uint64
_seeds = np.random.Generator(np.random.PCG64(20240607))
_FACTORS = _seeds.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _M(2) + _M(1)
_SHIFTS = _seeds.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _seeds.integers(0, 1 << 63, 64, dtype=np.uint64) * _M(2) + _M(1)
_STRIDE = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashed shingles of a whole text, sorted.

    Words are runs without ASCII white space, A to Z in lower case; fewer words than
    ``size`` make one shingle, none make none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total * _M(31) + hashed[i : len(words) - size + 1 + i] * _PLACES[i % 64])
    return np.unique(total)


def minima(x: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), _STRIDE):
        hashed = x[None, at : at + _STRIDE] * _FACTORS[:, None]
        hashed += _SHIFTS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, lo, hi, bands`` of every row ``doc_id, text``."""

    def sign(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for text in texts:
                x = shingles(text, size)
                if not len(x):
                    rows.append((0, 0, 0, None))
                    continue
                least = minima(x)
                bands = _mixed((_mixed(least).reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64))
                lo, hi = _mixed(x).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(x + _M(1)))
                rows.append((len(x), lo.view(np.int64), hi.view(np.int64), bands.view(np.int64)))
            yield pd.DataFrame(rows, columns=["n_shingles", "lo", "hi", "bands"])

    sign.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = "n_shingles long, lo long, hi long, bands array<long>"
    return docs.select("doc_id", F.pandas_udf(sign, kind)("text").alias("s")).select("doc_id", "s.*")


def shingle_array(text: Column, size: int) -> Column:
    def measure(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([shingles(t, size).view(np.int64) for t in texts])

    measure.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(measure, "array<long>")(text)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough."""
    pairs = settled(pairs.distinct(), "pairs")
    involved = settled(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    texts = docs.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = settled(texts.select("doc_id", shingle_array(F.col("text"), size).alias("x")), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("x").alias("xa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("x").alias("xb")), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    similar = 100 * shared >= percent * (F.size("xa") + F.size("xb") - shared)
    return settled(both.where(similar).select("a", "b"), "links")


def _rest_of_buckets(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components that meet in a bucket, from its members ``band, key, node, component``.

    Every pair of a bucket's blocks meets in one task, which holds the full sets: signatures
    rule pairs out, the sets verify the others. Two components are linked once in a task, so
    neither candidates nor all links of a group leave it. Blocks are bounded in documents
    and in shingles.
    """
    least = percent / 100 - MARGIN

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        node, group, block = (frame[c].to_numpy() for c in ("node", "component", "block"))
        group = group.copy()
        first, second = frame["first"].iloc[0], frame["second"].iloc[0]
        sets = list(frame["x"])
        signature = np.stack([minima(x.view(np.uint64)) >> _M(40) for x in sets]).astype(np.uint8)
        length = np.array([len(x) for x in sets])
        ends = np.cumsum(length)
        distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids.astype(np.int32), ends[:-1])
        held = np.zeros(len(distinct), bool)
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        found = []
        for i in a:
            others = b[group[b] != group[i]]
            if first == second:
                others = others[others > i]
            low, high = np.minimum(length[others], length[i]), np.maximum(length[others], length[i])
            others = others[100 * low >= percent * high]
            others = others[(signature[others] == signature[i]).mean(axis=1) >= least]
            if not len(others):
                continue
            held[ids[i]] = True
            starts = np.r_[0, np.cumsum(length[others])[:-1]]
            shared = np.add.reduceat(held[np.concatenate([ids[j] for j in others])].astype(np.int64), starts)
            held[ids[i]] = False
            for j in others[100 * shared >= percent * (length[i] + length[others] - shared)]:
                if group[j] != group[i]:
                    found.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    involved = settled(rows.select(F.col("node").alias("doc_id")).distinct(), "involved")
    texts = docs.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = texts.select(F.col("doc_id").alias("node"), shingle_array(F.col("text"), size).alias("x"))
    # filtered after it is written: the filter would move below the join, and every text be measured
    sets = settled(sets.distinct(), "sets").where(F.size("x") > 0)
    sizes = rows.join(sets.select("node", F.size("x").alias("s")), "node").groupBy("band", "key")
    needed = F.greatest(F.count("*") / BLOCK, F.sum("s") / BLOCK_SHINGLES)
    blocks = settled(sizes.agg(F.ceil(needed).cast("int").alias("blocks")), "blocks")
    dealt = rows.join(blocks, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node", "band"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    dealt = dealt.select("band", "key", "first", "second", "block", "node", "component").join(sets, "node")
    return dealt.groupBy("band", "key", "first", "second").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows whose shingle sets have ``100 * intersection >= percent * union`` are linked;
    a component's id is its smallest ``doc_id``, and that document is kept. NULL and empty
    texts have no shingles and link with nothing. Rows that repeat a ``doc_id`` are
    one document with the links of all its texts. NULL ids are never linked.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    sets = settled(signed(rows, size), "signed")
    equal = ["n_shingles", "lo", "hi"]
    named = sets.where("n_shingles > 0 and doc_id is not null")
    copies = settled(named.groupBy(equal).agg(F.min("doc_id").alias("node")), "copies")
    linked = settled(named.join(copies, equal), "represented")

    nodes = linked.where("doc_id = node").dropDuplicates(["node", *equal]).select("node", "bands")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = settled(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = settled(banded.join(buckets, ["band", "key"]), "members")
    meets = settled(members.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    central = members.join(meets, "node").groupBy("band", "key").agg(
        F.max(F.struct("meets", (-F.col("node")).alias("before"))).alias("best")
    )
    central = settled(central.select("band", "key", (-F.col("best.before")).alias("m")), "central")
    paired = members.join(central, ["band", "key"]).where("node <> m")
    stars = settled(paired.select(F.greatest("node", "m").alias("a"), F.least("node", "m").alias("b")).distinct(), "stars")
    links = verified(stars, rows, size, percent)
    groups = settled(components(links), "groups")

    grouped = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = settled(grouped, "grouped")
    mixed = grouped.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = settled(mixed.where("lo < hi").select("band", "key"), "mixed")
    # a bucket of two was verified whole
    rest = grouped.where("n > 2").join(mixed, ["band", "key"]).select("band", "key", "node", "component")
    links = settled(_rest_of_buckets(settled(rest, "rest"), rows, size, percent).distinct(), "more")

    of_ids = linked.select("doc_id", "node").distinct().groupBy("doc_id")
    shared = of_ids.agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").drop("hi")
    repeated = linked.join(settled(shared, "repeated"), "doc_id").select(F.col("node").alias("a"), "b")
    found = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = settled(components(links.unionByName(found).unionByName(repeated)), "classes")

    alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    out = linked.select("doc_id", "n_shingles", "node").unionByName(alone).join(classes, "node", "left")
    component = F.coalesce("component", "node")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
