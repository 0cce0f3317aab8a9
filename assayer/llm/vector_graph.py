"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are represented by their smallest id.
2. Vectors go to the shards of their nearest few pivots, so shards overlap; a shard
   larger than a block is split, and every pair of its blocks meets once.
3. In each block every vector gets a few neighbours: of its nearest and some random ones, nearest first, those that
   no neighbour taken before is much nearer to. Edges count both ways.
4. The lists of a vector from all its shards are united.
5. Each vector is looked for in the graph of every block it meets: greedily from the block's medoids and itself, and from whatever
   lies within the range, or a little beyond it, on to all of that one's neighbours.
6. What the search has met is verified in double precision. A pair that meets in several shards
   counts in the first it shares; a block returns counts and a spanning forest of its links, never the pairs.

:func:`audit` measures recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.session import release, settled

COSINE = 0.95
#: Vectors per pivot, and the most pivots: their vectors are broadcast.
PER_PIVOT = 500
MOST_PIVOTS = 4096
OVERLAP = 3
BLOCK = 3000
#: Neighbours of a vector, those that they are chosen from, and how much nearer to a neighbour makes one dispensable.
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 16, 1.2
#: Entries of a block's graph, how far beyond the range a search goes on, and how many steps it takes without coming nearer.
MEDOIDS, SLACK, PATIENCE = 32, 0.04, 3
#: Queries that are searched for in step, and cosines that are worked out at a time.
QUERIES, PRODUCT = 512, 1 << 16


def usable(x: Column) -> Column:
    """Whether a vector has a direction: no NULL or non-finite part and not all zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def _units(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=float) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pruned_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``a, b`` of unit vectors, both ways."""
    m = len(x)
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    n = min(NEAREST, m - 1)
    chance = np.random.default_rng(m).integers(0, m, (m, RANDOM))
    among = np.concatenate([np.argpartition(-near, n - 1, axis=1)[:, :n], chance], axis=1)
    cosine = np.take_along_axis(near, among, axis=1)
    order = np.argsort(-cosine, axis=1)
    among, cosine = np.take_along_axis(among, order, axis=1), np.take_along_axis(cosine, order, axis=1)
    far, open_ = 2 - 2 * cosine, cosine > -np.inf
    ends = []
    for _ in range(DEGREE):
        some = np.flatnonzero(open_.any(axis=1))
        if not len(some):
            break
        taken = among[some, open_[some].argmax(axis=1)]
        ends.append((some, taken))
        between = 2 - 2 * near[taken[:, None], among[some]]
        between[among[some] == taken[:, None]] = -1  # itself
        open_[some] &= ALPHA**2 * between > far[some]
    a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
    pairs = np.unique(np.concatenate([a * m + b, b * m + a]))
    return pairs // m, pairs % m


def medoids(x: np.ndarray, n: int) -> np.ndarray:
    """The vector nearest to the middle, then each time the one farthest from those before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a row of ``x`` with a cosine of ``least``, as the search finds them along the edges ``a, b``.

    ``own`` is a query's place among the rows, -1 if it has none. Edges are in the order of ``a``.
    """
    begin = np.searchsorted(a, np.arange(len(x) + 1))
    entries = medoids(x, MEDOIDS)
    for at in range(0, len(queries), QUERIES):
        q, mine = queries[at : at + QUERIES], own[at : at + QUERIES]
        cosine = np.full((len(q), len(x)), -np.inf)
        cosine[:, entries] = q @ x[entries].T
        there = np.flatnonzero(mine >= 0)
        cosine[there, mine[there]] = 1.0
        opened = np.zeros(cosine.shape, bool)
        active, best, waited = np.arange(len(q)), np.full(len(q), -np.inf), np.zeros(len(q), int)
        while len(active):
            ahead = np.where(opened[active], -np.inf, cosine[active])
            nearest = ahead.argmax(axis=1)
            top = ahead[np.arange(len(active)), nearest]
            waited[active] = np.where(top > best[active], 0, waited[active] + 1)
            best[active] = np.maximum(best[active], top)
            greedy = np.flatnonzero((top > -np.inf) & (waited[active] < PATIENCE))
            i, j = np.nonzero(ahead >= least - SLACK)
            i, j = np.concatenate([active[i], active[greedy]]), np.concatenate([j, nearest[greedy]])
            if not len(i):
                break
            opened[i, j] = True
            size = begin[j + 1] - begin[j]
            to = b[np.repeat(begin[j] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            met = np.unique(np.repeat(i, size) * len(x) + to)
            i, j = met // len(x), met % len(x)
            new = cosine[i, j] == -np.inf
            i, j = i[new], j[new]
            if 8 * len(i) > cosine.size:  # most of a dense block: one product costs less than gathering pairs
                cosine[i, j] = (q @ x.T)[i, j]
            else:
                for k in range(0, len(i), PRODUCT):
                    u, v = i[k : k + PRODUCT], j[k : k + PRODUCT]
                    cosine[u, v] = np.einsum("ij,ij->i", q[u], x[v])
            going = waited < PATIENCE
            going[i] = True
            active = active[going[active]]
        u, v = np.nonzero(cosine >= least - 1e-9)
        keep = np.einsum("ij,ij->i", q[u], x[v]) >= least
        keep &= mine[u] != v
        yield at + u[keep], v[keep]


def _graph_of_block(frame: pd.DataFrame) -> pd.DataFrame:
    """``node, neighbours`` of one block of one shard."""
    frame = frame.sort_values("node", ignore_index=True)
    node = frame["node"].to_numpy()
    a, b = pruned_graph(_units(frame["x"]))
    at = np.searchsorted(a, np.arange(len(node) + 1))
    return pd.DataFrame({"node": node, "neighbours": [node[b[at[i] : at[i + 1]]] for i in range(len(node))]})


def _search_block(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """``node, links, root`` of the nodes that have links here."""
    shard, first, second = (frame[c].iloc[0] for c in ("shard", "first", "second"))
    frame = frame.sort_values("node", ignore_index=True)
    node, copies, x = frame["node"].to_numpy(), frame["copies"].to_numpy(), _units(frame["x"])
    shards = np.full((len(frame), OVERLAP), -1)
    for i, own in enumerate(frame["shards"]):
        shards[i, : len(own)] = own
    block = frame["block"].to_numpy()
    query, rows = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, root = np.zeros(len(node)), np.arange(len(node))
    if not len(query) or not len(rows):
        return pd.DataFrame({"node": node[:0], "links": np.zeros(0, np.int64), "root": node[:0]})

    lists = frame["neighbours"].to_numpy()[rows]
    a = np.repeat(np.arange(len(rows)), [len(v) for v in lists])
    named = np.concatenate(lists).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    b = np.minimum(np.searchsorted(node[rows], named), len(rows) - 1)
    here = node[rows][b] == named  # neighbours of other blocks aren't met here
    own = np.full(len(query), -1)
    if first == second:
        own = np.arange(len(rows))
    pairs = []
    for u, v in range_search(x[query], own, x[rows], a[here], b[here], least):
        low, high = np.minimum(query[u], rows[v]), np.maximum(query[u], rows[v])
        pairs.append(low * len(node) + high)
    pairs = np.unique(np.concatenate(pairs))  # a pair may be found from either end
    for at in range(0, len(pairs), 1 << 20):
        a, b = pairs[at : at + (1 << 20)] // len(node), pairs[at : at + (1 << 20)] % len(node)
        common = np.where((shards[a][:, :, None] == shards[b][:, None, :]) & (shards[a][:, :, None] >= 0), shards[a][:, :, None], np.iinfo(int).max)
        counted = common.min(axis=(1, 2)) == shard
        links += np.bincount(a[counted], copies[b[counted]], len(node)) + np.bincount(b[counted], copies[a[counted]], len(node))
        while len(a):  # smallest label of both ends, until nothing moves
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
    # a pair that counts in another shard leaves its edge here all the same
    touched = np.union1d(np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node))))
    return pd.DataFrame({"node": node[touched], "links": links[touched].astype(np.int64), "root": node[root[touched]]})


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors of equal length are linked if their cosine is at least ``least``; labels
    and other columns are ignored. Vectors that are NULL, empty, zero or hold NULL or
    non-finite parts link with nothing. Rows repeated in full are one vector; rows that share an id
    and differ are one node of the graph, with the links of all of them. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x"))
    good = rows.where(usable(F.col("x")) & F.col("vec_id").isNotNull())
    reps = good.distinct().groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    reps = settled(reps, "vectors")
    dealt = settled(_dealt(reps), "dealt")
    sizes = settled(dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "shards")
    placed = dealt.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = settled(placed, "placed")
    release(dealt, sizes)

    lists = placed.groupBy("shard", "block").applyInPandas(_graph_of_block, "node long, neighbours array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    graph = settled(graph, "graph")
    met = placed.join(graph, "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = met.drop("other", "blocks").groupBy("shard", "first", "second").applyInPandas(
        lambda frame: _search_block(frame, least), "node long, links long, root long"
    )
    found = settled(found, "found")
    links = settled(found.groupBy("node").agg(F.sum("links").alias("links")), "links")
    classes = settled(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "classes")
    of_node = reps.join(links, "node", "left").join(classes, "node", "left")
    of_node = settled(of_node.select("x", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "answers")
    linked = rows.withColumn("x", F.when(usable(F.col("x")) & F.col("vec_id").isNotNull(), F.col("x"))).join(of_node, "x", "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _dealt(reps: DataFrame) -> DataFrame:
    """Each vector once for each of its shards. Vectors of another length have shards of their own."""
    wanted = min(MOST_PIVOTS, -(-reps.count() // PER_PIVOT))
    sample = reps.select("x", F.size("x").alias("d")).orderBy(F.xxhash64("node"), "node").limit(max(1, wanted)).toPandas()
    pivots = {int(d): _units(part["x"]) for d, part in sample.groupby("d")}
    kind = dict(reps.dtypes)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby(frame["x"].map(len)):
                if d in pivots:
                    near = _units(part["x"]) @ pivots[d].T
                    shards = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
                else:
                    shards = np.zeros((len(part), 1), int)
                shards = shards + int(d) * MOST_PIVOTS
                yield part.assign(shards=list(np.sort(shards, axis=1)))

    made = reps.mapInPandas(deal, f"x {kind['x']}, node {kind['node']}, copies long, shards array<long>")
    return made.withColumn("shard", F.explode("shards"))


def audit(vectors: DataFrame, found: DataFrame, every: int = 100, least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, n_true``: found and true links of each ``every``-th id, the truth by brute force.

    The queries are compared with all rows, block by block; recall is the quotient of the sums.
    """
    good = vectors.select("vec_id", F.col("embedding").alias("x")).where(usable(F.col("x")) & F.col("vec_id").isNotNull())
    asked = good.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK))

    def packed(rows: DataFrame, parts: int, prefix: str) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(f"{prefix}_part")
        lists = [F.collect_list(c).alias(f"{prefix}_{c}") for c in ("vec_id", "x")]
        return rows.groupBy(part).agg(*lists)

    queries = packed(asked, blocks, "q")
    rows = packed(good, max(1, -(-good.count() // BLOCK)), "r").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                near = _units(r.q_x) @ _units(r.r_x).T >= least
                ids = np.asarray(r.q_vec_id)
                yield pd.DataFrame({"vec_id": ids, "n": (near & (ids[:, None] != np.asarray(r.r_vec_id))).sum(axis=1)})

    met = rows.join(queries, "q_part").select("q_vec_id", "q_x", "r_vec_id", "r_x")
    truth = met.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_true"))
    return found.select("vec_id", "n_links").join(truth, "vec_id")
