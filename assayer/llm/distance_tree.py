"""Hard negatives by a multiway hyperplane tree with distance ranges (in the manner of GNAT).

A node of the tree has a few split points, far from each other; a row belongs to the subtree of its
nearest one. For each split point and each sibling subtree the node stores the
range of the distances between them, over *all* rows. The points come from a bounded sample of
rows; the ranges, the norms and the leaves cover every row.

A score window of an anchor is an annulus around it: with ``d2 = |a|2 + |x|2 - 2 a.x``, scores from
``low`` to ``high`` of rows with norms in a known range lie between two distances.
A subtree is eliminated if, for some split point, the triangle inequality keeps its range out of
the annulus. Rows of the leaves that are left are compared exactly, in whole numbers.

1. An anchor's own leaf gives a lower bound of its last positive's score.
2. The window from there up gives the positives.
3. Each positive gives a window of its own, in which the negatives are sought: in the own leaf first,
   whose last negative raises the window's lower end.

Leaves are written as blocks of rows and dealt to shelves, runs of neighbouring leaves of a bounded number of bytes.
An anchor goes once to each shelf that has a leaf it asks, with marks of those leaves. A task holds one shelf and
lets the anchors pass, a group at a time; per group and shelf only the best of each window leave it. So
memory follows neither the number of leaves, nor of anchors, nor of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.vector_codes import finite, whole_numbers
from assayer.session import release, settled, shuffle_partitions

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores between this many hundredths of the positive and the positive.
LEAST_PERCENT = 80
#: The tree is grown on at most so many rows; fewer points than rows, so its size is bounded too.
SAMPLE = 20_000
DEGREE = 12
MOST_LEAVES = 4096
BLOCK = 2048
ANCHORS = 512
#: Bytes of a block or a group of anchors, of a shelf, and of the questions that are handed on at once.
BLOCK_BYTES, SHELF_BYTES, SENT_BYTES = 1 << 20, 24 << 20, 8 << 20
EXACT_SINGLE, EXACT_DOUBLE = 1 << 24, 1 << 53
#: Where more than one of so many scores is above its bound, the best are parted off before they are sorted.
FEW = 16
#: Distances are rounded, so ranges are widened by this share.
SLACK = 1e-6


class Tree:
    """Nodes by number; a node's children are nodes or, as negative numbers, leaves (-1 is leaf 0)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        least = max(2, -(-len(sample) // max(1, leaves)))
        self.root = self._grow(sample, least)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, rows: np.ndarray, least: int) -> int:
        if len(rows) <= least:
            return self._leaf()
        chosen = self._apart(rows)
        if len(chosen) < 2:  # all rows are equal
            return self._leaf()
        node = len(self.points)
        self.points.append(rows[chosen])
        self.children.append([])
        side = distances(rows, rows[chosen]).argmin(axis=1)
        self.children[node] = [self._grow(rows[side == j], least) for j in range(len(chosen))]
        return node

    def _apart(self, rows: np.ndarray) -> list[int]:
        """Of the first rows each time the farthest from those chosen."""
        some = rows[: 20 * DEGREE]
        chosen, nearest = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < DEGREE and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(some, some[chosen[-1:]])[:, 0])
        return chosen

    def routed(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Leaf of each row; for each node met its rows, their distances to the points, and their subtrees."""
        leaf, met, todo = np.zeros(len(x), np.int64), {}, [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -node - 1
            elif len(rows):
                far = distances(x[rows], self.points[node])
                side = far.argmin(axis=1)
                met[node] = rows, far, side
                todo += [(child, rows[side == j]) for j, child in enumerate(self.children[node])]
        return leaf, met


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


class Ranges:
    """Least and greatest distance of each split point to each sibling subtree, and norms of subtrees."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
        self.norms = [np.array([[np.inf] * len(p), [-np.inf] * len(p)]) for p in tree.points]

    def surviving(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, each with the numbers of the anchors whose window of scores may have rows there."""
        length = np.sqrt((anchors * anchors).sum(axis=1))
        todo = [(self.tree.root, np.arange(len(anchors)))]
        while todo:
            node, asked = todo.pop()
            if not len(asked):
                continue
            if node < 0:
                yield -node - 1, asked
                continue
            far = distances(anchors[asked], self.tree.points[node])
            square = length[asked] ** 2
            for j, child in enumerate(self.tree.children[node]):
                short, long = self.norms[node][:, j]
                if short > long:  # no row
                    continue
                inner = np.sqrt(np.maximum(0.0, square + short**2 - 2 * high[asked]))
                outer2 = square + long**2 - 2 * low[asked]
                outer = np.sqrt(np.maximum(0.0, outer2))
                least, most = self.low[node][:, j], self.high[node][:, j]
                nearest = np.maximum(0.0, np.maximum(far - most, least - far)).max(axis=1)
                farthest = (far + most).min(axis=1)
                slack = SLACK * (1 + length[asked] + long)
                # a greater |x| allows a greater score, and scores are bounded by both lengths
                held = (outer2 >= -slack * long) & (nearest <= outer + slack) & (farthest >= inner - slack)
                held &= length[asked] * long * (1 + SLACK) + SLACK >= low[asked]
                todo.append((child, asked[held]))


class Form:
    """How vectors are packed (as whole numbers), and in what type their products are exact."""

    def __init__(self, width: int, most: float):
        self.width = width
        self.kind = np.dtype(np.int16 if most < 1 << 15 else np.int32)
        self.real = np.dtype(np.float32 if width * most**2 < EXACT_SINGLE else np.float64)
        self.row_bytes = width * self.kind.itemsize

    def rows_of(self, most: int) -> int:
        """So many rows, or what a block's bytes hold."""
        return max(1, min(most, BLOCK_BYTES // self.row_bytes))

    def read(self, data: bytes | memoryview) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width)

    def column(self, x: np.ndarray) -> pa.Array:
        """One binary value per row."""
        ends = np.arange(len(x) + 1, dtype=np.int32) * self.row_bytes
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, self.kind))])

    def matrix(self, column: pa.Array) -> np.ndarray:
        return self.read(b"".join(v.as_buffer() for v in column)).astype(np.float64)


def grown(rows: DataFrame, n: int) -> Tree:
    """A tree from a bounded sample: the rows whose hashed ids are least."""
    hashed = rows.select("x", F.xxhash64("vec_id").alias("h"), "vec_id")
    least = lambda among: among.orderBy("h", "vec_id").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
    # twice as many as needed lie below this hash; the others need not be sorted
    share = 2 * SAMPLE / max(n, 1)
    sample = least(hashed.where(F.col("h") < -(1 << 63) + int(share * (1 << 64))) if share < 1 else hashed)
    if len(sample) < min(n, SAMPLE):
        sample = least(hashed)
    x = sample.flatten().to_numpy().reshape(len(sample), -1) if len(sample) else np.zeros((0, 1))
    return Tree(x, min(MOST_LEAVES, -(-n // BLOCK)))


def placed(rows: DataFrame, tree: Tree, form: Form) -> DataFrame:
    """Adds the ``leaf``, and packs the vectors."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                leaf = tree.routed(x)[0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(leaf), form.column(x)], names=["vec_id", "label", "leaf", "x"])

    return rows.select("vec_id", "label", "x").mapInArrow(place, "vec_id long, label long, leaf long, x binary")


class Shelves:
    """Which shelves have a leaf's blocks. Leaves lie in order, a large one over several shelves."""

    def __init__(self, counts: np.ndarray, per_block: int, per_shelf: int):
        self.counts, self.per_shelf = counts, max(1, per_shelf)
        self.parts = -(-counts // per_block)
        self.start = np.cumsum(counts) - counts
        first = self.start // self.per_shelf
        last = self._last()
        there = np.flatnonzero(counts)
        self.n = int(last[there].max()) + 1 if len(there) else 1
        #: of each shelf its first leaf, and the first one after it
        self.low = [int(there[np.searchsorted(last[there], k)]) for k in range(self.n)] if len(there) else [0]
        self.high = [int(there[np.searchsorted(first[there], k, "right") - 1]) + 1 for k in range(self.n)] if len(there) else [0]

    def _last(self) -> np.ndarray:
        return (self.start + (self.parts - 1) * self.counts // np.maximum(self.parts, 1)) // self.per_shelf

    def table(self, like: DataFrame) -> DataFrame:
        """``leaf, parts, start, rows`` of leaves that have rows."""
        there = np.flatnonzero(self.counts)
        columns = [c.tolist() for c in (there, self.parts[there], self.start[there], self.counts[there])]
        return like.sparkSession.createDataFrame(list(zip(*columns, strict=True)), "leaf long, parts long, start long, rows long")


def shelved(at_leaf: DataFrame, tree: Tree, form: Form, n: int, anchors: int) -> Shelves:
    """As many shelves as the bytes ask for; as many as tasks, while anchors sent to all of them are no more than the rows."""
    counts = np.zeros(tree.leaves, np.int64)
    for r in at_leaf.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    for_bytes = -(-n * (form.row_bytes + 16) // SHELF_BYTES)
    shelves = max(1, for_bytes, min(shuffle_partitions(at_leaf.sparkSession), n // max(1, anchors)))
    return Shelves(counts, form.rows_of(BLOCK), -(-n // shelves))


#: Blocks, and questions to them: ``leaf`` is a block's own, or the first one asked.
SHELVED = "shelf int, asks boolean, leaf long, ids binary, labels binary, data binary, low binary, high binary, marks binary"


def blocks(at_leaf: DataFrame, shelves: Shelves) -> DataFrame:
    """One row per block of a leaf: ids, labels and vectors as bytes. A large leaf has many blocks."""
    dealt = at_leaf.join(F.broadcast(shelves.table(at_leaf)), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    place = F.expr(f"(start + part * rows div parts) div {shelves.per_shelf}").cast("int")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        ids, labels = (frame[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
        row = frame["shelf"].iloc[0], False, frame["leaf"].iloc[0], ids, labels, b"".join(frame["x"]), None, None, None
        return pd.DataFrame([row], columns=["shelf", "asks", "leaf", "ids", "labels", "data", "low", "high", "marks"])

    return dealt.withColumn("shelf", place).drop("parts", "start", "rows").groupBy("leaf", "part").applyInPandas(pack, SHELVED)


def measured(leaves: DataFrame, tree: Tree, form: Form) -> Ranges:
    """Ranges over all rows: folded within the task, then in Spark, then one row per pair of a node."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranges(tree)
        for batch in batches:
            for data in batch.column("data"):
                x = form.read(data.as_buffer()).astype(np.float64)
                length = np.sqrt((x * x).sum(axis=1))
                for node, (members, far, side) in tree.routed(x)[1].items():
                    for j in np.unique(side):
                        mine = side == j
                        own.low[node][:, j] = np.minimum(own.low[node][:, j], far[mine].min(axis=0))
                        own.high[node][:, j] = np.maximum(own.high[node][:, j], far[mine].max(axis=0))
                        norms = length[members[mine]]
                        own.norms[node][:, j] = min(own.norms[node][0, j], norms.min()), max(own.norms[node][1, j], norms.max())
        out = []
        for node in range(len(tree.points)):
            for j in np.flatnonzero(own.norms[node][0] <= own.norms[node][1]):
                out += [(node, i, int(j), own.low[node][i, j], own.high[node][i, j]) for i in range(len(tree.points[node]))]
                out.append((node, -1, int(j), *own.norms[node][:, j]))
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "i", "j", "low", "high"])

    found = leaves.select("data").mapInArrow(fold, "node int, i int, j int, low double, high double")
    ranges = Ranges(tree)
    # the columns one after the other: a row object for each would take ten times the room
    for node, i, j, low, high in zip(*(c.to_numpy() for c in found.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).toArrow().columns), strict=True):
        if i < 0:
            ranges.norms[node][:, j] = low, high
        else:
            ranges.low[node][i, j], ranges.high[node][i, j] = low, high
    return ranges


def in_pieces(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows whose bytes come to about so many at once."""
    piece, size = [], 0
    for row in rows:
        piece.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= most:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def asked(anchors: DataFrame, tree: Tree, ranges: Ranges | None, shelves: Shelves, form: Form, windows: int) -> DataFrame:
    """Groups of questions by shelf: with ranges to every leaf that may answer, else to each anchor's own leaf.

    ``anchors`` has ``vec_id, label, leaf, x`` and the ends ``low, high`` of up to so many windows of scores.
    """
    group = form.rows_of(ANCHORS)
    names = [c.split()[0] for c in SHELVED.split(", ")]
    kinds = pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 6

    def ends(column: pa.Array, lacking: float) -> np.ndarray:
        out = np.full((len(column), windows), lacking)
        sizes = np.diff(column.offsets.to_numpy())
        out[np.arange(windows) < sizes[:, None]] = column.flatten().to_numpy()
        return out

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def by_shelf(marks: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        for shelf in range(shelves.n):
            there = marks[shelves.low[shelf] : shelves.high[shelf]]
            who = np.flatnonzero(there.any(axis=0))
            if len(who):
                first = shelves.low[shelf] + int(there.any(axis=1).argmax())
                yield shelf, True, first, *(c[who].tobytes() for c in columns), np.packbits(there[:, who], axis=1).tobytes()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                x = form.matrix(batch.column("x"))
                ids, labels, own = (batch.column(c).to_numpy() for c in ("vec_id", "label", "leaf"))
                low, high = ends(batch.column("low"), np.inf), ends(batch.column("high"), -np.inf)
                marks = np.zeros((tree.leaves, len(x)), bool)
                if ranges is None:
                    marks[own, np.arange(len(x))] = True
                else:
                    for leaf, who in ranges.surviving(x, low.min(axis=1), high.max(axis=1)):
                        marks[leaf, who] = True
                rows = by_shelf(marks, ids, labels, x.astype(form.kind), low, high)
                yield from (sent(piece) for piece in in_pieces(rows, SENT_BYTES))

    return anchors.select("vec_id", "label", "leaf", "x", "low", "high").mapInArrow(ask, SHELVED)


class Shelf:
    """Blocks of neighbouring leaves put together to chunks of some size, the rows of each by their ids."""

    def __init__(self, held: list[tuple[int, bytes, bytes, bytes]], form: Form, per_chunk: int):
        self.form = form
        self.chunks: list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]] = []
        held.sort(key=lambda b: b[0])
        while held:
            some, size = [], 0
            while held and (not some or size + len(held[-1][1]) // 8 <= per_chunk):
                some.append(held.pop())
                size += len(some[-1][1]) // 8
            ids, labels = (np.frombuffer(b"".join(b[k] for b in some), np.int64) for k in (1, 2))
            x = form.read(b"".join(b[3] for b in some))
            order = np.argsort(ids)
            self.chunks.append((sorted({b[0] for b in some}), ids[order], labels[order], x[order]))


def few_true(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of flags that are seldom set, eight at a time."""
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64))
    word, byte = np.nonzero(flags[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, whole + np.flatnonzero(flags[whole:])])


class Best:
    """The best ``most`` rows of each window of a group of anchors: higher scores first, equal ones by their smaller id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same_label: bool, most: int):
        self.ids, self.labels, self.same_label, self.most = ids, labels, same_label, most
        self.low, self.high = low, high
        self.score = np.full((low.size, most), -np.inf)
        self.found = np.zeros((low.size, most), np.int64)

    def seek(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Takes up what rows, in the order of their ids, score with some of the anchors."""
        windows = self.low.shape[1]
        # scores are whole numbers; one equal to the last so far counts only with a smaller id
        last = self.score[:, -1] + (self.found[:, -1] < ids[0])
        low = np.maximum(self.low[who], last.reshape(self.low.shape)[who])
        high = self.high[who]
        above = score >= np.where(low <= high, low, np.inf).min(axis=1).astype(score.dtype)[:, None]
        each = np.count_nonzero(above)
        if not each:
            return
        got = []
        if each * FEW <= above.size:
            row, col = np.divmod(few_true(above.ravel()), score.shape[1])
            fits = ((self.labels[who[row]] == labels[col]) == self.same_label) & (self.ids[who[row]] != ids[col])
            row, col = row[fits], col[fits]
            s = score[row, col]
            for w in range(windows):
                fits = (s >= low[row, w]) & (s <= high[row, w])
                got.append((who[row[fits]] * windows + w, s[fits], ids[col[fits]]))
        else:
            above &= ((self.labels[who][:, None] == labels) == self.same_label) & (self.ids[who][:, None] != ids)
            for w in range(windows):
                held = np.where(above & (score >= low[:, w, None].astype(score.dtype)) & (score <= high[:, w, None].astype(score.dtype)), score, -np.inf)
                if len(ids) > self.most:
                    last = np.partition(held, len(ids) - self.most, axis=1)[:, len(ids) - self.most][:, None]
                    over, even = held > last, held == last
                    # of equals the first ones
                    held[~(over | (even & (np.cumsum(even, axis=1, dtype=np.int32) <= self.most - over.sum(axis=1)[:, None])))] = -np.inf
                row, col = np.nonzero(held > -np.inf)
                got.append((who[row] * windows + w, held[row, col], ids[col]))
        self._take(*map(np.concatenate, zip(*got, strict=True)))

    def _take(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        old = np.unique(window)
        had, at = np.nonzero(self.score[old] > -np.inf)
        window = np.concatenate([window, old[had]])
        score = np.concatenate([score.astype(np.float64), self.score[old[had], at]])
        ids = np.concatenate([ids, self.found[old[had], at]])
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = place < self.most
        self.score[window[kept], place[kept]] = score[kept]
        self.found[window[kept], place[kept]] = ids[kept]

    def rows(self) -> pd.DataFrame:
        """``anchor_id, vec_id, score``, each once."""
        row, col = np.nonzero(self.score > -np.inf)
        out = pd.DataFrame({"anchor_id": self.ids[row // self.low.shape[1]], "vec_id": self.found[row, col], "score": self.score[row, col].astype(np.int64)})
        return out.drop_duplicates()


def answered(questions: DataFrame, leaves: DataFrame, shelves: Shelves, form: Form, windows: int, same_label: bool, most: int) -> DataFrame:
    """``anchor_id, vec_id, score``: rows among which are the best ``most`` of each window, by exact comparison.

    Rows have, or have not, the anchor's label.
    """
    group, per_chunk = form.rows_of(ANCHORS), form.rows_of(BLOCK)

    def replies(shelf: Shelf, number: int, waiting: list[tuple]) -> pa.RecordBatch:
        leaf0, n = shelves.low[number], shelves.high[number] - shelves.low[number]
        ids, labels = (np.frombuffer(b"".join(q[k] for q in waiting), np.int64) for k in (0, 1))
        x = form.read(b"".join(q[2] for q in waiting)).astype(form.real)
        low, high = (np.frombuffer(b"".join(q[k] for q in waiting)).reshape(-1, windows) for k in (3, 4))
        marks = [np.unpackbits(np.frombuffer(q[5], np.uint8).reshape(n, -1), axis=1, count=len(q[0]) // 8) for q in waiting]
        marks = np.concatenate(marks, axis=1).astype(bool)
        best = Best(ids, labels, low, high, same_label, most)
        for in_leaves, their_ids, their_labels, their_x in shelf.chunks:
            who = np.flatnonzero(marks[[k - leaf0 for k in in_leaves]].any(axis=0))
            for at in range(0, len(who), group):
                some = who[at : at + group]
                best.seek(some, x[some] @ their_x.astype(form.real).T, their_ids, their_labels)
        return pa.RecordBatch.from_pandas(best.rows(), preserve_index=False)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shelf, waiting, n = -1, [], None, [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("ids", "labels", "data", "low", "high", "marks")]
            for r, (at, asks, leaf) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shelf", "asks", "leaf")), strict=True)):
                if waiting and (at != number or n >= group):
                    yield replies(shelf, number, waiting)
                    waiting, n = [], 0
                if at != number:
                    number, held, shelf = at, [], None
                if not asks:
                    held.append((leaf, *(c[r].as_py() for c in columns[:3])))
                    continue
                if shelf is None:  # the blocks come first
                    shelf = Shelf(held, form, per_chunk)
                waiting.append(tuple(c[r].as_py() for c in columns))
                n += len(waiting[-1][0]) // 8
            del batch, columns  # else it stays while the next one is read
        if waiting:
            yield replies(shelf, number, waiting)

    met = leaves.unionByName(questions).repartitionById(shelves.n, F.col("shelf")).sortWithinPartitions("shelf", "asks", "leaf")
    return met.mapInArrow(answer, "anchor_id long, vec_id long, score long")


def best(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best ``most`` by ``rank``: higher scores first, equal ones by their smaller id."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A row's score is the inner product with the
    anchor, both in whole numbers of 1/256. An anchor's positives are its best other rows of the same
    label; its negatives are, for each positive, the best rows of other labels between ``least_percent``
    hundredths of the positive's score and that score (none below zero). Ties go to smaller ids.

    Rows without an id or a label, and rows whose vector is NULL or holds NULL or non-finite
    parts, take no part; other columns are ignored. Of rows that share an id the one of the least label and vector stands,
    so full repeats count once. Shorter vectors are filled up with zeros. An empty table
    gives an empty one. Scores beyond the exact range of a double raise ``ArithmeticError``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("raw")))
    rows = rows.select("vec_id", "label", F.transform(whole_numbers(F.col("raw"), SCALE), lambda v: v.cast("double")).alias("x"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    rows = settled(rows, "rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    width = max(size["d"] or 0, 1)
    if width * (size["m"] or 0) ** 2 >= EXACT_DOUBLE:
        raise ArithmeticError("scores of these vectors are not exact in double precision")
    full = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x"))))

    form = Form(width, size["m"] or 0)
    tree = grown(full, size["n"])
    at_leaf = settled(placed(full, tree, form), "placed")
    release(rows)
    shelves = shelved(at_leaf, tree, form, size["n"], size["anchors"] or 0)
    leaves = settled(blocks(at_leaf, shelves), "leaves")
    anchors = settled(at_leaf.where(F.col("vec_id") % every == 0), "anchors")
    release(at_leaf)
    ranges = measured(leaves, tree, form)

    # one task for each group of anchors, if there are so many
    tasks = max(1, min(shuffle_partitions(at_leaf.sparkSession), (size["anchors"] or 0) // form.rows_of(ANCHORS)))

    def search(queries: DataFrame, within: Ranges | None, windows: int, same_label: bool, most: int) -> DataFrame:
        return answered(asked(queries.repartition(tasks), tree, within, shelves, form, windows), leaves, shelves, form, windows, same_label, most)

    low, high = F.col("low"), F.array(F.lit(float("inf"))).alias("high")
    near = settled(best(search(anchors.select("*", F.array(F.lit(float("-inf"))).alias("low"), high), None, 1, True, positives), ["anchor_id"], positives), "near")
    bound = near.where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.array(F.col("score").cast("double")).alias("low"))
    from_bound = anchors.join(bound, "vec_id", "left").withColumn("low", F.coalesce(low, F.array(F.lit(float("-inf"))))).select("*", high)
    found = settled(best(search(from_bound, ranges, 1, True, positives), ["anchor_id"], positives), "positives")
    release(near)

    # whole numbers: 100 * negative >= least_percent * positive
    least = F.ceil(F.col("score") * least_percent / 100).cast("double")
    windows = found.where("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"))

    def queries(of: DataFrame) -> DataFrame:
        ends = of.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_score", "low"))).alias("w"))
        both = ends.select("vec_id", F.col("w.low").alias("low"), F.transform("w.positive_score", lambda v: v.cast("double")).alias("high"))
        return anchors.join(both, "vec_id")

    def within(answers: DataFrame, of: DataFrame) -> DataFrame:
        fits = answers.join(of, "anchor_id").where("score >= low and score <= positive_score")
        return best(fits, ["anchor_id", "positive_id"], negatives)

    near = settled(within(search(queries(windows), None, positives, False, negatives), windows), "near")
    bound = near.where(F.col("rank") == negatives).select("anchor_id", "positive_id", F.col("score").cast("double").alias("bound"))
    windows = windows.join(bound, ["anchor_id", "positive_id"], "left").withColumn("low", F.greatest("low", "bound")).drop("bound")
    windows = settled(windows, "windows")
    release(near, found)
    return within(search(queries(windows), ranges, positives, False, negatives), windows).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
