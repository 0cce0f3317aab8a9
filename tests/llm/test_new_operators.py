"""Vector codes, repeated text and hard negatives against brute-force twins, with all kinds of odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import distance_tree, repeats, vector_codes
from assayer.llm.run_index import RunIndex, flat

ODD_VECTORS = [None, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8]


def vectors_of(spark, rows):
    """Rows of id, vector and label, with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "y", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, x string, code double")


def plain_codes(vectors, entries, rounds):
    """Every part against every entry each time, in whole numbers."""
    q = [[int(np.floor(1024 * float(np.float32(v)))) for v in row] for row in vectors]
    w = len(q[0]) // 4
    parts = np.array(q, dtype=np.int64).reshape(len(q), 4, w)
    book = parts[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((parts[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(4):
            for e in range(len(book[p])):
                own = parts[code[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(axis=0) // len(own)
    return *assign(), book


@pytest.mark.parametrize("entries, seed", [(5, 1), (16, 2), (256, 3)])
def test_codes_equal_plain_rounds(spark, entries, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(90, 8)) / 8  # many ties and equal rows
    x[60:] = x[:30]
    rows = [(i, list(map(float, v)), int(i % 3) if i % 4 else None) for i, v in enumerate(x)]
    odd = [(1000 + i, v, 1) for i, v in enumerate(ODD_VECTORS)]
    found, book = vector_codes.vector_codes(vectors_of(spark, rows + odd), entries=entries)
    code, error, want = plain_codes(x, entries, 4)
    got = {r.vec_id: r for r in found.collect()}
    assert sorted(got) == list(range(90)) and (book == want).all()
    assert all(list(got[i].code) == code[i].tolist() and got[i].error == error[i] for i in got)
    assert (((vector_codes.decoded(code, book) - np.floor(1024 * x)) ** 2).sum(axis=1) == error).all()


def test_only_moved_entries_are_compared_where_the_own_one_stayed():
    book = vector_codes.Codebook(np.array([[[0], [10], [4]]]), np.array([[False, False, True]]))
    code, far = book.assigned(np.array([[1], [2], [7], [4]]), 0, np.array([0, 0, 1, 2]), np.array([1, 4, 9, 0]), np.float64)
    assert code.tolist() == [0, 0, 1, 2] and far.tolist() == [1, 4, 9, 0]  # ties stay with the lower index


def test_code_digest_of_odd_tables(spark):
    one = vectors_of(spark, [(None, [1.0, 2.0, 3.0], None), (4, [0.5] * 5, None), (4, [0.5] * 5, 2), (5, None, 2)])
    got = vector_codes.code_digest(one).collect()
    assert sorted(str(r.vec_id) for r in got) == ["4", "4", "None"] and len({r.codebooks_sha256 for r in got}) == 1
    assert all(r.label_error == 0 and len(r.code) == 8 for r in got)
    assert vector_codes.code_digest(one.limit(0)).count() == 0
    with pytest.raises(ArithmeticError):
        vector_codes.code_digest(vectors_of(spark, [(1, [1e30] * 4, 1)]))


def test_run_index_reaches_what_brute_force_finds():
    rng = random.Random(5)
    for _ in range(200):
        letters, length = rng.choice((2, 3, 26)), rng.choice((1, 2, 3, 5, 8))

        def word():
            return bytes(rng.randrange(letters) for _ in range(rng.randint(0, 30)))  # noqa: B023

        strings = [word() for _ in range(rng.randint(0, 6))]
        patterns = [word() for _ in range(rng.randint(1, 6))] + [s[: rng.randint(0, len(s))] + word() for s in strings]
        tags, asked = ([rng.randrange(2) for _ in group] for group in (strings, patterns))
        index = RunIndex(*flat(strings), np.array(tags, np.int64))
        got = index.reaches(*flat(patterns), np.array(asked, np.int64), length)
        want = []
        for p, t in zip(patterns, asked, strict=True):
            for i in range(len(p)):
                w = p[i : i + length]
                want.append(len(w) == length and any(w in s for s, u in zip(strings, tags, strict=True) if u == t))
        assert got.tolist() == want


def test_equal_strings_make_few_runs():
    rng = random.Random(6)
    one = bytes(rng.randrange(97, 123) for _ in range(200))
    assert len(RunIndex(*flat([one] * 50), np.zeros(50, np.int64)).starts) <= 2 * 201 + 2


def plain_repeats(docs):
    """Windows as a dictionary of the smallest id; what is covered goes."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    least = {}
    for d, b in texts:
        for i in range(len(b) - 49) if d is not None else ():
            w = b[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49) if d is not None else ():
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answers(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def documents(spark, docs):
    return spark.createDataFrame([(d, t, "x", b"k", 3) for d, t in docs], "doc_id long, text string, grams string, key binary, first int").repartition(5)


def repeating_documents(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 9))) for _ in range(40)]
    phrases = [" ".join(rng.choices(words, k=rng.randint(6, 30))) for _ in range(25)]
    docs = [(1, None), (2, ""), (3, "short"), (4, "x" * 3000), (5, "x" * 49), (6, "x" * 50), (7, "ab" * 1200), (None, "x" * 500), (8, "word " * 8000)]
    for i in range(n):
        text = " ".join(rng.choice(phrases) if rng.random() < 0.4 else " ".join(rng.choices(words, k=8)) for _ in range(rng.randint(0, 9)))
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "!" + text[at + 1 :]
        docs.append((rng.randint(9, 9 + n), text))
    docs += [docs[20], docs[20], (500, docs[30][1]), (0, docs[40][1]), (None, docs[20][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, most", [(1, repeats.MOST_TEXTS), (2, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(repeats, "MOST_TEXTS", most)  # with 2 most grams are settled by window
    monkeypatch.setattr(repeats, "BATCH_BYTES", 4000)
    docs = repeating_documents(seed)
    assert answers(repeats.without_repeats(documents(spark, docs))) == plain_repeats(docs)


def test_kept_bytes_are_returned(spark):
    rng = random.Random(7)
    passage, own = ("".join(rng.choices("abcdefghij ", k=k)) for k in (300, 80))
    got = {r.doc_id: r.kept for r in repeats.without_repeats(documents(spark, [(1, passage), (2, own + passage + own)])).collect()}
    assert bytes(got[2]).decode() == own + own
    assert repeats.without_repeats(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_equal_windows_have_equal_least_grams():
    rng = random.Random(8)
    passage = bytes(rng.randrange(256) for _ in range(90))
    a, b = (bytes(rng.randrange(256) for _ in range(40)) + passage + bytes(30) for _ in range(2))
    assert (repeats.least_grams(a)[40:81] == repeats.least_grams(b)[40:81]).all()
    data = a * 3
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(len(data) - 7)]
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = []
    for i in range(len(data) - 15):
        v = words[i] * mix & mask
        v ^= v >> 29
        v = (v ^ words[i + 8]) * mix & mask
        h.append(v ^ (v >> 32))
    assert repeats.least_grams(data).tolist() == [min(h[i : i + 35]) for i in range(len(data) - 49)]


def plain_negatives(rows, every):
    """All rows against each anchor."""
    out = []
    for a, ax, al in rows:
        if a % every:
            continue
        scored = sorted((-int(np.dot(ax, x)), i, lab) for i, x, lab in rows if i != a)
        for s, p, _ in [r for r in scored if r[2] == al][:5]:
            fits = [(t, i) for t, i, lab in scored if lab != al and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits[:5])]
    return sorted(out)


@pytest.mark.parametrize("seed, block", [(1, 40), (2, 2048)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(distance_tree, "BLOCK", block)
    monkeypatch.setattr(distance_tree, "ANCHORS", 7)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = np.round(centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)) * 0.2, 1).astype(np.float32)
    x[300:420] = x[7]  # ties
    data = [(i, list(map(float, v)), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    odd = [(7000 + 20 * i, v, 1) for i, v in enumerate(ODD_VECTORS)] + [(8000, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    found = distance_tree.hard_negatives(vectors_of(spark, data + odd + data[:50]), every=20)
    whole = [(i, np.floor(256 * np.array(v)), lab) for i, v, lab in data]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(whole, 20)


@pytest.mark.parametrize("scale", [1, 200])
def test_negatives_in_small_pieces(spark, monkeypatch, scale):
    """A leaf over several shelves, many questions a shelf, sparse and dense scores, single and double precision."""
    for name, value in {"BLOCK": 16, "ANCHORS": 3, "SHELF_BYTES": 1200, "SENT_BYTES": 100, "BLOCK_BYTES": 300, "FEW": 4}.items():
        monkeypatch.setattr(distance_tree, name, value)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 6)), 1).astype(np.float32)
    x[100:220] = x[7]
    x[220:300:4] = 0
    x *= scale
    labels = rng.integers(0, 3, 400)
    rows = [(i, list(map(float, v)), int(k)) for i, v, k in zip(range(400), x, labels, strict=True)]
    found = distance_tree.hard_negatives(vectors_of(spark, rows), every=10)
    whole = [(i, np.floor(256 * x[i].astype(float)), int(labels[i])) for i in range(400)]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(whole, 10)


def test_an_anchor_is_sent_once_to_a_shelf(spark):
    """And not once to each leaf: a group of anchors times all leaves did not fit an executor's memory."""
    x = np.random.default_rng(5).normal(size=(600, 6)).round(1)  # nothing can be eliminated
    tree, form = distance_tree.Tree(np.floor(256 * x), 60), distance_tree.Form(6, 256 * abs(x).max())
    rows = spark.createDataFrame([(i, i % 3, [float(np.floor(256 * v)) for v in x[i]]) for i in range(600)], "vec_id long, label long, x array<double>")
    at_leaf = distance_tree.placed(rows, tree, form)
    counts = np.bincount([r.leaf for r in at_leaf.select("leaf").collect()], minlength=tree.leaves)
    shelves = distance_tree.Shelves(counts, 2048, 150)
    leaves = distance_tree.blocks(at_leaf, shelves)
    ranges = distance_tree.measured(leaves, tree, form)
    ends = [F.array(F.lit(v)).alias(c) for c, v in (("low", float("-inf")), ("high", float("inf")))]
    questions = distance_tree.asked(at_leaf.where("vec_id % 10 = 0").select("*", *ends), tree, ranges, shelves, form, 1)
    sent = questions.agg(F.sum(F.length("ids") / 8), F.sum(F.length("data"))).first()
    assert shelves.n < 8 and tree.leaves >= 60
    assert tuple(sent) == (60 * shelves.n, 60 * shelves.n * form.row_bytes)
    pieces = list(distance_tree.in_pieces(((k, bytes(30)) for k in range(10)), 100))
    assert [len(p) for p in pieces] == [4, 4, 2]


def test_negatives_of_small_tables(spark):
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [-1.0, 0.0], 2), (100, [1.0], 3)]
    got = [tuple(r) for r in distance_tree.hard_negatives(vectors_of(spark, few)).collect()]
    assert got == [(0, 1, 1, 100, 65536, 65536), (0, 1, 2, 2, 65536, 58880)] or sorted(got) == [(0, 1, 1, 100, 65536, 65536), (0, 1, 2, 2, 65536, 58880)]
    assert distance_tree.hard_negatives(vectors_of(spark, few).limit(0)).count() == 0


def test_subtrees_are_eliminated_and_no_row_is_lost():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(rng.normal(size=(30, 4)) * 3, 60, axis=0) + rng.normal(size=(1800, 4)) * 0.1))
    tree = distance_tree.Tree(x, 40)
    ranges = distance_tree.Ranges(tree)
    leaf, met = tree.routed(x)
    length = np.sqrt((x * x).sum(axis=1))
    for node, (members, far, side) in met.items():
        for j in np.unique(side):
            mine = side == j
            ranges.low[node][:, j], ranges.high[node][:, j] = far[mine].min(axis=0), far[mine].max(axis=0)
            ranges.norms[node][:, j] = length[members[mine]].min(), length[members[mine]].max()
    anchors = x[::50]
    high = (anchors * anchors).sum(axis=1)
    low = 0.95 * high
    asked = {(leaf_, a) for leaf_, who in ranges.surviving(anchors, low, high) for a in who.tolist()}
    score = anchors @ x.T
    needed = {(int(leaf[r]), int(a)) for a, r in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])), strict=True)}
    assert needed <= asked and len(asked) < 0.5 * tree.leaves * len(anchors)


def test_queries_equal_their_sql(spark):
    from assayer.llm import sql
    from assayer.llm.queries import QUERIES
    from tests.oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    assert compare(QUERIES["op11_vector_codes"](spark, folder), con, sql.vector_codes()) is None
    assert compare(QUERIES["op13_hard_negatives"](spark, folder), con, sql.HARD_NEGATIVES) is None


def test_whole_table_of_repeats(spark):
    from assayer.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert answers(repeats.without_repeats(docs.withColumn("n", F.lit(1)))) == plain_repeats(pairs)
