"""Each operator against a brute-force twin on small tables with all kinds of odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import decontam, language, main_text, minhash, packing, quality, secret_scan, tokens, toxicity, vector_graph
from assayer.llm.components import components

LETTERS = "the of and erin thing onat reed tionan wher sted andor eaes inga bleer hation ounds lyin".split()


def prose(rng, n, words=LETTERS):
    return " ".join(rng.choice(words) + rng.choice(("", "", "s", "ly", ".")) for _ in range(n))


def rows(spark, texts, **more):
    """Documents 0.. with the given texts and a column that clashes with inner names."""
    data = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, n string")


ODD = [None, "", " \t\n ", "one", "a  b <|endoftext|> c\n\nd", "\N{SNOWMAN} été ñ 日本語 " * 3, "word " * 5000, "x" * 3000]


def test_tokens_and_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(60)), "same", "same"]
    docs = rows(spark, texts)
    library = Tokenizer.from_file(tokens.VOCABULARY)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    counts = {r.doc_id: r for r in tokens.token_counts(docs, limit=100).collect()}
    for i, t in enumerate(texts):
        assert (counts[i].n_bytes, counts[i].n_tokens) == (len((t or "").encode()), len(ids[i]))
        assert counts[i].over_limit == (len(ids[i]) > 100)
    found = packing.packed_documents(docs, capacity=256).collect()
    whole = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole.get(r.doc_id, [])) and r.length == len(r.ids) <= 256
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {i: [*x, 0] for i, x in enumerate(ids)}
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    assert packing.packed_documents(docs.limit(0)).count() == 0 and tokens.token_counts(docs.limit(0)).count() == 0


def least_bins(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_plans_hold_every_piece_and_are_nearly_least():
    rng, over = random.Random(2), 0
    for _ in range(150):
        capacity = rng.choice((10, 20, 50))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        histogram = {w: items.count(w) for w in set(items)}
        plan = packing.plan_sequences(histogram, capacity)
        placed = [w for times, kind in plan for _ in range(times) for w in kind]
        assert sorted(placed) == sorted(items) and all(sum(kind) <= capacity for _, kind in plan)
        over += sum(times for times, _ in plan) - least_bins(items, capacity)
    assert over <= 2


def base_spans(text):
    key = "(?i:password|passwd|secret|token|api_?key)"
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(key + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secrets(spark, tmp_path):
    rng = random.Random(3)
    parts = ["token", "=", ": ", "PassWord", "api_key", "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "é", " ", "x", "\n", "secret:abc", "abcdef"]
    texts = [*ODD, "password=token: abcdefgh", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300))]
    docs = rows(spark, [*texts, texts[-1]])
    base = F.filter("spans", lambda s: s["rank"] < 3)
    found = {r.path: r.base for r in secret_scan.findings(docs).select("path", secret_scan.listed(base).alias("base")).collect()}
    assert found == {i: base_spans(t or "") for i, t in enumerate([*texts, texts[-1]])}
    clean = secret_scan.redacted(docs).select(F.col("text").alias("t")).collect()
    assert all(base_spans(r.t or "") == "" or "[REDACTED]" in r.t for r in clean)
    ledger = str(tmp_path / "ledger")
    first = secret_scan.update_ledger(docs, ledger).count()
    assert first == len({hashlib.sha256((t or "").encode()).digest() for t in texts})
    assert secret_scan.update_ledger(docs, ledger).count() == first  # nothing unseen
    assert secret_scan.update_ledger(rows(spark, ["token = abcdef1"]), ledger).count() == first + 1
    assert secret_scan.findings(docs.limit(0)).count() == 0


def similar_groups(sets, percent=80):
    parent = list(range(len(sets)))

    def find(a):
        return a if parent[a] == a else find(parent[a])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(4)
    texts = [*ODD]
    for _ in range(12):
        words = prose(rng, rng.randint(8, 80)).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(LETTERS).upper() + str(rng.randint(0, 9))
            texts.append(" ".join(copy))

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = [shingles(t) for t in texts]
    got = {r.doc_id: r for r in minhash.near_duplicates(rows(spark, texts), size=size).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == similar_groups(sets)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_near_duplicates_of_no_rows(spark):
    assert minhash.near_duplicates(rows(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(300)] + [(7, None), (9, 9)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        return a if parent[a] == a else find(parent[a])

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in parent}


def test_leaks(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(3, 40), [w + v for w in LETTERS for v in ("a", "e", "o", "u")]) for _ in range(15)] + [None, ""]
    texts = [*ODD]
    for _ in range(60):
        words = prose(rng, rng.randint(0, 60)).split()
        item = (rng.choice(items[:15])).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            item[rng.randrange(len(item))] = "other"
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + item + words[at:]))

    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        n = min(5, len(words))
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []

    want = {}
    for d, text in enumerate(texts):
        x = shingles(text)
        for i, item in enumerate(items):
            y = shingles(item)
            for s in range(max(1, len(x) - len(y) + 1)) if y else ():
                window = list(x[s : s + len(y)])
                both = sum(min(window.count(h), y.count(h)) for h in set(window))
                if 10 * both >= 8 * (len(window) + len(y) - both):
                    want[d, i] = max(want.get((d, i), 0), both / (len(window) + len(y) - both))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(rows(spark, texts), bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decontam.leaks(rows(spark, texts), bench.limit(0)).count() == 0
    assert decontam.leaks(rows(spark, texts).limit(0), bench).count() == 0


def wrong_labels(field, page):
    gains = [sum(field.weights.get(f, 0.0) for f in main_text.block_features(b)) for b in page]
    return sum(a != b.label for a, b in zip(field.decode(gains), page, strict=True))


def test_main_text(spark):
    field = main_text.trained()
    wrong = total = 0
    for page in main_text.labelled_pages(150, seed=77):
        wrong += wrong_labels(field, page)
        total += len(page)
    assert wrong < 0.02 * total
    html = (
        "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First\n  part<br>goes on."
        "<p>Second <b>part</b>.</p><script>var x='<p>';</script><div class='ad'>Buy this now.</div></article>"
        "<div class='comments'><p>I liked it very much.</p></div><footer>&copy; all</footer>"
    )
    odd = [html, None, "", "<", "<p", "<!-- " + "x" * 100, "<p>" * 2000, "<div class='post-body'><p>" + "Long text. " * 20000 + "</p></div>"]
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in main_text.main_texts(pages).collect()}
    assert got[0].text == "A & B\n\nFirst part goes on.\n\nSecond part."
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].text == got[2].text == ""
    assert got[7].n_chars == 11 * 20000 - 1
    assert main_text.main_texts(pages.limit(0)).count() == 0


def labelled(spark):
    rng = random.Random(8)
    texts, marks = list(ODD), [None] * len(ODD)
    for i in range(500):
        bad, junk = i % 5 == 0, i % 4 == 1
        words = prose(rng, rng.randint(10, 120)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("vilest", "rotten", "foulish")))
        if junk:
            words = [w + "***" for w in words]
        texts.append(" ".join(words))
        marks.append((0 if junk else 1, 1 if bad else 0))
    docs = rows(spark, texts).withColumn("lang", F.lit("en"))
    known = [(i, *m) for i, m in enumerate(marks) if m] + [(9, None, None), (20, 0, 0)]
    return docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), marks


@pytest.mark.parametrize("make, at", [(quality.quality_scores, 0), (toxicity.toxicity_scores, 1)])
def test_classifiers(spark, make, at):
    docs, labels, marks = labelled(spark)
    got = make(docs, labels).collect()
    assert len(got) == len(marks) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and marks[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == marks[r.doc_id][at] for r in held) >= 0.95 * len(held)
    assert len({r.score for r in make(docs, labels.limit(0)).collect()}) == 1
    assert make(docs.limit(0), labels).count() == 0


def test_languages(spark):
    rng = random.Random(9)
    other = "der und nicht schung keit ein ver auf heit zu lich ung".split()
    texts = [*ODD[:5], *(prose(rng, rng.randint(5, 60), other if i % 2 else LETTERS) for i in range(160))]
    docs = rows(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 5, None).when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3
    held = [r for r in got.values() if r.held_out and r.doc_id >= 5]
    assert held and all(r.lang_pred == ("de" if r.doc_id % 2 == 0 else "en") for r in held)
    model = language.fit([language.words_of(t) for t in texts[5:]], [i % 2 for i in range(160)], ["en", "de"])
    mixed = "the of and thing der und nicht schung keit"
    assert [lab for _, lab in model.label_words(mixed)] == ["en"] * 4 + ["de"] * 5
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(docs.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total, want = 0.0, np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(emission[i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
    got = language.forward_backward(emission, np.array([4]), np.exp(transition))
    assert np.allclose(got, want / total)


def test_vectors(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(150, 16))
    x = [list(map(float, v)) for v in base] + [list(map(float, base[0] * 2))]
    x += [list(map(float, base[i % 5] + rng.normal(size=16) * 0.1)) for i in range(200)] + [list(map(float, base[1]))] * 4
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x + odd)], "vec_id long, embedding array<double>, n int")
    found = vector_graph.linked_vectors(vectors)
    got = {r.vec_id: r for r in found.collect()}
    units = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.95 - 1e-12
    links = near.sum(axis=1) - 1
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(len(x), len(x) + len(odd)))
    groups = [int(np.flatnonzero(np.linalg.matrix_power(near[:, :].astype(int).clip(0, 1), 1)[i]).min()) for i in range(5)]
    assert [got[i].component_id for i in range(5)] == groups
    recall = vector_graph.audit(vectors.where("vec_id < 355"), found, every=7).agg(F.sum("n_links"), F.sum("n_true")).first()
    assert recall[0] >= 0.9 * recall[1] > 0
    assert vector_graph.linked_vectors(vectors.limit(0)).count() == 0


def test_vectors_of_many_groups_over_several_blocks(spark):
    rng = np.random.default_rng(12)
    base = np.repeat(rng.normal(size=(20, 32)), 150, axis=0)
    x = base + rng.normal(size=base.shape) * np.where(np.arange(len(base)) % 2, 0.05, 0.1)[:, None]
    data = [(i, v) for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r for r in vector_graph.linked_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    assert [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == similar_components(near)


def similar_components(near):
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


@pytest.mark.parametrize(
    "inside",
    [
        "<svg class='i'/>", "<svg viewBox='0 0 1 1' />", "<math/>", "<svg-icon name=x></svg-icon>", "<object-view>", "<title-bar>",
        "<select-box></select-box>", "<svg><text>gone</text></svg>", "<select><option>gone</select>", "<script>gone()</script>", "<style>gone{}</style>",
    ],
)
def test_only_hidden_elements_hide_text(inside):
    page = f"<article><p>Text before.</p>{inside}<p>The rest of it.</p></article>"
    assert [b.text for b in main_text.blocks_of(page)] == ["Text before.", "The rest of it."]


def test_formulas_and_fallbacks_stay():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object data='a'><p>Shown instead of it.</p></object><p>The end of it.</p></article>"
    assert main_text.main_text(page, main_text.trained()) == "So x=1 holds.\n\nShown instead of it.\n\nThe end of it."


def test_every_text_of_a_repeated_item_is_sought(spark):
    rng = random.Random(13)
    one, two, rest = (prose(rng, 30, [w + v for w in LETTERS for v in ("a", "e", "o", "u")]) for _ in range(3))
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (2, None), (2, rest)], "item_id long, text string")
    texts = [f"before {one} after", f"{two}", f"{rest} {one}", "nothing of it"]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.leaks(rows(spark, texts), bench).collect()}
    assert got == {(0, 1): (1.0, 1), (1, 1): (1.0, 0), (2, 1): (1.0, got[2, 1][1]), (2, 2): (1.0, 0)}


def test_viterbi_equals_enumeration():
    rng = random.Random(14)
    for _ in range(200):
        gains = [rng.uniform(-3, 3) for _ in range(rng.randint(1, 7))]
        t = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        field = main_text.Field({}, tuple(map(tuple, t)))

        def score(labels):
            return sum(g for g, y in zip(gains, labels) if y) + sum(t[a][b] for a, b in zip(labels, labels[1:]))  # noqa: B023

        best = max(np.ndindex(*[2] * len(gains)), key=score)
        assert field.decode(gains) == list(best)
    assert main_text.Field({}, ((0.0, 0.0), (0.0, 0.0))).decode([]) == []


HOSTILE = {
    "unclosed tags": "<a " * 700_000,
    "unclosed values": '<a "' * 500_000 + ">",
    "one quote": "<p title=\"x>" + "<b>y</b>" * 200_000,
    "deep": "<div>a" * 300_000,
    "deep and marked": "".join(f"<div class='{chr(97 + i % 26) * (1 + i % 40)}'>a" for i in range(60_000)),
    "ends of nothing": "<div>" * 100_000 + "</p>" * 300_000,
    "items": "<li><ul>" + "<div>" * 100_000 + "<li>x</li>" * 150_000,
    "comments": "<!-- " * 400_000,
    "hidden": "<script>" * 250_000,
    "less than": "<" * 2_000_000,
    "declarations": "<!" * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_hostile_page_takes_its_length(name):
    field = main_text.trained()
    weights, page = field.whole(), HOSTILE[name]

    def seconds(part):
        start = time.process_time()
        main_text.main_text(part, field, weights)
        return time.process_time() - start

    half, whole = seconds(page[: len(page) // 2]), seconds(page)
    assert whole < 3 * half + 0.5 and whole < 4 * max(1, len(page) / 2_000_000)


def test_layouts_that_were_not_learnt():
    """Half of the class names teach, pages made of the others are read: elements, links and sentences must do."""
    halves = [({k: v[i::2] for k, v in main_text._LAYOUTS.items()}, main_text._CONTENT[i::2]) for i in (0, 1)]
    field = main_text.fit(main_text.labelled_pages(300, 31, *halves[0]))
    wrong = total = 0
    for page in main_text.labelled_pages(200, 32, *halves[1]):
        wrong += wrong_labels(field, page)
        total += len(page)
    assert wrong < 0.25 * total


def test_gains_are_those_of_the_features():
    field = main_text.trained()
    weights = field.whole()
    page = "<body class=page><div id='menu'><ul><li><a href=x>Home</a><li><i class=hot>New</i></ul></div><article><p>One.<p>Two <b>b</b><div class='ad'>Buy</div></article></body>"
    slow, fast = main_text.blocks_of(page), main_text.blocks_of(page, weights)
    assert [b.text for b in slow] == [b.text for b in fast] == ["Home", "New", "One.", "Two b", "Buy"]
    for a, b in zip(slow, fast, strict=True):
        assert sum(weights.get(f, 0) for f in a.above) == b.gain


def test_rows_of_one_id_and_repeated_rows_leak(spark):
    rng = random.Random(15)
    vocabulary = [w + v for w in LETTERS for v in ("a", "e", "o", "u")]
    item, other = prose(rng, 30, vocabulary), prose(rng, 30, vocabulary)
    bench = spark.createDataFrame([(1, item), (1, item), (2, other)], "item_id long, text string")
    leak, clean = f"before {item} after", prose(rng, 60, vocabulary)
    data = [(1, leak), (1, leak), (2, leak), (2, clean), (3, clean), (3, clean), (4, f"{item} {clean} {item}"), (None, leak)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in data], "doc_id long, text string, n int, h string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): (1.0, 1), (2, 1): (1.0, 1), (4, 1): (1.0, 0)}  # of equal windows the first


def test_a_very_long_item(spark):
    words = [f"w{i}" for i in range(200_000)]
    item = " ".join(words)
    edited = " ".join(w if i % 90 else "x" for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, item), (2, "one")], "item_id long, text string")
    texts = [f"so {item} ends", edited, "one", " ".join(words[:100_000])]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(rows(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 2)} and got[0, 1] == 1.0 and 0.8 < got[1, 1] < 1.0


def test_many_spans_in_one_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(6000)) + " " + "x" * 200
    found = secret_scan.findings(rows(spark, [text, "a" * 30_000 + " password=abcdef"])).select("path", secret_scan.listed(F.col("spans")).alias("s")).collect()
    assert {r.path: r.s for r in found} == {0: base_spans(text), 1: base_spans("a" * 30_000 + " password=abcdef")}


def test_batches_have_about_equal_bytes():
    rng = random.Random(16)
    texts = [*(t or "" for t in ODD), *("é日" * rng.randint(0, 900) + " ab" for _ in range(200)), "word " * 200_000]
    batches = list(tokens.byte_balanced(texts, 5000))
    assert ["".join(p for b in batches for k, p in b if k == i) for i in range(len(texts))] == texts
    assert all(len(b) == 1 or sum(len(p.encode()) for _, p in b) <= 5000 for b in batches)


def test_switches_of_language_are_learnt():
    rng = random.Random(17)
    other = "der und nicht schung keit ein ver auf heit zu lich ung".split()
    texts = [language.words_of(prose(rng, rng.randint(5, 60), other if i % 2 else LETTERS)) for i in range(160)]
    pieces = [(w, [i % 2] * len(w)) for i, w in enumerate(texts)]
    mixed = language.mixed_chains(pieces, 2)
    assert len(mixed) == len(pieces) // language.PURE_FOR_MIXED and all(len(w) == len(y) == language.CHAIN for w, y in mixed)
    assert all(len(set(y)) == 2 for _, y in mixed)
    model = language.fit(texts, [i % 2 for i in range(160)], ["en", "de"])
    wrong = total = 0
    for words, truth in language.mixed_chains(pieces, 2, seed=18):
        found = model.marginals([words])[0].argmax(axis=1)
        wrong += (found != np.array(truth)).sum()
        total += len(words)
    assert wrong < 0.02 * total


def test_discriminant_equals_dense_numpy(spark):
    rng = np.random.default_rng(19)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + rng.normal(size=d) for n in (120, 80)]
    data = [(v, k) for k, part in enumerate(x) for v in part.tolist()] + [([0.0] * d, None), ([0.0] * d, 7)]
    model = quality.fit(spark.createDataFrame(data, "x array<double>, label int").repartition(3))
    scatters = [np.cov(part.T, bias=True) for part in x]
    pooled = (120 * scatters[0] + 80 * scatters[1]) / 200
    asked = rng.normal(size=(50, d))
    density = []
    for k, part in enumerate(x):
        own = (1 - quality.SHRINK_TO_POOLED) * scatters[k] + quality.SHRINK_TO_POOLED * pooled
        own = (1 - quality.SHRINK_TO_SPHERE) * own + quality.SHRINK_TO_SPHERE * np.diag(np.diag(pooled)) + quality.NOISE * np.eye(d)
        far = asked - part.mean(axis=0)
        density.append(np.log((len(part) + 1) / 202) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(own), far))
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose(model.score(asked), want, atol=1e-6)


def test_accepted_rows_are_those_predicted_good(spark):
    docs, labels, _ = labelled(spark)
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    kept = quality.accepted(docs.withColumn("x", F.lit(1)).withColumn("score", F.lit(0.0)), labels)
    assert {r.doc_id for r in kept.collect()} == good and "score" in kept.columns and kept.count() == len(good)


def test_positive_unlabelled_risk_equals_a_plain_gradient():
    """The same descent with dense matrices and numerical derivatives of the risk."""
    rng = np.random.default_rng(20)
    dense = np.zeros((60, 6))
    dense[:20] = rng.random((20, 6)) * [1, 1, 0, 0, 1, 0]
    dense[20:] = rng.random((40, 6)) * [0, 0, 1, 1, 1, 1]
    rows_of = [(np.flatnonzero(v).astype(np.int32), v[v > 0].astype(np.float32)) for v in dense]
    dense = np.array([[dict(zip(at.tolist(), value.tolist())).get(j, 0.0) for j in range(6)] for at, value in rows_of])
    prior, steps, rate, ridge = 0.3, 40, 0.1, 1e-4
    model = toxicity.fit(rows_of[:20], rows_of[20:], prior, steps, rate, ridge)

    def parts(w):
        z = dense @ w[:-1] + w[-1]
        gain, loss = np.logaddexp(0, -z), np.logaddexp(0, z)
        return prior * gain[:20].mean(), loss[20:].mean() - prior * loss[:20].mean()

    def slope(f, w):
        out = np.zeros_like(w)
        for i in range(len(w)):
            e = np.zeros_like(w)
            e[i] = 1e-6
            out[i] = (f(w + e) - f(w - e)) / 2e-6
        return out

    w, moment, square = np.r_[np.zeros(6), np.log(prior / (1 - prior))], np.zeros(7), np.zeros(7)
    for t in range(1, steps + 1):
        if parts(w)[1] >= 0:
            g = slope(lambda v: sum(parts(v)), w)
        else:  # the corrected part is led back above zero
            g = slope(lambda v: -parts(v)[1], w)
        g[:-1] += ridge * w[:-1]
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g**2
        w = w - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    assert np.allclose(np.r_[model.weights[:6], model.bias], w, atol=1e-3)
    assert (model.score(rows_of[:20]) > model.score(rows_of[20:]).max()).mean() > 0.9


def test_recall_of_the_graph_on_dense_groups(spark):
    """24 groups of 520 over many shards, and the recall that :func:`audit` measures on ids divisible by 100."""
    rng = np.random.default_rng(23)
    base = np.repeat(rng.normal(size=(24, 48)), 520, axis=0)
    x = base + rng.normal(size=base.shape) * np.where(np.arange(len(base)) % 3 == 0, 0.2, 0.12)[:, None]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = vector_graph.linked_vectors(vectors)
    n, true = vector_graph.audit(vectors, found).agg(F.sum("n_links"), F.sum("n_true")).first()
    assert n >= 0.999 * true > 10_000
