import json
import random
import time

import pytest
from pyspark.sql import functions as F

from assayer.functions.json_text import braced_candidates, first_decodable, native_object
from assayer.operators import json_objects as K

KNOWN = {
    '{"ports": ["oslo", "riga"]}': {"ports": ["oslo", "riga"]},
    'Tide table:\n```json\n{"kind": "ebb", "metres": 2.5}\n```': {"kind": "ebb", "metres": 2.5},
    'Cargo first.\n{"crates": [7]}\nEnd of list.': {"crates": [7]},
    '{"hull": {"ribs": 40}, "masts": [2, 9]}': {"hull": {"ribs": 40}, "masts": [2, 9]},
    '{"label": "a {red} buoy"}': {"label": "a {red} buoy"},
    '{"depth": 12} fathoms, or {"depth": 13}': {"depth": 12},
    "calm sea, nothing to note": None,
    "": None,
    "{wind: north}": None,
    '{torn page} but {"legible": false}': {"legible": False},
    '{bad {"ok":1}}': {"ok": 1},
    '{"first": 1} ```JSON\n{"fenced": 2}\n``` {"last": 3}': {"fenced": 2},
    '``` nothing ``` {"after": 1}': {"after": 1},
    '```json {oops} ``` and ```{"second": 1}```': {"second": 1},
    '{"a": 1, "a": 2}': {"a": 2},
    '{"open": "never closed {"x": 1}': {"x": 1},
    '[1, {"in": "list"}]': {"in": "list"},
    '{"tab": "a\tb"} {"good": 1}': {"good": 1},
    '{"q": "\\"{"} {"z": 1}': {"q": '"{'},
    "{}": {},
    '{"é": "日本"}': {"é": "日本"},
}


def balanced_first(text):
    """A slow, separate reading of the rule: all substrings from a brace to a brace."""
    for start in (i for i, c in enumerate(text) if c == "{"):
        for end in (j for j in range(start, len(text)) if text[j] == "}"):
            try:
                found = json.loads(text[start : end + 1])
            except ValueError:
                continue
            return found
    return None


def recovered(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = K.recover_json(df).orderBy("id").collect()
    return [None if r.obj is None else json.loads(r.obj) for r in rows]


def test_known_answers(spark):
    assert recovered(spark, KNOWN) == list(KNOWN.values())
    assert recovered(spark, [None]) == [None]


def test_constants_json_does_not_have(spark):
    df = spark.createDataFrame([('x {"a": NaN} {"b": 1}',)], "text string")
    assert K.recover_json(df).first().obj == '{"a":NaN}'


def test_random_texts_against_all_substrings(spark):
    rng = random.Random(5)
    parts = ["{", "}", '{"a": 1}', '{"b": {"c": "}"}}', '"', "text ", '{"d": [1, 2', "]}", "\\", "\n", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for text, got in zip(texts, recovered(spark, texts)):
        assert got == balanced_first(text), text


def test_most_texts_never_reach_python(spark):
    native = [t for t, v in KNOWN.items() if v is not None]
    df = spark.createDataFrame([(t,) for t in native], "text string")
    left = df.where(native_object(braced_candidates(F.col("text"))).isNull()).count()
    assert left == 6  # only those whose first brace opens nothing valid


def test_plan_rows_and_unparseable(spark):
    texts = ['{"steps": ["a", 3, null, "b"]}', '{"steps": "a"}', '{"x": 1}', "z" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = K.recover_json(df)
    rows = [(r.id, r.pos, r.step) for r in K.plan_rows(out).orderBy("id", "pos").collect()]
    assert rows == [(0, 0, "a"), (0, 1, "b")]
    bad = K.unparseable(out).collect()
    assert [(r.id, len(r.excerpt)) for r in bad] == [(3, 200)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"action": "response", "response": "hi"}', ("response", "hi", None)),
        ('{"response": "hi"}', ("response", "hi", None)),
        ('{"action": "response", "response": ""}', ("response", None, None)),
        ('{"action": "response"}', ("response", None, None)),
        ('{"action": "response", "response": {"k": 1}}', ("response", '{"k":1}', None)),
        ('{"action": "plan", "steps": ["a"]}', ("plan", None, ["a"])),
        ('{"action": null, "steps": ["a"]}', ("plan", None, ["a"])),
        ('{"action": "other"}', ("plan", None, [])),
        ("none", ("unparseable", None, None)),
    ],
)
def test_decisions(spark, text, want):
    df = spark.createDataFrame([(1, text)], "run_id int, text string")
    r = K.decisions(K.recover_json(df)).first()
    assert (r.action, r.response, r.steps) == want


def test_too_deep_or_never_closed_texts_give_nothing_fast():
    began = time.perf_counter()
    assert first_decodable('{"a":' * 200_000) is None
    assert first_decodable('{"a":' * 20_000 + "1" + "}" * 20_000) is None
    assert first_decodable('{"a": ' * 900 + "oops") is None
    assert first_decodable('{"a": {"b": 1}, oops {"c": 2}') == {"b": 1}
    assert first_decodable("{x " * 300_000) is None
    assert time.perf_counter() - began < 5


def test_every_object_of_a_text(spark):
    from assayer.functions.json_text import all_objects
    from assayer.operators.json_objects import every_object

    texts = [
        None, "", "no object", "{}", '{"a": 1} and {"b": {"c": 2}}', '{bad} {"a": "}{"} {', '[{"x": 1}, {"y": 2}]',
        'é日\U0001f600 {"k": "é"}', '{"a": {"b": }} {"c": 1}', '{"deep": ' * 3 + "1" + "}" * 3, '{"open": {"in": 1}', "{" * 3000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, n string")
    got = {}
    for r in every_object(df).collect():
        got.setdefault(r.id, []).append((r.place, r.length, r.obj))
    want = {i: list(all_objects(t)) for i, t in enumerate(texts) if t and list(all_objects(t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [o for _, _, o in want[4]] == ['{"a":1}', '{"b":{"c":2}}'] and want[7][0][0] == 4
    assert [o for _, _, o in want[6]] == ['{"x":1}', '{"y":2}'] and [o for _, _, o in want[10]] == ['{"in":1}']
    assert 2 not in want and every_object(df.limit(0)).count() == 0
