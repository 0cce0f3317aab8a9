import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.functions import ordinal, times
from assayer.operators import metrics
from assayer.operators.posterior import evidence_histogram, prior_table, resolutions, resolve
from assayer.sources import readers, sinks

T0 = datetime(2024, 1, 1)


def test_spans(spark):
    def at(ms):
        return T0 + timedelta(milliseconds=ms)

    rows = [
        ("a", "engine.run.start", at(0)), ("a", "engine.run.end", at(1234.567)),
        ("a", "other.start", at(5)),  # still open
        ("b", "engine.run.end", at(9)),  # start lost
        ("c", "x.start", at(1)), ("c", "x.end", at(3)), ("c", "x.start", at(7)), ("c", "x.end", at(8)),
        ("d", "job.done", at(1)),
    ]
    found = metrics.span_durations(spark.createDataFrame(rows, "trace_id string, event string, ts timestamp"))
    got = {(r.trace_id, r["name"]): (r.duration_ms, r.n_starts, r.n_ends) for r in found.collect()}
    assert got == {("a", "engine.run"): (1234.57, 1, 1), ("c", "x"): (7.0, 2, 2)}


def test_log_times_are_utc_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = spark.range(1).select(
                times.epoch_log_text(F.lit(1_700_000_000.9)).alias("text"),
                F.unix_seconds(times.from_log_text(F.lit("2023-11-14T22:13:20"))).alias("back"),
                times.from_log_text(F.lit("14/11/2023")).alias("bad"),
                F.unix_micros(times.utc_instant(F.lit("2023-11-14 22:13:20.25").cast("timestamp_ntz"))).alias("us"),
            ).first()
            assert (r.text, r.back, r.bad) == ("2023-11-14T22:13:20", 1_700_000_000, None)
            assert r.us == 1_700_000_000_250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_conflict_events_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("t1", "query", 3, 4, 0, T0), ("t2", "fine", 0, 0, 0, T0)],
        "trace_id string, task_text string, task int, data int, tool int, ts timestamp",
    )
    found = resolve(rows, resolutions(prior_table(spark)))
    sinks.write_conflict_events(found, str(tmp_path / "log"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    event = json.loads(line)
    assert event["event"] == "bayes.conflict_resolved" and event["trace_id"] == "t1"
    assert event["evidence"] == {"TaskStatus": 3, "DataQuality": 4, "ToolReliability": 0}
    assert event["confidence"] == pytest.approx(0.312327, abs=1e-6)
    assert sum(event["distribution"].values()) == pytest.approx(1.0)
    events, bad = readers.read_log(spark, str(tmp_path / "log"))
    r = events.first()
    assert r.event == "bayes.conflict_resolved" and "resolved_state" in r.fields and bad.count() == 0
    sinks.write_resolutions(found, str(tmp_path / "out"), ["trace_id"])
    back = {r.trace_id: r.summary for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back["t2"].state == "CERTAIN" and len(back["t2"].distribution) == 5


def test_malformed_log_lines_are_kept_apart(spark):
    lines = ['{"ts": "2024-01-01T00:00:00", "event": "e", "n": {"a": 1}}', "not json", '{"level": "INFO"}']
    events, bad = readers.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = events.first()
    assert r.ts == T0 and r.fields == {"n": '{"a":1}'} and bad.count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_tables_in_every_format(spark, tmp_path, fmt):
    spark.createDataFrame([(1, "t", "r")], readers.TABLES["tool_observations"]).write.format(fmt).save(str(tmp_path / fmt))
    df = readers.read_table(spark, "tool_observations", str(tmp_path / fmt), fmt)
    assert df.schema == readers.TABLES["tool_observations"] and df.first().result == "r"


def test_ordinal_helpers(spark):
    df = spark.createDataFrame([(-3,), (0,), (2,), (4,), (9,), (None,)], "v int")
    v = F.col("v")
    rows = df.select(
        ordinal.clip_level(v).alias("clip"), ordinal.state_name(v).alias("name"),
        ordinal.state_level(ordinal.state_name(v)).alias("back"), ordinal.is_level(v).alias("ok"),
    ).collect()
    assert [r.clip for r in rows] == [0, 0, 2, 4, 4, None]
    assert [r.name for r in rows] == [None, "CERTAIN", "MEDIUM", "AMBIGUOUS", None, None]
    assert [r.back for r in rows] == [None, 0, 2, 4, None, None]
    assert [r.ok for r in rows] == [False, True, True, True, False, False]


def test_histogram_has_every_context(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (None, 0, 0)], "task int, data int, tool int")
    rows = evidence_histogram(df).collect()
    assert len(rows) == 125 and sum(r.n for r in rows) == 2 and {r.n for r in rows if r.ctx == 1} == {2}
