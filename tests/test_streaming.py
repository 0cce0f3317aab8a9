from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.catalog import stream_queries
from assayer.functions.ordinal import is_level
from assayer.operators import jobs, metrics, posterior
from assayer.schema import JOB_CHANGE, OBSERVATION
from assayer.sources.readers import stream_table
from assayer.streaming import jobs as streams
from assayer.streaming.parts import SPANS, absorb, compact, ended_rows, job_fold
from assayer.streaming.parts import parts as parts_of
from assayer.streaming.sinks import append_to_table, snapshot_to_table, valid_and_quarantined
from tests.test_jobs import as_dict, frame, history, replay

T0 = datetime(2024, 3, 1)


def arriving(spark, tmp_path, df, kind, files=3):
    """A stream that reads the rows in several micro-batches."""
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return stream_table(spark, kind, str(tmp_path / "in"), maxFilesPerTrigger="1")


def test_online_counts_equal_batch(spark, tmp_path):
    df = spark.range(500).select(
        *[(F.col("id") % n).cast("int").alias(c) for c, n in (("task", 5), ("data", 4), ("tool", 3), ("outcome", 5))],
        (F.col("id") % 7).alias("count"),
    )
    assert df.where(~is_level(F.col("task"))).count() == 0
    got = snapshot_to_table(streams.running_counts(arriving(spark, tmp_path, df, OBSERVATION)), "t")
    want = posterior.conjugate_counts(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_job_state_equals_replay(spark, tmp_path):
    """Rows arrive in any order, days apart, and none is too late."""
    rows = history(11)
    stream = arriving(spark, tmp_path, frame(spark, rows), JOB_CHANGE)
    state = jobs.state_of_slots(absorb(stream, str(tmp_path / "state"), job_fold()))
    assert {r.job_id: as_dict(r) for r in state.collect()} == replay(rows)[0]


JOB_COLUMNS = ["job_id", "status", "prompt", "result", "error", "created_at", "updated_at"]


def test_ended_lives_leave_the_state_and_begin_anew(spark, tmp_path):
    hour = 3600
    rows = [
        ("a", 0, "create", {"prompt": "p"}, 0),
        ("a", 1, "update", {"status": "done"}, hour),
        ("b", 0, "create", {"prompt": "q"}, 30 * hour),
        ("a", 2, "update", {"status": "lost"}, 60 * hour),  # too late for the first life, and no job since
        ("a", 3, "create", {"prompt": "again"}, 61 * hour),
        ("b", 1, "update", {"status": "running"}, 62 * hour),
    ]
    source, folder, fold = str(tmp_path / "in"), str(tmp_path / "state"), job_fold()
    sizes = []
    for part, upto in ((rows[:2], hour), (rows[2:3], 30 * hour), (rows[3:], None)):
        frame(spark, part).write.mode("append").parquet(source)
        parts = absorb(stream_table(spark, JOB_CHANGE, source), folder, fold)
        if upto is not None:
            as_of = F.lit(frame(spark, part).agg(F.unix_micros(F.max("at"))).first()[0])
            compact(spark, folder, fold, JOB_CHANGE, lambda slots, t=as_of: jobs.split_ended(slots, t))
            left = parts_of(spark, folder, fold, JOB_CHANGE)
            sizes.append(sorted(r.job_id for r in left.collect()))
    assert sizes == [["a"], ["b"]]  # what has ended is gone
    living = jobs.lives_of_slots(fold.merge(parts)).select(JOB_COLUMNS)
    got = living.unionByName(ended_rows(spark, folder, living.schema))
    want = jobs.job_lives(frame(spark, rows)).select(JOB_COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 3


def test_a_repeated_batch_and_compaction_change_nothing(spark, tmp_path):
    rows = history(13)
    changes = frame(spark, rows)
    folder, fold = str(tmp_path / "state"), job_fold()
    stream = arriving(spark, tmp_path, changes, JOB_CHANGE)
    before = absorb(stream, folder, fold)
    want = sorted(map(str, jobs.state_of_slots(before).collect()))
    absorb(stream, folder, fold)  # nothing new
    compact(spark, folder, fold, JOB_CHANGE)
    compact(spark, folder, fold, JOB_CHANGE)
    after = parts_of(spark, folder, fold, JOB_CHANGE)
    assert sorted(map(str, jobs.state_of_slots(after).collect())) == want


def test_no_rows_at_all(spark, tmp_path):
    empty = frame(spark, history(3)).limit(0)
    empty.write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, JOB_CHANGE, str(tmp_path / "in"))
    assert jobs.state_of_slots(absorb(stream, str(tmp_path / "state"), job_fold())).count() == 0
    compact(spark, str(tmp_path / "none"), job_fold(), JOB_CHANGE)
    assert snapshot_to_table(streams.running_counts(stream_table(spark, OBSERVATION, str(tmp_path / "in"))), "t").count() == 0


def test_expired_lives_equal_batch(spark, tmp_path):
    rows = history(12)
    late = ("zz", 0, "create", {}, 90 * 86_400)  # pushes the watermark past everything else
    changes = frame(spark, [*rows, late]).orderBy("at").coalesce(1)
    changes.write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, JOB_CHANGE, str(tmp_path / "in"))
    got = append_to_table(streams.expired_lives(stream), "t")
    want = jobs.job_lives(changes).where("job_id <> 'zz'")
    columns = ["job_id", "status", "prompt", "result", "error", "created_at", "updated_at"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_paired_open_and_unpaired_spans_equal_batch(spark, tmp_path):
    def at(minutes):
        return T0 + timedelta(minutes=minutes)

    rows = [
        ("a", "x.start", at(0)), ("a", "x.end", at(59)), ("a", "x.start", at(100)), ("a", "x.end", at(130)),
        ("b", "x.start", at(0)),
        ("c", "y.end", at(1)),
        ("d", "x.start", at(0)), ("d", "x.end", at(60 * 24 * 40)), ("d", "note", at(3)),
    ]
    events = spark.createDataFrame(rows, "trace_id string, event string, ts timestamp")
    folder = str(tmp_path / "spans")
    parts = absorb(arriving(spark, tmp_path, events, events.schema), folder, SPANS)
    compact(spark, folder, SPANS, events.schema)
    states = metrics.span_states(SPANS.merge(parts_of(spark, folder, SPANS, events.schema)))
    got = sorted((r.trace_id, r.state, r.duration_ms, r.n_starts, r.n_ends) for r in states.collect())
    assert got == [
        ("a", "paired", 130 * 60_000.0, 2, 2), ("b", "open", None, 1, 0), ("c", "unpaired", None, 0, 1),
        ("d", "paired", 60 * 24 * 40 * 60_000.0, 1, 1),
    ]
    assert SPANS.merge(parts).agg(F.sum("n_starts") + F.sum("n_ends")).scalar() is not None
    batch = metrics.span_states(metrics.span_parts(events))
    assert sorted(map(str, states.collect())) == sorted(map(str, batch.collect()))


def test_bad_rows_are_quarantined_and_the_stream_goes_on(spark, tmp_path):
    rows = [(0, 1, 2, 3, 2), (9, 1, 2, 3, 1), (0, None, 2, 3, 1), (0, 1, 2, -1, 1), (0, 1, 2, 3, 5)]
    df = spark.createDataFrame(rows, OBSERVATION)
    stream = arriving(spark, tmp_path, df, OBSERVATION, files=5)
    for _ in range(2):  # the second run finds nothing new
        counts, bad = valid_and_quarantined(stream, "t", posterior.split_valid, posterior.conjugate_counts, str(tmp_path / "out"))
    assert counts.agg(F.sum("n")).first()[0] == 7
    assert sorted(r.bad_column for r in bad.collect()) == ["data", "outcome", "task"]
    got = snapshot_to_table(streams.running_counts(stream), "t")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 2, 3, 7)]


def test_percentile_of_a_histogram_is_within_one_per_cent(spark):
    values = [0.0, -3.5, 1e-9, 5.0, 1e12, float("inf"), float("-inf"), float("nan"), None] + [1.1**i for i in range(200)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, v double")
    numbers = sorted(v for v in values if v is not None and v == v)
    for fraction in (0.0, 0.1, 0.5, 0.95, 1.0):
        parts = metrics.log_histogram(df, "v", ["g"])
        twice = parts.unionByName(parts)  # counts of parts add up
        for table, times in ((parts, 1), (twice, 2)):
            found = {r.g: (r.n, r.latency_ms) for r in metrics.histogram_quantile(table, ["g"], fraction).collect()}
            want = numbers[max(0, -(-int(round(fraction * 1000)) * len(numbers) // 1000) - 1)]
            assert found["a"][0] == times * len(numbers) and found["a"][1] == pytest.approx(want, rel=0.01)
            assert found["b"][1] == pytest.approx(7.0, rel=0.01)


def test_a_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    table = posterior.resolutions(posterior.prior_table(spark))
    fields = "id long, task int, data int, tool int"

    def run():
        rows = stream_table(spark, spark.createDataFrame([], fields).schema, source)
        scored = streams.score_evidence(rows, table).select("id", "state")
        query = scored.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", progress
        ).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    for i in range(2):
        spark.createDataFrame([(i, 0, None, 0)], fields).write.mode("append").parquet(source)
        run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1]


def test_spans_of_any_length_equal_batch(spark, tmp_path):
    def at(minutes):
        return T0 + timedelta(minutes=minutes)

    rows = [
        ("a", "x.start", at(0)), ("a", "x.end", at(59)),
        ("b", "x.start", at(0)), ("b", "x.end", at(61)),
        ("c", "x.start", at(0)), ("c", "y.end", at(1)),
        ("d", "x.start", at(0)), ("d", "x.end", at(60 * 24 * 40)),
    ]
    events = spark.createDataFrame(rows, "trace_id string, event string, ts timestamp")
    stream = arriving(spark, tmp_path, events, events.schema)
    found, _, _ = metrics.split_spans(SPANS.merge(absorb(stream, str(tmp_path / "spans"), SPANS)))
    assert sorted((r.trace_id, r["name"], r.duration_ms) for r in found.collect()) == [
        (k, "x", minutes * 60_000.0) for k, minutes in (("a", 59), ("b", 61), ("d", 60 * 24 * 40))
    ]
    assert sorted(map(str, found.collect())) == sorted(map(str, metrics.span_durations(events).collect()))


def test_long_spans_and_the_open_window_are_reported(spark, tmp_path):
    day = 24 * 60
    rows = [(i, T0 + timedelta(minutes=m), "click", v) for i, (m, v) in enumerate([(0, 5.0), (day, 4_000_000.0), (3 * day, 7.0), (3 * day + 30, 9.0)])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    shape = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    known = set(events.columns)
    full = events.select(*(F.col(f.name).cast(f.dataType) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in shape))
    pq.write_table(full.toArrow(), str(tmp_path / "events.parquet"))
    spans = stream_queries.stream_spans(spark, str(tmp_path)).collect()
    assert sorted((r.trace_id, r.duration_ms) for r in spans) == [("0", 5.0), ("1", 4_000_000.0), ("2", 7.0), ("3", 9.0)]
    windows = stream_queries.stream_latency(spark, str(tmp_path)).orderBy("window_s").collect()
    first = 1_709_251_200  # 2024-03-01
    assert [(r.window_s - first, r.n) for r in windows] == [(0, 1), (86_400, 1), (3 * 86_400, 2)]
    assert [r.latency_ms for r in windows] == pytest.approx([5.0, 4_000_000.0, 9.0], rel=0.01)
