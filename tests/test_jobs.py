import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer.catalog import fixtures as fx
from assayer.operators import jobs
from assayer.schema import JOB_CHANGE

DAY = 86_400
T0 = datetime(2024, 3, 1)


def frame(spark, rows):
    data = [(j, s, op, c, T0 + timedelta(seconds=at)) for j, s, op, c, at in rows]
    return spark.createDataFrame(data, JOB_CHANGE).repartition(3)


def replay(rows, ttl=None):
    """A store, one change at a time: every job row that ever ended or is left."""
    store, ended, orphans = {}, [], []
    for job, seq, op, changes, at in sorted(rows, key=lambda r: (r[0], r[1])):
        now = store.get(job)
        if now and ttl and at - now["updated"] >= ttl:
            ended.append((job, store.pop(job)))
            now = None
        if op == "create":
            store[job] = {"status": "queued", "prompt": "", "result": None, "error": None, **changes,
                          "created": at, "updated": at}
        elif now is None:
            orphans.append((job, seq))
        else:
            now.update(changes)
            now["updated"] = at
    return store, ended, orphans


def as_dict(r):
    def seconds(t):
        return (t - T0).total_seconds()

    return {"status": r.status, "prompt": r.prompt, "result": r.result, "error": r.error,
            "created": seconds(r.created_at), "updated": seconds(r.updated_at)}


def history(seed, n_jobs=60):
    rng, rows = random.Random(seed), []
    for j in range(n_jobs):
        at = rng.randrange(3 * DAY)
        for seq in range(rng.randint(1, 9)):
            op = "create" if rng.random() < 0.3 else "update"
            fields = rng.sample(["status", "result", "error", "prompt"], rng.randint(0, 3))
            changes = {f: rng.choice([None, f"{f}{seq}"]) for f in fields}
            rows.append((f"j{j}", seq, op, changes, at))
            at += rng.choice([1, 3600, DAY - 1, DAY, DAY + 1, 5 * DAY])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_replay(spark, seed):
    rows = history(seed)
    store, _, orphans = replay(rows)
    changes = frame(spark, rows)
    assert {r.job_id: as_dict(r) for r in jobs.job_state(changes).collect()} == store
    for heavy in (1, 10**9):
        found = jobs.orphan_updates(changes, heavy).collect()
        assert sorted((r.job_id, r.seq) for r in found) == sorted(orphans)


@pytest.mark.parametrize("seed", [3, 4])
def test_lives_equal_replay(spark, seed):
    rows = history(seed)
    store, ended, _ = replay(rows, ttl=DAY)
    lives = jobs.job_lives(frame(spark, rows)).collect()

    def key(pair):
        return (pair[0], pair[1]["created"])

    got = sorted(((r.job_id, as_dict(r)) for r in lives), key=key)
    assert got == sorted([*ended, *store.items()], key=key)


def test_a_job_is_gone_at_exactly_its_ttl(spark):
    rows = [("a", 0, "create", {}, 0)]
    for seconds, alive in ((DAY - 1, 1), (DAY, 0)):
        as_of = F.lit(T0 + timedelta(seconds=seconds)).cast("timestamp")
        assert jobs.live_jobs(frame(spark, rows), as_of).count() == alive


def test_lifecycle(spark):
    rows = [
        ("j1", 0, "create", {"prompt": "hello"}, 0),
        ("j1", 1, "update", {"status": "running"}, 5),
        ("j1", 2, "update", {"status": "done", "result": '{"confidence_score": 0.9}'}, 9),
        ("nope", 0, "update", {"status": "done"}, 0),
    ]
    state = jobs.job_state(frame(spark, rows)).collect()
    assert [(r.job_id, r.status, r.prompt) for r in state] == [("j1", "done", "hello")]
    assert state[0].updated_at >= state[0].created_at
    out = jobs.job_outcomes(jobs.job_state(frame(spark, rows))).first()
    assert (out.status, out.n, out.mean_confidence) == ("done", 1, 0.9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_what_is_used_of_a_change_is_made(spark):
    changes = fx.job_changes(spark, "/root/testdata/sf0.001")
    assert "lambda" not in plan_of(changes)  # compiled, not evaluated value by value
    times = plan_of(changes.agg(F.max("at")))
    assert "map(" not in times and "concat(" not in times


def test_merged_slots_are_dealt_once(spark):
    slots = jobs.slot_parts(frame(spark, history(5))).localCheckpoint()
    ended = jobs.split_ended(slots, F.lit(0))[1]
    for df in (jobs.lives_of_slots(jobs.merged_slots(slots)), ended):
        assert plan_of(df).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("days", [0, 2, 5, 40])
def test_parts_of_several_batches_are_split_by_life(spark, days):
    """Several parts per job and slot, a job without id, lives of many slots and changes past the time."""
    long_life = [("long", i, "create" if i == 0 else "update", {"status": f"s{i}"}, i * (DAY - 1)) for i in range(6)]
    no_id = [(None, 0, "create", {}, 5 * DAY), (None, 1, "update", {"status": "x"}, 5 * DAY + 9)]
    changes = [frame(spark, part) for part in (history(6)[::2], history(6)[1::2], long_life, no_id)]
    every = changes[0].unionByName(changes[1]).unionByName(changes[2]).unionByName(changes[3])
    parts = jobs.slot_parts(changes[0])
    for batch in changes[1:]:
        parts = parts.unionByName(jobs.slot_parts(batch))
    lives = jobs.with_lives(jobs.slot_parts(every)).collect()
    as_of = int((T0 + timedelta(days=days) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    last = {}
    for r in lives:
        last[r.job_id, r.life] = max(r.to_us, last.get((r.job_id, r.life), r.to_us))
    over = {key for key, us in last.items() if us + DAY * 1_000_000 <= as_of}
    living, ended = jobs.split_ended(parts, F.lit(as_of))
    assert living.columns == parts.columns
    assert sorted(map(str, living.collect())) == sorted(
        str(r) for r in jobs.slot_parts(every).collect()
        if any(x.slot == r.slot and x.job_id == r.job_id and (x.job_id, x.life) not in over for x in lives)
    )
    want = jobs.lives_of_slots(jobs.slot_parts(every)).collect()
    assert sorted(map(str, ended.collect())) == sorted(
        str(r) for r in jobs.lives_of_slots(jobs.slot_parts(every)).drop("life", "expires_at").collect()
        if any(w.job_id == r.job_id and w.created_at == r.created_at and (w.job_id, w.life) in over for w in want)
    )
