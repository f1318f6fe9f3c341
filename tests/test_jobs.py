"""Jobs followed event by event against the batch state: any order, repetition, silence, a run that is killed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from coursemine.sources import tables as tb
from coursemine.streaming import incremental as ic, jobs as jb

SCHEMA = "job_id bigint, event_id bigint, ts timestamp, status string, progress int, result string, error string"
START = dt.datetime(2024, 3, 1)
STATE = ["job_id", "status", "progress", "result", "error_message", "finished_at"]


def events(seed, jobs=12, n=200, minutes=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        status = rng.choice(["pending", "running", "running", "success", "failed", "odd"])
        out.append((
            rng.randrange(jobs), i, START + dt.timedelta(minutes=rng.randrange(minutes)), status, rng.choice([None, -5, 30, 250]),
            rng.choice([None, None, f"r{i}"]), rng.choice([None, f"e{i}" * 900]) if status == "failed" else None,
        ))
    return out


def batch(spark, rows):
    return {tuple(r) for r in ic.job_state(spark.createDataFrame(rows, SCHEMA)).select(*STATE).collect()}


def test_any_order_and_repetition_give_the_batch_state(spark):
    rows = events(1)
    # a failure without a message takes none from an earlier failure
    want = {r[0]: r[1:] for r in batch(spark, rows)}
    rng = random.Random(2)
    for _ in range(5):
        arrived = rows + rng.sample(rows, 60)
        rng.shuffle(arrived)
        states = {}
        for job, number, ts, *rest in arrived:
            micros = round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
            states[job] = jb.fold(states.get(job, jb.EMPTY), [(micros, number, *rest)])
        for job, s in states.items():
            finished = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=s[12]) if s[12] is not None else None
            message = s[11][:2000] if s[2] == "failed" and s[11] is not None else None
            assert (s[2], s[5], s[8], message, finished) == want[job]


def arrive(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_silent_jobs_are_marked_and_come_back(spark, tmp_path):
    arrivals, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    at = lambda m: START + dt.timedelta(minutes=m)
    run = lambda rows: jb.track_jobs_stream(arrive(spark, rows, arrivals), out, check, "60 minutes", "10 minutes").awaitTermination()
    state = lambda: {r["job_id"]: (r["status"], r["progress"], r["stalled"]) for r in tb.newest(spark, out, ["job_id"]).collect()}
    run([(1, 1, at(0), "running", 10, None, None), (2, 2, at(0), "success", None, "r", None), (3, 3, at(100), "running", 5, None, None), (None, 4, at(0), "running", 1, None, None)])
    assert state() == {1: ("running", 10, True), 2: ("success", 100, False), 3: ("running", 5, False)}
    # job 1 goes on; job 3 gets a late event, which is older than what is known, and the same once more
    run([(1, 5, at(110), "running", 40, None, None), (3, 6, at(95), "running", 90, None, None), (3, 3, at(100), "running", 5, None, None)])
    assert state() == {1: ("running", 40, False), 2: ("success", 100, False), 3: ("running", 5, False)}


def test_a_killed_run_recovers(spark, tmp_path, monkeypatch):
    arrivals, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = sorted(events(4), key=lambda r: r[2])
    start = lambda part: jb.track_jobs_stream(arrive(spark, part, arrivals), out, check, "30 days", "1 day")
    start(rows[:80]).awaitTermination()

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(jb, "write_version", lost)
        with pytest.raises(Exception, match="lost"):
            start(rows[80:140]).awaitTermination()
    start(rows[140:] + rows[100:120]).awaitTermination()
    got = tb.newest(spark, out, ["job_id"])
    assert {tuple(r) for r in got.select(*STATE).collect()} == batch(spark, rows)
    assert got.filter(F.col("stalled")).count() == 0
