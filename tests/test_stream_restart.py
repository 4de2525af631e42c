"""Streams that stop, fail and go on, and state that ends."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import operations
from folioframe.streaming import jobs

SCHEMA = "user_id long, event_id long, ts timestamp"


def part(spark, folder, n, at, seconds=3600, users=5):
    r = random.Random(n)
    rows = sorted((at + r.randrange(seconds), r.randrange(users)) for _ in range(60))
    frame = spark.createDataFrame([(u, n * 1000 + i, s) for i, (s, u) in enumerate(rows)], "user_id long, event_id long, s long")
    frame.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def answers(frame):
    return sorted((r.event_id, r.in_window, r.allowed) for r in frame.collect())


def test_goes_on_after_a_stop_and_a_failure(spark, tmp_path, monkeypatch):
    folder, base = tmp_path / "in", str(tmp_path / "run")
    part(spark, folder, 1, 0)
    jobs.drained(jobs.watch_rate(stream(spark, folder), 600, 2), base=base)
    part(spark, folder, 2, 3600)  # arrives after the stop, and its batch fails once it is written
    written = []

    class Failing:
        def __init__(self, writer):
            self.writer = writer

        def mode(self, m):
            self.writer = self.writer.mode(m)
            return self

        def parquet(self, path):
            self.writer.parquet(path)
            written.append(path)
            raise RuntimeError("lost after writing")

    kind = type(spark.range(1))
    usual = kind.write
    monkeypatch.setattr(kind, "write", property(lambda self: Failing(usual.fget(self))))
    with pytest.raises(Exception, match="lost after writing"):
        jobs.drained(jobs.watch_rate(stream(spark, folder), 600, 2), base=base)
    monkeypatch.undo()
    assert len(written) == 1
    part(spark, folder, 3, 7200)
    got = answers(jobs.drained(jobs.watch_rate(stream(spark, folder), 600, 2), base=base))
    assert got == answers(operations.rate_limited(spark.read.schema(SCHEMA).parquet(str(folder)), 600, 2)) and len(got) == 180


@pytest.mark.parametrize("watch", [lambda s: jobs.watch_rate(s, 600, 2, "10 minutes"), lambda s: jobs.watch_quota(s, 3, "10 minutes")])
def test_state_ends(spark, tmp_path, watch):
    folder, base = tmp_path / "in", str(tmp_path / "run")
    part(spark, folder, 1, 0, users=40)
    jobs.drained(watch(stream(spark, folder)), base=base)
    assert jobs.drained.progress["stateOperators"][0]["numRowsTotal"] > 4
    for n, at in ((2, 5 * 86400), (3, 10 * 86400)):
        part(spark, folder, n, at, 60, users=2)
        out = jobs.drained(watch(stream(spark, folder)), base=base)
    assert jobs.drained.progress["stateOperators"][0]["numRowsTotal"] <= 4
    events = spark.read.schema(SCHEMA).parquet(str(folder))
    if "in_window" in out.columns:
        assert answers(out) == answers(operations.rate_limited(events, 600, 2))
    else:
        assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in operations.daily_quota(events, 3).where("admitted").collect())
