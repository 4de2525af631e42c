"""Counters by combined clamps against a plain loop, with a key that holds most rows; numbering of such keys."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import operations
from folioframe.operators.numbering import numbered


@pytest.mark.parametrize("block", [3, 64])
def test_counters_before(spark, block):
    r = random.Random(block)
    far = operations.FAR
    steps = [(k, i, *r.choice([(-far, 3, 1), (0, far, -1), (-far, far, 0)])) for k, n in ((1, 700), (2, 5), (3, 1)) for i in range(n)]
    want, x = {}, 0
    for k, i, lo, hi, d in steps:
        x = x if i else 0
        want[k, i] = x
        x = min(hi, max(lo, x + d))
    frame = spark.createDataFrame(steps, "k int, number long, lo long, hi long, d long").repartition(5)
    assert {(q.k, q.number): q.before for q in operations.counters_before(frame, ["k"], block).collect()} == want
    assert operations.counters_before(frame.limit(0), ["k"], block).count() == 0


def test_refunds_of_a_user_with_most_rows(spark):
    r = random.Random(4)
    log = [(1 if r.random() < 0.8 else r.randrange(9), t, r.choice(["charge", "charge", "refund"]), f"2024010{r.randrange(2)}", f"j{r.randrange(200)}") for t in range(900)]
    used, refunded, want = {}, set(), {}
    for user, t, op, key, job in log:
        n = used.get((user, key), 0)
        ok = n < 4 if op == "charge" else (user, job) not in refunded
        if op == "refund":
            refunded.add((user, job))
        used[user, key] = n + ok if op == "charge" else max(0, n - ok)
        want[t] = (ok, used[user, key])
    frame = spark.createDataFrame(log, "user_id int, ts int, op string, quota_key string, job_id string").repartition(6)
    out = operations.refunded_quota(frame, 4)
    assert out.columns == [*frame.columns, "accepted", "used"] and {q.ts: (q.accepted, q.used) for q in out.collect()} == want


def test_numbers_of_a_large_key(spark):
    frame = spark.range(2000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("k"), (F.col("id") * 7 % 2000).alias("v"))
    got = {}
    for q in numbered(frame, ["k"], ["v"], "n").collect():
        got.setdefault(q.k, []).append((q.v, q.n))
    assert all([n for _, n in sorted(x)] == list(range(len(x))) for x in got.values())
