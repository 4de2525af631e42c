"""Running the service: quotas, limits, alerts, percentiles, breakers and tokens, over event tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import materialize
from .numbering import numbered

#: Seconds and calls of the limits of routes, by user or by address.
ROUTE_LIMITS = {"upload": (900, 60), "forgot-password": (900, 5), "reset-password": (900, 10), "signup": (900, 5)}
#: Outcomes in the alert window, least number of them, and the share that alerts.
OUTCOMES, LEAST_OUTCOMES, ALERT = 50, 5, 0.20
SAMPLES = 500


def _with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def failure_alerts(events: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """Adds failure_rate over the last outcomes of a key, null for few of them, and alert."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - OUTCOMES, 0)
    n = F.count(F.lit(1)).over(w)
    rate = F.when(n >= LEAST_OUTCOMES, F.sum(F.when(failed, F.lit(1)).otherwise(F.lit(0))).over(w) / n)
    return events.withColumn("failure_rate", rate).withColumn("alert", F.coalesce(rate > ALERT, F.lit(False)))


def rank_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50 and p95 as the values at places n // 2 and int(0.95 n) of the sorted ones, from 0, not interpolated.

    The places come from counts and a running number, so no key's values meet in one array.
    """
    n = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = rows.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w) - 1).alias("place")).join(n, keys)
    at = lambda p: F.max(F.when(F.col("place") == p, F.col(value)))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.95)).alias("p95"))


def recent(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The last rows of each key: what a bounded buffer still has."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def daily_quota(calls: DataFrame, limit: int) -> DataFrame:
    """Adds admitted: the first calls of a user on a UTC day; calls beyond the limit don't count."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return calls.withColumn("admitted", F.row_number().over(w) <= limit)


#: A counter stays far below this.
FAR = 1 << 40


def _clamp(s: Column, x: Column) -> Column:
    """A step's effect on a counter: moved by d and held between lo and hi."""
    return F.least(s["hi"], F.greatest(s["lo"], x + s["d"]))


def counters_before(steps: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """keys, number, before: a counter that begins at 0 for each key, ahead of each step (number from 0, lo, hi, d).

    One clamp after another is a clamp again. So blocks of steps are combined to one step
    each, these again to blocks, until a key has one; then the counters go down the same
    way. A key with any number of steps is spread over many tasks, and no array is longer than a block.
    """
    grouped = steps.groupBy(*keys, F.floor(F.col("number") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("number", "lo", "hi", "d"))).alias("s"))
    grouped = materialize(grouped, "clamps")
    if (grouped.agg(F.max("block")).first()[0] or 0) > 0:
        far = F.lit(FAR).cast("long")
        one = F.struct((-far).alias("lo"), far.alias("hi"), F.lit(0).cast("long").alias("d"))
        after = lambda f, g: F.struct(_clamp(g, f["lo"]).alias("lo"), _clamp(g, f["hi"]).alias("hi"), (f["d"] + g["d"]).alias("d"))
        whole = grouped.select(*keys, F.col("block").alias("number"), F.aggregate("s", one, after).alias("c")).select(*keys, "number", "c.*")
        entry = counters_before(whole, keys, block).select(*keys, F.col("number").alias("block"), "before")
        grouped = grouped.join(entry, [*keys, "block"])
    else:
        grouped = grouped.withColumn("before", F.lit(0).cast("long"))
    start = F.struct(F.col("before").alias("x"), F.array().cast("array<long>").alias("out"))
    run = F.aggregate("s", start, lambda a, s: F.struct(_clamp(s, a["x"]).alias("x"), F.concat(a["out"], F.array(a["x"])).alias("out")))
    each = grouped.select(*keys, F.explode(F.arrays_zip(F.transform("s", lambda x: x["number"]).alias("number"), run["out"].alias("before"))).alias("z"))
    return each.select(*keys, F.col("z.number").alias("number"), F.col("z.before").alias("before"))


def refunded_quota(log: DataFrame, limit: int, order: tuple[str, ...] = ("ts", "job_id")) -> DataFrame:
    """Adds accepted and used for charges and refunds (user_id, ts, op, quota_key, job_id).

    A charge counts on its own day's key while that is below the limit. A refund goes to
    the key that its job was charged on, once per job, and never below zero. ``order`` must
    tell all rows of a user apart. A charge is the step x -> min(limit, x + 1), a refund x -> max(0, x - 1).
    """
    keys = ["user_id", "quota_key"]
    once = F.row_number().over(Window.partitionBy("user_id", "job_id", "op").orderBy(*order)) == 1
    rows = numbered(log.withColumn("__first", (F.col("op") == "refund") & once), keys, list(order), "__number")
    far, zero = F.lit(FAR).cast("long"), F.lit(0).cast("long")
    charge, back = F.col("op") == "charge", F.col("__first")
    steps = rows.select(
        *keys, F.col("__number").alias("number"), F.when(back, zero).otherwise(-far).alias("lo"), F.when(charge, F.lit(limit).cast("long")).otherwise(far).alias("hi"), F.when(charge, zero + 1).when(back, zero - 1).otherwise(zero).alias("d")
    )
    out = rows.join(counters_before(steps, keys).withColumnRenamed("number", "__number"), [*keys, "__number"])
    accepted = F.when(charge, F.col("before") < limit).otherwise(back)
    used = F.when(charge, F.least(F.lit(limit), F.col("before") + 1)).when(back, F.greatest(zero, F.col("before") - 1)).otherwise(F.col("before"))
    return out.withColumn("accepted", accepted).withColumn("used", used.cast("int")).select(*log.columns, "accepted", "used")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in the order: refunds, or results that arrive twice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rate_limited(calls: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Adds in_window and allowed. A user's window opens with the first call after the last one ended.

    Whether a call opens a window depends on the window before, so a fold over a user's times
    gives the openings; which window a call is in, and its number there, are windows' work.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    users = calls.groupBy("user_id").agg(F.array_sort(F.collect_list(t)).alias("times"))
    start = F.struct(F.lit(None).cast("long").alias("since"), F.array().cast("array<long>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = a["since"].isNull() | (x >= a["since"] + seconds * 1_000_000)
        return F.when(new, F.struct(x.alias("since"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)

    opened = users.select("user_id", F.explode(F.aggregate("times", start, step)["out"]).alias("t")).select("user_id", "t", F.lit(None).cast("long").alias("event_id"), F.col("t").alias("since"))
    both = opened.unionByName(calls.select("user_id", t.alias("t"), "event_id", F.lit(None).cast("long").alias("since")))
    w = Window.partitionBy("user_id").orderBy("t", F.desc_nulls_last("since"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("window", F.last("since", ignorenulls=True).over(w)).where("since IS NULL")
    n = F.row_number().over(Window.partitionBy("user_id", "window").orderBy("t", "event_id"))
    return placed.select("user_id", "event_id", n.alias("in_window")).withColumn("allowed", F.col("in_window") <= limit)


def route_limited(calls: DataFrame, limits: dict[str, tuple[int, int]] = ROUTE_LIMITS) -> DataFrame:
    """in_window and allowed of each call (route, user_id, ts, event_id): every route has its own windows and limit."""
    out = None
    for route, (seconds, limit) in limits.items():
        part = rate_limited(calls.where(F.col("route") == route), seconds, limit).withColumn("route", F.lit(route))
        out = part if out is None else out.unionByName(part)
    return out


def breaker_states(calls: DataFrame, threshold: int = 5, reset_seconds: float = 30.0) -> DataFrame:
    """Adds state after each call of a service (service, ts, event_id, ok, countable) and let_through.

    Closed until ``threshold`` failures in a row that count; then open, turning calls away,
    until the reset time has passed since the last failure; then one call probes.
    """

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        state, failures, last = "closed", 0, None
        states, passed = [], []
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        for ts, ok, countable in zip(rows["ts"], rows["ok"], rows["countable"], strict=True):
            probing = state == "half-open" or (state == "open" and (ts - last).total_seconds() >= reset_seconds)
            through = state != "open" or probing
            if through:
                if ok:
                    state, failures = "closed", 0
                else:
                    last = ts
                    if countable:
                        failures += not probing
                        if probing or failures >= threshold:
                            state = "open"
                    elif probing:
                        state = "half-open"
            states.append(state)
            passed.append(through)
        return rows.assign(state=states, let_through=passed)

    return calls.groupBy("service").applyInPandas(fold, _with(calls, state=T.StringType(), let_through=T.BooleanType()))


def token_requests(asks: DataFrame, cool_seconds: int = 60, life_seconds: int = 1800) -> DataFrame:
    """Reset tokens of a user: issued unless the last issued one is younger than the cool-down; adds expires_at and closed_at.

    A new token closes the one before; issue decisions depend on each other, so they are folded.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        last, issued = None, []
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        for ts in rows["ts"]:
            ok = last is None or (ts - last).total_seconds() >= cool_seconds
            last = ts if ok else last
            issued.append(ok)
        return rows.assign(issued=issued)

    marked = asks.groupBy("user_id").applyInPandas(fold, _with(asks, issued=T.BooleanType())).where("issued")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    expires = F.col("ts") + F.make_dt_interval(secs=F.lit(life_seconds))
    return marked.withColumn("expires_at", expires).withColumn("closed_at", F.least("expires_at", F.lead("ts").over(w)))


def exposition(rows: DataFrame, name: Column, labels: Column, value: Column) -> DataFrame:
    """Metric lines, one for each name and label set, with the summed value."""
    from ..functions.text import metric_key

    return rows.groupBy(metric_key(name, labels).alias("metric")).agg(F.sum(value).alias("value"))


def pages_in_batches(pages: DataFrame, keys: list[str], order: list[str], size: int = 8) -> DataFrame:
    """Adds batch: consecutive groups of ``size`` rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
