"""Structured Streaming: limits, quotas and once-only refunds with state.

``watch_*`` take a streaming DataFrame and return one. The other functions run one of them
over a table folder until nothing new is left, and hand back what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.runtime import shared_dir


def watch_refunds(events: DataFrame, keys: list[str], delay: str = "24 hours") -> DataFrame:
    """Each key once while its state lives: the watermark is as long as a job's state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def watch_first(events: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest time of each key so far (update mode)."""
    return events.groupBy(*keys).agg(F.min("ts").alias("ts"))


def _expiring(events: DataFrame, delay: str | None) -> tuple[DataFrame, str]:
    """Events with a watermark, and what lets state end: nothing without a delay."""
    if delay is None:
        return events, GroupStateTimeout.NoTimeout
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout


def _keep(state: GroupState, value: tuple, until_ms: int, delay: str | None) -> None:
    """Sets a state that ends once the watermark has passed ``until_ms``."""
    state.update(value)
    if delay is not None:
        state.setTimeoutTimestamp(max(until_ms, state.getCurrentWatermarkMs()) + 1)


def watch_rate(events: DataFrame, seconds: int, limit: int, delay: str | None = None) -> DataFrame:
    """Calls (user_id, event_id, ts) with in_window and allowed; a window opens with the first call after the last one.

    With a ``delay`` a user's state ends once the watermark has passed its window: the next
    call opens a new one anyway. Calls later than the delay are then dropped.
    """
    events, timeout = _expiring(events, delay)

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        counts = []
        for t in rows["micros"].tolist():
            if since < 0 or t >= since + seconds * 1_000_000:
                since, n = t, 0
            n += 1
            counts.append(n)
        _keep(state, (int(since), int(n)), int(since) // 1000 + seconds * 1000, delay)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "in_window": counts, "allowed": [c <= limit for c in counts]})

    calls = events.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return calls.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, in_window int, allowed boolean", "since long, n int", "append", timeout)


def watch_quota(events: DataFrame, limit: int, delay: str | None = None) -> DataFrame:
    """Calls of a user on a day that the quota admits, counted in state; with a ``delay`` a day's state ends once the watermark has passed the day."""
    events, timeout = _expiring(events, delay)

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (used,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        kept = rows.head(max(0, limit - used))
        _keep(state, (int(used + len(kept)),), int(rows["day_end"].iloc[0]), delay)
        yield pd.DataFrame({"user_id": key[0], "day": key[1], "event_id": kept["event_id"]})

    end = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY"))
    calls = events.select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "ts", "event_id", end.alias("day_end"))
    return calls.groupBy("user_id", "day").applyInPandasWithState(fold, "user_id long, day string, event_id long", "used int", "append", timeout)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of Parquet as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('.parquet', '*.parquet')}")


def drained(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, writes it to shared storage and returns all written so far.

    Each micro-batch goes to a folder of its own number, so a batch that runs again after a
    failure replaces what it wrote. With the same ``base``, a later run goes on where an
    earlier one stopped or failed: offsets and state are kept there.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    drained.progress = run.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    seen = drained(watch_first(read_stream(spark, path), ["user_id", "event_type"]), "update")
    return seen.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))


def rate_limit(spark: SparkSession, path: str, seconds: int, limit: int) -> DataFrame:
    return drained(watch_rate(read_stream(spark, path), seconds, limit))
