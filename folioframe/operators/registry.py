"""Records of the service: jobs, samples, sessions, tokens and files, over tables of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operations import SAMPLES, rank_percentiles, recent


def recent_samples(rows: DataFrame, keys: list[str], order: list[str], duration: str, confidence: Column, size: int = SAMPLES) -> DataFrame:
    """Per key over its last samples: p50 and p95 of durations below none of zero, and the mean of confidences between 0 and 1."""
    last = recent(rows, keys, [F.desc(c) for c in order], size)
    last = last.withColumn(duration, F.greatest(F.lit(0.0), F.col(duration))).withColumn("__confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    places = rank_percentiles(last, keys, duration).drop("mean")
    return places.join(last.groupBy(*keys).agg(F.avg("__confidence").alias("avg_confidence")), keys)


def changed(rows: DataFrame, keys: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Rows that are the first of their key or differ in a watched column from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.row_number().over(w) > 1
    for c in watched:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def readiness(probes: DataFrame, keys: list[str], healthy: Column) -> DataFrame:
    """ok if every probe of a key is healthy, else degraded; a probe without an answer isn't."""
    fine = F.bool_and(F.coalesce(healthy, F.lit(False)))
    return probes.groupBy(*keys).agg(F.when(fine, F.lit("ok")).otherwise(F.lit("degraded")).alias("status"), F.count(F.lit(1)).alias("n_probes"))


def refund_work(jobs: DataFrame, refunded: DataFrame) -> DataFrame:
    """Failed jobs (job_id, status, quota_key, ...) that no refund names yet: the work that goes back to the queue."""
    return jobs.where("status = 'failed'").join(refunded, "job_id", "left_anti").withColumn("refund_only", F.lit(True))


def outcomes(jobs: DataFrame, status: Column, fidelity: Column, least: float = 0.99) -> DataFrame:
    """Counted outcomes: a job whose fidelity has drifted counts once more, as failed."""
    extra = F.when(F.coalesce(fidelity, F.lit(1.0)) < least, F.lit("failed"))
    return jobs.select(F.explode(F.array_compact(F.array(status, extra))).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def evicted(jobs: DataFrame, keys: list[str], order: list[str], terminal: Column, cap: int) -> DataFrame:
    """What a bounded registry keeps: beyond the cap its oldest finished entries go, and nothing else."""
    w = Window.partitionBy(*keys)
    marked = jobs.withColumn("__done", terminal).withColumn("__n", F.count(F.lit(1)).over(w))
    marked = marked.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__done").orderBy(*order)))
    return marked.where(~(F.col("__done") & (F.col("__place") <= F.col("__n") - cap))).drop("__done", "__n", "__place")


def expired(files: DataFrame, age_seconds: int, now: Column) -> DataFrame:
    """Files (path, modified) at least so old."""
    return files.where(F.col("modified") <= now - F.make_dt_interval(secs=F.lit(age_seconds)))


def with_prefix(counters: DataFrame, prefix: str) -> DataFrame:
    """Sums of the counters (key, n) whose key begins so, without the prefix."""
    named = counters.where(F.startswith("key", F.lit(prefix))).withColumn("key", F.substr("key", F.lit(len(prefix) + 1)))
    return named.groupBy("key").agg(F.sum("n").alias("n"))


def claims(log: DataFrame, user: str, order: list[str], issues: Column, claims_: Column, life_seconds: int) -> DataFrame:
    """Tokens and the first claim that comes while each is open: the last one issued, not yet used, not expired.

    log has ts and event_id; the result has token, claim and the user.
    """
    w = Window.partitionBy(user).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    token = F.last(F.when(issues, F.struct("event_id", "ts")), ignorenulls=True).over(before)
    tried = log.withColumn("__token", token).where(claims_ & (F.col("ts") < F.col("__token.ts") + F.make_dt_interval(secs=F.lit(life_seconds))))
    first = tried.groupBy(user, F.col("__token.event_id").alias("token")).agg(F.min_by("event_id", F.struct(*order)).alias("claim"))
    return first


def live_sessions(sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sessions (user_id, version, ...) whose version is that of an account (user_id, version, disabled) that may log in."""
    able = accounts.where(~F.col("disabled")).select("user_id", "version")
    return sessions.join(able, ["user_id", "version"], "left_semi")


def matched_results(results: DataFrame, submitted: DataFrame) -> DataFrame:
    """Results (name, job_id) with the first submitted file (name, place, ...) of their name; results without a job don't count."""
    w = Window.partitionBy("name").orderBy("place")
    first = submitted.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return results.where("job_id IS NOT NULL").join(first, "name")


def token_users(asked: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """The user of each token that someone presents: by its hash, as tokens are stored; unknown tokens and users have none.

    asked (token), tokens (token_hash, user_id), users (user_id, ...); hashes and users are unique.
    """
    from ..functions.service import token_hash

    return asked.withColumn("token_hash", token_hash(F.col("token"))).join(tokens, "token_hash").join(users, "user_id").drop("token_hash")
