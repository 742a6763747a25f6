"""The task queue as queries: claim order, recovery, backoff, failed tasks, change sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("PENDING", "RUNNING", "DONE", "FAILED")
#: Seconds that a task waits when something is busy; others wait the longest.
BUSY_SECONDS = {"sequential-read": 1, "write-contention": 2, "partial-gate": 3, "decode-gate": 3}
OTHER_BUSY_SECONDS = 30


def claim_order(tasks: DataFrame, now: int, kind: str | None = None, least_priority: int | None = None) -> DataFrame:
    """Pending tasks that are due, in the order workers take them; limit() on it is a top-n without a full sort."""
    due = tasks.where((F.col("state") == "PENDING") & (F.col("enqueued_at") <= now))
    if kind is not None:
        due = due.where(F.col("kind") == kind)
    if least_priority is not None:
        due = due.where(F.col("priority") >= least_priority)
    return due.orderBy(F.desc("priority"), "enqueued_at", "id")


def claim(tasks: DataFrame, n: int, now: int, **which) -> DataFrame:
    """The queue after n claims: the first n due tasks run and have one more attempt."""
    taken = claim_order(tasks, now, **which).limit(n).select("id", F.lit(True).alias("taken"))
    j = tasks.join(taken, "id", "left")
    return j.withColumn("state", F.when(F.col("taken"), "RUNNING").otherwise(F.col("state"))).withColumn("attempts", F.col("attempts") + F.coalesce(F.col("taken").cast("int"), F.lit(0))).drop("taken")


def recover(tasks: DataFrame, now: int) -> DataFrame:
    """After a crash: running tasks are pending again, and none is due in the future."""
    state = F.when(F.col("state") == "RUNNING", "PENDING").otherwise(F.col("state"))
    due = F.when(state == "PENDING", F.least("enqueued_at", F.lit(now).cast("long"))).otherwise(F.col("enqueued_at"))
    return tasks.withColumn("enqueued_at", due).withColumn("state", state)


def busy_seconds(reason: Column) -> Column:
    out = F.lit(OTHER_BUSY_SECONDS)
    for name, seconds in BUSY_SECONDS.items():
        out = F.when(reason == name, seconds).otherwise(out)
    return out


def latest_states(events: DataFrame) -> DataFrame:
    """(id, state) of an event log (id, seq, state): the last event wins; the aggregate combines before the shuffle."""
    return events.groupBy("id").agg(F.max_by("state", "seq").alias("state"))


def failed_tasks(tasks: DataFrame, hashed_paths: DataFrame, most: int) -> DataFrame:
    """(path, id, attempts, reason): failed tasks of priority 0 and above by path, but for paths (path) of active hashed files.

    Attempts are summed, the last task's reason counts ("task failed" without one); newest first, reasons cut at 2000 characters.
    """
    f = tasks.where("state = 'FAILED' and priority >= 0 and path is not null").join(hashed_paths.select("path").distinct(), "path", "left_anti")
    reason = F.coalesce("last_error", F.lit("task failed"))
    g = f.groupBy("path").agg(F.max("id").alias("id"), F.sum(F.greatest("attempts", F.lit(0))).alias("attempts"), F.max_by(F.struct(reason.alias("reason")), "id").alias("last"))
    return g.select("path", "id", "attempts", F.substring("last.reason", 1, 2_000).alias("reason")).orderBy(F.desc("id")).limit(most)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(series, ts_ms, allowed): each request takes a token; tokens come back at rate a second up to burst.

    Each decision needs the one before: series are streamed in order, whatever their size.
    """
    ordered = requests.select("series", "ts_ms").repartition("series").sortWithinPartitions("series", "ts_ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last = None, burst, 0
        for pdf in batches:
            out = np.zeros(len(pdf), bool)
            for k, (s, t) in enumerate(zip(pdf["series"], pdf["ts_ms"], strict=True)):
                if s != at:
                    at, tokens, last = s, burst, t
                tokens, last = min(burst, tokens + rate * max(0, t - last) / 1000), t
                if tokens >= 1:
                    tokens -= 1
                    out[k] = True
            yield pd.DataFrame({"series": pdf["series"], "ts_ms": pdf["ts_ms"], "allowed": out})

    return ordered.mapInPandas(run, "series string, ts_ms long, allowed boolean")
