"""Snapshot differences, change events, enqueue reconciliation, and series of progress samples."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.operators.selection import accepts_extension, in_subtree, under_excluded_dir


def same_state(a: str, b: str) -> Column:
    """Equal size and time; the inode counts only where both are known."""
    inode = F.col(f"{a}inode").isNull() | F.col(f"{b}inode").isNull() | (F.col(f"{a}inode") == F.col(f"{b}inode"))
    return (F.col(f"{a}size_bytes") == F.col(f"{b}size_bytes")) & (F.col(f"{a}mtime_ns") == F.col(f"{b}mtime_ns")) & inode


def snapshot_diff(previous: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or unchanged."""
    pre = lambda d, p: d.select("path", *[F.col(c).alias(p + c) for c in ("size_bytes", "mtime_ns", "inode")], F.lit(True).alias(p + "there"))
    j = pre(previous, "o_").join(pre(now, "n_"), "path", "full_outer")
    change = F.when(F.col("o_there").isNull(), "added").when(F.col("n_there").isNull(), "removed").when(same_state("o_", "n_"), "unchanged").otherwise("modified")
    return j.select("path", change.alias("change"))


def classify_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, path, change) of raw events: renames of both ends give two changes.

    Upserts need a video extension and no excluded folder; removes admit names without extension (folders) as well.
    """
    item = lambda c, p: F.struct(F.lit(c).alias("change"), F.col(p).alias("path"))
    up, down = F.array(item("Upsert", "path")), F.array(item("Remove", "path"))
    both = F.array(item("Remove", "path"), item("Upsert", "new_path"))
    kind = F.col("kind")
    changes = F.when(kind.isin("create", "modify", "rename_to"), up).when(kind.isin("remove", "rename_from"), down).when(kind == "rename_both", both)
    rows = events.select("event_id", "ts", F.explode(changes).alias("c")).select("event_id", "ts", F.col("c.path").alias("path"), F.col("c.change").alias("change"))
    video = accepts_extension(F.col("path"))
    bare = ~F.regexp_like("path", F.lit(r"\.[^./]+$"))
    return rows.where(F.col("path").isNotNull() & F.when(F.col("change") == "Remove", video | bare).otherwise(video & ~under_excluded_dir(F.col("path"))))


def debounce(changes: DataFrame, gap: str) -> DataFrame:
    """(path, released_from, last_ts, change, n): changes of a path closer than the gap are one, with the last one's kind."""
    last = F.max_by("change", F.struct("ts", "event_id"))
    g = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("released_from"), F.max("ts").alias("last_ts"), last.alias("change"), F.count("*").alias("n"))
    return g.drop("w")


def reconcile_enqueue(incoming: DataFrame, queue: DataFrame) -> DataFrame:
    """(path, change, outcome, replaces) for incoming (path, change, size_bytes), one for each path and change.

    skip: the same is active, or an Upsert meets an active Upsert or ForceUpsert, or it failed at the same size before.
    replace: a ForceUpsert takes the place of an active Upsert. insert otherwise.
    """
    live = queue.where("state in ('PENDING', 'RUNNING') and path is not null").groupBy("path").agg(F.collect_set("change").alias("kinds"), F.max(F.when(F.col("change") == "Upsert", F.col("id"))).alias("upsert_id"))
    failed = queue.where("state = 'FAILED' and path is not null").groupBy("path", "size_bytes").agg(F.lit(True).alias("failed"))
    j = incoming.join(live, "path", "left").join(failed, ["path", "size_bytes"], "left")
    has = lambda c: F.coalesce(F.array_contains("kinds", c), F.lit(False))
    same = F.coalesce(F.array_contains(F.col("kinds"), F.col("change")), F.lit(False))
    up = F.col("change") == "Upsert"
    skip = same | (up & (has("Upsert") | has("ForceUpsert"))) | (up & F.coalesce("failed", F.lit(False)))
    replace = (F.col("change") == "ForceUpsert") & has("Upsert")
    outcome = F.when(skip, "skip").when(replace, "replace").otherwise("insert")
    return j.select("path", "change", outcome.alias("outcome"), F.when(outcome == "replace", F.col("upsert_id")).alias("replaces"))


def initial_scan(active: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed paths that are new or changed against the active files."""
    return snapshot_diff(active.select("path", "size_bytes", "mtime_ns", "inode"), listing).where("change in ('added', 'modified')")


def missing_paths(known: DataFrame, listing: DataFrame, reachable_roots: list[str]) -> DataFrame:
    """Known paths under reachable roots that aren't listed: to be removed. Paths of roots that are offline stay."""
    under = F.lit(False)
    for r in reachable_roots:
        under = under | in_subtree(F.col("path"), r)
    return known.where(under).join(listing.select("path"), "path", "left_anti")


def copy_features_to_twins(features: DataFrame, files: DataFrame) -> DataFrame:
    """(id, feature, computed) of all files with a hash: computed once for each content, on its smallest id, and joined back."""
    f = files.where("content_hash is not null").select("id", "content_hash")
    first = f.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    have = first.join(features.select(F.col("file_id").alias("first_id"), "feature"), "first_id")
    return f.join(have, "content_hash").select("id", "feature", (F.col("id") == F.col("first_id")).alias("computed"))


# ---------------------------------------------------------------- series

def _by():
    return Window.partitionBy("series").orderBy("ts_ms")


def remaining() -> Column:
    return F.col("pending") + F.col("running")


def _rate(now: Column, before: Column, t: Column, t0: Column) -> Column:
    dt, drained = (t - t0) / F.lit(1000.0), before - now
    return F.when((dt > 0) & (drained > 0), drained / dt).otherwise(F.lit(0.0))


def throughput(samples: DataFrame) -> DataFrame:
    """(series, ts_ms, rate) against the sample before, not below 0; the first sample has none."""
    p = samples.select("series", "ts_ms", remaining().alias("r"), F.lag(remaining()).over(_by()).alias("r0"), F.lag("ts_ms").over(_by()).alias("t0")).where("t0 is not null")
    return p.select("series", "ts_ms", _rate(F.col("r"), F.col("r0"), F.col("ts_ms"), F.col("t0")).alias("rate"))


def drain_rate(samples: DataFrame, window: int = 8) -> DataFrame:
    """(series, ts_ms, rate) of bytes against the sample a window before, or the first one."""
    w = _by().rowsBetween(-window, 0)
    p = samples.select("series", "ts_ms", "pending_bytes", F.first("pending_bytes").over(w).alias("b0"), F.first("ts_ms").over(w).alias("t0"), F.row_number().over(_by()).alias("k")).where("k > 1")
    return p.select("series", "ts_ms", _rate(F.col("pending_bytes"), F.col("b0"), F.col("ts_ms"), F.col("t0")).alias("rate"))


def eta(samples: DataFrame) -> DataFrame:
    """(series, eta_seconds) from the first and last sample; null if nothing is left or nothing drained."""
    s = samples.groupBy("series").agg(F.min(F.struct("ts_ms", remaining().alias("r"))).alias("a"), F.max(F.struct("ts_ms", remaining().alias("r"))).alias("b"))
    dt, drained = (F.col("b.ts_ms") - F.col("a.ts_ms")) / F.lit(1000.0), F.col("a.r") - F.col("b.r")
    fine = (F.col("b.r") > 0) & (dt > 0) & (drained > 0)
    return s.select("series", F.when(fine, F.floor(F.col("b.r") / (drained / dt) + 0.5)).cast("long").alias("eta_seconds"))


def stalled(samples: DataFrame, lookback: int = 6) -> DataFrame:
    """(series, ts_ms, stalled): running, and the last samples all have as many bytes pending."""
    w = _by().rowsBetween(-lookback, 0)
    same = (F.min("pending_bytes").over(w) == F.max("pending_bytes").over(w)) & (F.count("*").over(w) == lookback + 1) & (F.col("running") > 0)
    return samples.select("series", "ts_ms", same.alias("stalled"))


def last_activity(samples: DataFrame) -> DataFrame:
    """(series, ts_ms, active_ms): when done last grew; the first sample counts as activity."""
    grew = F.when(F.coalesce(F.col("done") > F.lag("done").over(_by()), F.lit(True)), F.col("ts_ms"))
    s = samples.select("series", "ts_ms", grew.alias("g"))
    return s.select("series", "ts_ms", F.last("g", ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0)).alias("active_ms"))


#: Seconds of the moving average of speeds, the part of the way that a shown time moves to a new estimate,
#: and for how many samples without an estimate a shown time is counted down.
AVERAGE_SECONDS, APPROACH, COUNTED_DOWN = 120.0, 0.15, 8


class Shown(NamedTuple):
    """What smoothing carries from one sample of a series to the next."""

    speed: float | None = None
    seconds: float | None = None
    counted: int = 0

    def label(self) -> float | None:
        return None if self.seconds is None else float(np.floor(self.seconds + 0.5))


def averaged(speed: float | None, drained: float, dt: float) -> float | None:
    """Moving average of bytes a second over intervals of any length; it begins with the first interval that drains."""
    if dt <= 0:
        return speed
    if speed is None:
        return drained / dt if drained > 0 else None
    weight = float(np.exp(-dt / AVERAGE_SECONDS))
    return weight * speed + (1 - weight) * max(0.0, drained) / dt


def next_shown(past: Shown, dt: float, drained: float, pending: float, left: float) -> Shown:
    """One step of the smoothing, dt seconds after the sample before (0 for the first one)."""
    speed = averaged(past.speed, drained, dt)
    if left <= 0:
        return Shown(speed)
    ahead = None if past.seconds is None else past.seconds - dt
    if pending > 0 and speed:
        goal = pending / speed
        return Shown(speed, goal if ahead is None else max(0.0, (1 - APPROACH) * ahead + APPROACH * goal))
    if ahead is None or past.counted >= COUNTED_DOWN:
        return Shown(speed)
    return Shown(speed, max(0.0, ahead), past.counted + 1)


def smoothed_eta(samples: DataFrame) -> DataFrame:
    """(series, ts_ms, eta_seconds): each state needs the one before, so a series is walked in order.

    Time and bytes since the sample before are windows; rows come sorted by series and time within partitions and are
    streamed: memory doesn't grow with a series.
    """
    dt = F.greatest(F.lit(0.0), F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(_by())) / 1000, F.lit(0.0)))
    drained = F.coalesce(F.lag("pending_bytes").over(_by()) - F.col("pending_bytes"), F.lit(0))
    steps = samples.select("series", "ts_ms", "pending_bytes", remaining().alias("left"), dt.alias("dt"), drained.cast("double").alias("drained"))
    ordered = steps.sortWithinPartitions("series", "ts_ms")  # the windows have brought each series together

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, Shown()
        for pdf in batches:
            out = []
            for s, *step in zip(*(pdf[c] for c in ("series", "dt", "drained", "pending_bytes", "left")), strict=True):
                now = next_shown(now if s == at else Shown(), *step)
                at = s
                out.append(now.label())
            yield pd.DataFrame({"series": pdf["series"], "ts_ms": pdf["ts_ms"], "eta_seconds": pd.array(out, dtype="Float64")})

    return ordered.mapInPandas(run, "series string, ts_ms long, eta_seconds double")


def lanes(segments: DataFrame, most: int = 200) -> DataFrame:
    """(source, clip, start, end, lane): overlapping segments of a source in the first lane that is free.

    A source shows its most covered segments only (a display limit), so a group is small.
    """
    w = Window.partitionBy("source").orderBy(F.desc("coverage"), "clip")
    top = segments.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "clip"], kind="stable")
        ends: list[float] = []
        out = []
        for a, b in zip(pdf["start"], pdf["end"], strict=True):
            k = next((i for i, e in enumerate(ends) if e <= a), len(ends))
            ends[k : k + 1] = [b]
            out.append(k)
        return pd.DataFrame({"source": pdf["source"], "clip": pdf["clip"], "start": pdf["start"], "end": pdf["end"], "lane": np.array(out, np.int64)})

    return top.select("source", "clip", "start", "end").groupBy("source").applyInPandas(place, "source long, clip long, start double, end double, lane long")
