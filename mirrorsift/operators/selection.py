"""Filters, lookups and joins over files, fingerprints, groups and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.sources.store import materialize

# File name extensions of video containers, and folder names that are never listed.
VIDEO_EXTENSIONS = ("mp4", "mkv", "m4v", "mov", "avi", "webm", "ts", "m2ts", "mts", "flv", "wmv", "mpg", "mpeg", "ogv", "3gp")
EXCLUDED_DIRS = ("$recycle.bin", "system volume information", "$winreagent", "$windows.~bt", "$windows.~ws", "recovery", "config.msi", "node_modules")
FAST_CODECS = ("h264", "hevc", "h265")


def extension(path: Column) -> Column:
    """Lower-case file name extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def accepts_extension(path: Column, allowed: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    return extension(path).isin([a.lstrip(".").lower() for a in allowed])


def under_excluded_dir(path: Column, names: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """Whether a folder of the path is excluded by name or begins with found. (numbered lost files)."""
    rules = [n.strip().lower() for n in names if n.strip()]
    folders = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    return F.exists(folders, lambda p: F.lower(p).isin(rules) | F.lower(p).startswith("found."))


def in_subtree(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def active(files: DataFrame) -> DataFrame:
    return files.where(F.col("deleted_at").isNull())


def hashed_active(files: DataFrame) -> DataFrame:
    return active(files).where(F.col("content_hash").isNotNull())


def twins_with_features(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """For each file the smallest active file of another path with the same content that has a fingerprint: (id, twin_id).

    The two smallest candidates of each content decide, so no pairs are made within a content."""
    able = active(files).where("content_hash is not null").join(fingerprints.select(F.col("file_id").alias("id")), "id", "left_semi")
    paths = able.groupBy("content_hash", "path").agg(F.min("id").alias("id"))
    rank = Window.partitionBy("content_hash").orderBy("id")
    two = paths.withColumn("n", F.row_number().over(rank)).where("n <= 2").groupBy("content_hash").agg(
        F.min("id").alias("first_id"), F.min_by("path", "id").alias("first_path"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("second_id"))
    out = files.where("content_hash is not null").join(two, "content_hash")
    return out.select("id", F.when(F.col("path") != F.col("first_path"), F.col("first_id")).otherwise(F.col("second_id")).alias("twin_id")).where("twin_id is not null")


def with_active_file(fingerprints: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    return fingerprints.join(active(files).select(F.col("id").alias("file_id"), *columns), "file_id")


def fast_path(codec: Column) -> Column:
    """Fast codecs, and codecs not known yet."""
    return codec.isNull() | codec.isin(*FAST_CODECS)


def valid_markers(fingerprints: DataFrame, files: DataFrame) -> DataFrame:
    """Skip markers with whether they still hold: size and time are the file's own; those of twins always hold."""
    m = fingerprints.where("skip_reason is not null").join(files.select(F.col("id").alias("file_id"), "size_bytes", "mtime_ns"), "file_id")
    same = (F.col("skip_size") == F.col("size_bytes")) & (F.col("skip_mtime") == F.col("mtime_ns"))
    return m.select("file_id", "skip_reason", ((F.col("skip_reason") == "exact-full-dup") | same).alias("holds"))


# Parts of messages that mark a failure as passing, and failed attempts from which on any other is permanent.
TRANSIENT_PARTS = (
    "timed out after",
    "base-index decode gate at capacity (concurrent base decodes in flight)",
    "sequential-read gate at capacity (concurrent full-file reads in flight)",
    "partial-clip decode gate at capacity (concurrent partials in flight)",
    "resource busy or locked",
    "is locked",
)
PERMANENT_FROM = 1


def failure_class(message: Column, attempts: Column) -> Column:
    """transient for failures that may pass or that weren't tried again yet, else permanent; null for no message."""
    passing = F.lit(False)
    for part in TRANSIENT_PARTS:
        passing = passing | message.contains(part)
    return F.when(message.isNotNull(), F.when(passing | (attempts < PERMANENT_FROM), "transient").otherwise("permanent"))


def staleness(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, verdict): stale if size or time differ from the listing's, absent if it has no such path, else fresh."""
    now = listing.select("path", F.col("size_bytes").alias("now_size"), F.col("mtime_ns").alias("now_mtime"))
    changed = (F.col("now_size") != F.col("size_bytes")) | (F.col("now_mtime") != F.col("mtime_ns"))
    verdict = F.when(F.col("now_size").isNull(), "absent").when(changed, "stale").otherwise("fresh")
    return targets.join(now, "path", "left").select("path", verdict.alias("verdict"))


def groups_without_deleted(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Groups with members where deleted members are filtered after the join: a group of deleted files alone is gone."""
    f = files.select(F.col("id").alias("file_id"), F.lit(True).alias("known"), "deleted_at")
    return groups.join(members.select("group_id", "file_id"), "group_id", "left").join(f, "file_id", "left").where("file_id is null or deleted_at is null")


def groups_with_active(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """All groups with their active members; a group without any has one row with a null file_id."""
    live = members.select("group_id", "file_id").join(active(files).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return groups.join(live, "group_id", "left")


def backfill(files: DataFrame, fingerprints: DataFrame, exact_members: DataFrame) -> DataFrame:
    """Active files that lack partial features, aren't skipped for another reason than being a twin, and are in no exact group."""
    have = fingerprints.where("has_partial or (skip_reason is not null and skip_reason <> 'exact-full-dup')").select(F.col("file_id").alias("id"))
    return active(files).join(have, "id", "left_anti").join(exact_members.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti")


def resume_after(listing: DataFrame, sentinel: str) -> DataFrame:
    """Paths after the sentinel in path order; none if the sentinel isn't listed."""
    found = listing.where(F.col("path") == sentinel).limit(1).select(F.col("path").alias("sentinel"))
    return listing.join(F.broadcast(found), F.col("path") > F.col("sentinel")).drop("sentinel")  # one row


def scan_progress(listing: DataFrame, parts: int = 64) -> DataFrame:
    """(path, files_seen, bytes_seen): running counts in path order, summed part by part so that no task sees all rows."""
    # kept: both uses need the same bounds of parts
    ordered = materialize(listing.select("path", "size_bytes").repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    before = Window.orderBy("part")
    starts = sums.select("part", (F.sum("n").over(before) - F.col("n")).alias("n0"), (F.sum("b").over(before) - F.col("b")).alias("b0"))
    w = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    run = ordered.select("part", "path", F.count("*").over(w).alias("n"), F.sum("size_bytes").over(w).alias("b"))
    return run.join(starts, "part").select("path", (F.col("n") + F.col("n0")).alias("files_seen"), (F.col("b") + F.col("b0")).alias("bytes_seen"))


def rescale_to_ms(ticks: Column, timescale: Column) -> Column:
    """Ticks to milliseconds, rounded half up, in exact decimals; null for a timescale of 0."""
    t, s = ticks.cast("decimal(38,0)"), timescale.cast("decimal(38,0)")
    return F.when(timescale > 0, F.floor((t * 1000 + F.floor(s / 2)) / s)).cast("long")


def gops(keyframes: DataFrame, end: str) -> DataFrame:
    """keyframes (file_id, index, at) with gop_size and gop_length up to the next one, or the file's end (columns end_index, end)."""
    w = Window.partitionBy("file_id").orderBy("index")
    nxt = F.coalesce(F.lead("at").over(w), F.col(end))
    return keyframes.select("file_id", "index", "at", (F.coalesce(F.lead("index").over(w), F.col("end_index")) - F.col("index")).alias("gop_size"), (nxt - F.col("at")).alias("gop_length"))


def decode_times(table: DataFrame) -> DataFrame:
    """A run-length sample table (file_id, run, n, delta) as (file_id, sample, ticks): samples from 1, ticks before each."""
    runs = Window.partitionBy("file_id").orderBy("run")
    r = table.select("file_id", "n", "delta", (F.sum("n").over(runs) - F.col("n")).alias("first"), (F.sum(F.col("n") * F.col("delta")).over(runs) - F.col("n") * F.col("delta")).alias("base"))
    s = r.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return s.select("file_id", (F.col("first") + F.col("k") + 1).alias("sample"), (F.col("base") + F.col("k") * F.col("delta")).alias("ticks"))
