"""What clients ask for: groups, details, conflicts, safe deletion and its journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.operators.summaries import tagged_groups


def list_groups(groups: DataFrame, members: DataFrame, edges: DataFrame, trust: str | None, offset: int, limit: int) -> DataFrame:
    """(group_id, trust, best_file_id, members, all_tagged) of one page in id order; only the page is joined."""
    g = groups if trust is None else groups.where(F.col("trust") == trust)
    page = g.orderBy("group_id").offset(offset).limit(limit).select("group_id", "trust", "best_file_id")
    n = members.join(page.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("members"))
    tags = tagged_groups(edges.join(page.select("group_id"), "group_id", "left_semi")).select("group_id", "all_tagged")
    return page.join(n, "group_id", "left").join(tags, "group_id", "left").select("group_id", "trust", "best_file_id", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("all_tagged", F.lit(False)).alias("all_tagged"))


def file_details(members: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """Members with their file's details; resolution only where both sides are known."""
    both = F.col("width_px").isNotNull() & F.col("height_px").isNotNull()
    f = files.where("deleted_at is null").select(
        F.col("id").alias("file_id"), "path", "size_bytes", F.when(F.col("codec").isin("hevc", "h265"), "h265").when(F.col("codec").isin("mpeg2video", "mpeg2"), "mpeg2").otherwise(F.col("codec")).alias("codec"),
        F.when(both, F.col("width_px")).alias("width_px"), F.when(both, F.col("height_px")).alias("height_px"))
    return members.select("group_id", "file_id").join(groups.select("group_id", "best_file_id"), "group_id").join(f, "file_id").withColumn("is_best", F.coalesce(F.col("file_id") == F.col("best_file_id"), F.lit(False))).drop("best_file_id")


def conflicts(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(file_id, groups, best_in) of files that are the best copy of one group and not of another."""
    j = members.select("group_id", "file_id").join(groups.select("group_id", "best_file_id"), "group_id").withColumn("best", F.coalesce(F.col("file_id") == F.col("best_file_id"), F.lit(False)))
    g = j.groupBy("file_id").agg(F.count("*").alias("groups"), F.sum(F.col("best").cast("long")).alias("best_in"))
    return g.where("groups >= 2 and best_in > 0 and best_in < groups")


def overlaps(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Edges with spans as (group_id, clip, source, ...): the clip has fewer scenes; incomplete spans are marked for another search."""
    c = edges.join(counts.select(F.col("file_id").alias("file_a"), F.col("n").alias("na")), "file_a", "left").join(counts.select(F.col("file_id").alias("file_b"), F.col("n").alias("nb")), "file_b", "left")
    a_first = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    spans = ["clip_start_ms", "clip_end_ms", "source_start_ms", "source_end_ms", "matched_scenes", "clip_scenes"]
    whole = F.lit(True)
    for s in spans:
        whole = whole & F.col(s).isNotNull()
    return c.select("group_id", F.when(a_first, F.col("file_a")).otherwise(F.col("file_b")).alias("clip"), F.when(a_first, F.col("file_b")).otherwise(F.col("file_a")).alias("source"), *spans, (~whole).alias("search_again"))


def deletion_verdict(members: DataFrame, groups: DataFrame, selected: DataFrame, confirmed: Column) -> DataFrame:
    """(group_id, verdict) for selections (group_id, file_id): the first of NONE_SELECTED, UNKNOWN_MEMBER, DELETE_ALL, BEST_UNCONFIRMED that holds, else OK."""
    m = members.select("group_id", "file_id").distinct().withColumn("member", F.lit(1))
    s = selected.select("group_id", "file_id").distinct().withColumn("chosen", F.lit(1))
    j = m.join(s, ["group_id", "file_id"], "full_outer").join(groups.select("group_id", "best_file_id"), "group_id")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = j.groupBy("group_id").agg(
        one(F.col("member") == 1).alias("members"), one(F.col("chosen") == 1).alias("chosen"), one((F.col("chosen") == 1) & F.col("member").isNull()).alias("unknown"),
        one((F.col("chosen") == 1) & (F.col("file_id") == F.col("best_file_id"))).alias("best"))
    verdict = F.when(F.col("chosen") == 0, "NONE_SELECTED").when(F.col("unknown") > 0, "UNKNOWN_MEMBER").when(F.col("chosen") >= F.col("members"), "DELETE_ALL").when((F.col("best") > 0) & ~confirmed, "BEST_UNCONFIRMED").otherwise("OK")
    return g.select("group_id", verdict.alias("verdict"))


def journal_state(log: DataFrame) -> DataFrame:
    """(batch_id, status) of an append-only journal (batch_id, seq, status)."""
    return log.groupBy("batch_id").agg(F.max_by("status", "seq").alias("status"))


def undo_last(journal: DataFrame, batch_files: DataFrame, existing: DataFrame) -> DataFrame:
    """(file_id, action) for the last committed batch: restore its deleted files that exist again, and re-add survivors."""
    last = journal.where("status = 'COMMITTED'").orderBy(F.desc("batch_id")).limit(1).select("batch_id")
    b = batch_files.join(F.broadcast(last), "batch_id", "left_semi").join(existing.select("file_id", F.lit(True).alias("there")), "file_id", "left")
    action = F.when(F.col("role") == "SURVIVOR", "re-add").when(F.col("there"), "restore").otherwise("lost")
    return b.select("file_id", action.alias("action"))


def reconcile_pending(journal: DataFrame, batch_files: DataFrame, existing: DataFrame) -> DataFrame:
    """(batch_id, action, gone): at start, a pending batch is committed for the files that are gone, dropped if none is."""
    p = journal.where("status = 'PENDING'").select("batch_id")
    b = batch_files.where("role = 'DELETED'").join(p, "batch_id", "left_semi").join(existing.select("file_id", F.lit(1).alias("there")), "file_id", "left")
    g = b.groupBy("batch_id").agg(F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("gone"))
    return g.select("batch_id", F.when(F.col("gone") > 0, "commit").otherwise("drop").alias("action"), "gone")


def default_selection(members: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, selected, reclaimed_bytes, safe): everything but the best copy; not safe without a best member."""
    m = members.select("group_id", "file_id").join(files.where("deleted_at is null").select(F.col("id").alias("file_id"), "size_bytes"), "file_id").join(groups.select("group_id", "best_file_id"), "group_id")
    best = F.coalesce(F.col("file_id") == F.col("best_file_id"), F.lit(False))
    g = m.groupBy("group_id").agg(F.sum((~best).cast("long")).alias("others"), F.max(best).alias("safe"), F.sum(F.when(best, 0).otherwise(F.col("size_bytes"))).alias("bytes"))
    return g.select("group_id", F.when(F.col("safe"), F.col("others")).otherwise(0).cast("long").alias("selected"), F.when(F.col("safe"), F.col("bytes")).otherwise(0).cast("long").alias("reclaimed_bytes"), "safe")


def overlap_fractions(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Start and end as parts of a duration, between 0 and 1, the end not before the start; 0 for no duration."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    a, b = clamp(F.try_divide(start, duration)), clamp(F.try_divide(end, duration))
    fine = duration > 0
    return F.when(fine, a).otherwise(F.lit(0.0)), F.when(fine, F.greatest(a, b)).otherwise(F.lit(0.0))


# Fixed value: from this ratio of lengths on a clip without overlaps is taken for the whole file.
WHOLE_FILE_RATIO = 0.9


def timeline_mode(trust: Column, has_overlaps: Column, shorter: Column, longer: Column) -> Column:
    """hidden but for POSSIBLE groups; partial with overlaps; else full-span with its notice, by the ratio of lengths."""
    whole = F.coalesce(F.try_divide(shorter, longer), F.lit(0.0)) >= WHOLE_FILE_RATIO
    return F.when(F.coalesce(trust != "POSSIBLE", F.lit(True)), "hidden").when(has_overlaps, "partial").when(whole, "full-span:whole-file-est").otherwise("full-span:missing-overlap")
