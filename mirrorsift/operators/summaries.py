"""Aggregates over groups, edges, fingerprints, tasks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reclaimable(size: Column, is_best: Column) -> Column:
    """Bytes freed by keeping one: the sum less the best one's size if it is there, else less the largest."""
    best = F.max(F.when(is_best, size))
    return F.coalesce(F.sum(size) - F.coalesce(best, F.max(size)), F.lit(0)).cast("long")


def group_rollup(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, members, total_bytes, reclaimable_bytes); sizes of deleted members count as well."""
    m = members.select("group_id", "file_id").join(files.select(F.col("id").alias("file_id"), "size_bytes"), "file_id")
    m = m.join(groups.select("group_id", "best_file_id"), "group_id")
    return m.groupBy("group_id").agg(
        F.count("*").alias("members"), F.sum("size_bytes").alias("total_bytes"), reclaimable(F.col("size_bytes"), F.col("file_id") == F.col("best_file_id")).alias("reclaimable_bytes"))


def tagged_groups(edges: DataFrame) -> DataFrame:
    """(group_id, edges, tagged, all_tagged)."""
    g = edges.groupBy("group_id").agg(F.count("*").alias("edges"), F.sum(F.col("intro_outro").cast("long")).alias("tagged"))
    return g.withColumn("all_tagged", (F.col("edges") > 0) & (F.col("edges") == F.col("tagged")))


def frame_means(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Means over a file's frames; null where it has none."""
    return frames.groupBy(*keys).agg(F.avg("laplacian").alias("laplacian_variance"), F.avg("energy").alias("dct_energy"))


def bits_per_pixel(bitrate: Column, width: Column, height: Column, fps_x1000: Column) -> Column:
    """bitrate / (width * height * fps); null if anything is unknown or not positive."""
    fine = (bitrate > 0) & (width > 0) & (height > 0) & (fps_x1000 > 0)
    return F.when(fine, bitrate.cast("double") / (width.cast("double") * height.cast("double") * (fps_x1000.cast("double") / 1000.0)))


def gop_signature(lengths: Column) -> list[Column]:
    """Count, mean without remainder, and maximum of GOP lengths, limited to 32 bits."""
    top = F.lit(4_294_967_295)
    return [F.least(F.count(lengths), top).alias("keyframes"), F.least(F.floor(F.sum(lengths) / F.count(lengths)), top).cast("long").alias("mean_ms"), F.least(F.max(lengths), top).alias("max_ms")]


def nearest_rank(values: DataFrame, column: str, quantile: float, key: str) -> DataFrame:
    """The value of rank ceil(q n) of each key, exactly, without collecting a key: counts of equal values are summed."""
    counts = values.groupBy(key, column).agg(F.count("*").alias("n"))
    run = counts.selectExpr(key, column, f"sum(n) over (partition by {key} order by {column}) as upto", f"sum(n) over (partition by {key}) as total")
    return run.where(F.col("upto") >= F.greatest(F.ceil(F.lit(quantile) * F.col("total")), F.lit(1))).groupBy(key).agg(F.min(column).alias("value"))


def gate_report(candidates: DataFrame) -> DataFrame:
    """Least and largest density of passing and of near-equal failing candidates; 0 where there are none."""
    def ends(name: str, cond: Column) -> list[Column]:
        x = F.when(cond, F.col("density"))
        return [F.coalesce(F.min(x), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(x), F.lit(0.0)).alias(f"{name}_max")]

    return candidates.agg(*ends("passing", F.col("passes")), *ends("failing", ~F.col("passes") & F.col("near_equal")))
