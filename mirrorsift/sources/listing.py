"""File listings as tables, and features read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorsift.operators.selection import EXCLUDED_DIRS, VIDEO_EXTENSIONS, accepts_extension, under_excluded_dir


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS, excludes: tuple[str, ...] = EXCLUDED_DIRS, max_depth: int | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ns, inode) of files below a root in any store that Spark reads, ordered by path.

    Contents aren't read: the content column is pruned. Stores have no inodes; it is null (not known).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), "/+", "/")
    rows = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(None).cast("long").alias("inode"))
    rows = rows.where(accepts_extension(F.col("path"), extensions))
    inner = F.expr(f"substring(path, {len(base) + 1})") if base else F.col("path")
    rows = rows.where(~under_excluded_dir(inner, excludes))
    if max_depth is not None:
        rows = rows.where(F.size(F.split(inner, "/")) - 1 <= max_depth)
    return rows.orderBy("path")


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, content_hash) of files' bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("content_hash"))
