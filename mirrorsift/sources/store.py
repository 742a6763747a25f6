"""Tables on shared storage: cut lineage, merge by key, insert if absent, keep the newest snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or f"file://{tempfile.gettempdir()}/mirrorsift-checkpoints").rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace those with equal keys."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are there already are left out, repeats among the new ones as well."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def newest(snapshots: DataFrame, n: int = 3) -> DataFrame:
    """Names of snapshots (name, mtime) to keep: the newest, by name among equals. The few names fit one sort."""
    return snapshots.orderBy(F.desc("mtime"), F.desc("name")).limit(n)


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


FORMAT_VERSION = 1


def write_features(df: DataFrame, path: str, kind: str) -> None:
    """Features with their format version and kind on every row."""
    df.withColumn("format_version", F.lit(FORMAT_VERSION)).withColumn("format_kind", F.lit(kind)).write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Features of one kind; a version of 0 or above the known one, or another kind, is an error when the row is read."""
    df = spark.read.parquet(path)
    if "format_version" not in df.columns or "format_kind" not in df.columns:
        raise ValueError(f"{path} has no format columns")
    fine = F.col("format_version").between(1, FORMAT_VERSION) & (F.col("format_kind") == kind)
    checked = df.withColumn("format_version", F.when(fine, F.col("format_version")).otherwise(F.raise_error(F.lit(f"not a {kind} table of a known version"))))
    return checked
