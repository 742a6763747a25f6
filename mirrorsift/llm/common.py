"""What several operators share: batches of whole texts, word and shingle hashes, cut lineage, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these; bytes.split() without arguments splits at just these six.
WORD_GAPS = " \t\n\x0b\x0c\r"
#: Names under which workers keep something between tasks.
_LEFT = {"_packing_memory"}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df hasn't got."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- batches


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few bytes of text: memory stays bounded however long the texts are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes + 64)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def give_back() -> None:
    """Memory that this process has freed but holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable, kept: tuple[str, ...] = ()) -> Callable:
    """run (a function on an iterator of batches) in a reused worker: what earlier tasks left there is dropped first but for
    what is named in kept, and freed memory is given back at the end, so that a worker that waits is small."""

    @functools.wraps(run)
    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if [sys.modules.pop(name) for name in _LEFT - set(kept) if name in sys.modules]:
            gc.collect()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_


def split_words(texts: list[str | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, one after another, and each text's number of words. Only A-Z are lower-cased."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            own = (raw.lower() if lower else raw).split()
            counts[k] = len(own)
            words += own
    return words, counts


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, equal in every process."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one run of word hashes, in order."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out *= _MULTIPLIER
        out += hashes[k : k + count]
    return mix(out)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; with fewer words the whole sequence counts as one."""
    words, counts = split_words(texts, lower=True)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, n)
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends, counts, strict=True):
        begin = end - count
        if count >= n:
            out.append(np.unique(grams[begin : end - n + 1]))
        elif count:
            short = np.uint64(count)
            for h in hashes[begin:end]:
                short = np.uint64((int(short) * int(_MULTIPLIER) + int(h)) & (2**64 - 1))
            out.append(mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


# ---------------------------------------------------------------- cut lineage


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/mirrorsift-checkpoints"
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a kept table that nothing will read again."""
    path = getattr(df, "_kept_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star steps, so the number of rounds grows with the logarithm of
    the graph; only counts reach the driver.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.select(F.count("*"), mark).first()
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        after = keep(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        )
        forget(now)
        now, before = after, seen
        seen = now.select(F.count("*"), mark).first()
        if seen == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
