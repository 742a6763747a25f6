"""Features of gray frames and scene sequences.

Frames are decoded images: (file_id, ts_ms, w, h, pixels). Array mathematics over pixels runs on Arrow batches in numpy;
sequence features are array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.functions.bits import BITS, hamming

GRID, LOW = 32, 8
SCENE_STEP_BITS = 4
GRID_MS = 2_500
BAR_LIMIT = 24


def whole_frame(pixels: bytes, w: int, h: int) -> np.ndarray:
    """Pixels as rows; missing ones are 0, further ones are left out."""
    flat = np.frombuffer(pixels, np.uint8)[: w * h]
    if len(flat) < w * h:
        flat = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)])
    return flat.reshape(h, w)


def shrink(frame: np.ndarray) -> np.ndarray:
    """Means over the cells of a 32 x 32 grid, at least a pixel each."""
    h, w = frame.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = frame.astype(np.int64).cumsum(0).cumsum(1)
    cells = np.arange(GRID)
    y0, x0 = cells * h // GRID, cells * w // GRID
    y1 = np.minimum(np.maximum((cells + 1) * h // GRID, y0 + 1), h)
    x1 = np.minimum(np.maximum((cells + 1) * w // GRID, x0 + 1), w)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return total / np.outer(y1 - y0, x1 - x0)


_BASIS = np.cos((2 * np.arange(GRID)[:, None] + 1) * np.arange(GRID)[None, :] * np.pi / (2 * GRID))


def dct(grid: np.ndarray) -> np.ndarray:
    """Unscaled two-dimensional cosine transform."""
    return _BASIS.T @ grid @ _BASIS


def phash_of_grid(grid: np.ndarray) -> int:
    """The 64 low coefficients against their median, as a signed number; 0 for a grid without structure."""
    low = dct(grid)[:LOW, :LOW].ravel()
    if (np.abs(low[1:]) < 1e-6).all():
        return 0
    bits = low > np.median(low)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def energy_of_grid(grid: np.ndarray) -> float:
    """Sum of squares of the coefficients outside the low block."""
    c = dct(grid) ** 2
    return float(c.sum() - c[:LOW, :LOW].sum())


def laplacian_variance(frame: np.ndarray) -> float:
    if min(frame.shape) < 3:
        return 0.0
    f = frame.astype(np.float64)
    lap = f[1:-1, :-2] + f[1:-1, 2:] + f[:-2, 1:-1] + f[2:, 1:-1] - 4 * f[1:-1, 1:-1]
    return float(((lap - lap.mean()) ** 2).mean())


def trim_borders(frame: np.ndarray, limit: int = BAR_LIMIT) -> np.ndarray:
    """Without rows and columns at the edges that are dark on average; a frame that is dark all over stays."""
    h, w = frame.shape
    rows = np.flatnonzero(frame.sum(1, dtype=np.int64) > limit * w)
    if not len(rows):
        return frame
    columns = np.flatnonzero(frame.sum(0, dtype=np.int64) > limit * h)
    x0, x1 = (columns[0], columns[-1] + 1) if len(columns) else (w, w)
    out = frame[rows[0] : rows[-1] + 1, x0:x1]
    return out if out.size else frame


_FRAME = "file_id long, ts_ms long, phash long, laplacian double, energy double, grid array<double>, w2 int, h2 int, error string"


def frame_features(frames: DataFrame, trim: bool = False) -> DataFrame:
    """One row of features for each frame; a frame that can't be read has an error and no features."""

    def one(pixels, w, h) -> tuple:
        if pixels is None or pd.isna(w) or pd.isna(h) or w <= 0 or h <= 0:
            return None, None, None, None, None, None, "empty frame"
        try:
            frame = whole_frame(bytes(pixels), int(w), int(h))
            frame = trim_borders(frame) if trim else frame
            grid = shrink(frame)
            return phash_of_grid(grid), laplacian_variance(frame), energy_of_grid(grid), grid.ravel().tolist(), frame.shape[1], frame.shape[0], None
        except (ValueError, MemoryError) as e:
            return None, None, None, None, None, None, str(e)[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):  # few frames in memory at once
                part = pdf.iloc[at : at + 64]
                rows = [(f, t, *one(p, w, h)) for f, t, p, w, h in zip(part["file_id"], part["ts_ms"], part["pixels"], part["w"], part["h"], strict=True)]
                out = pd.DataFrame(rows, columns=["file_id", "ts_ms", "phash", "laplacian", "energy", "grid", "w2", "h2", "error"])
                yield out.astype({"phash": "Int64", "w2": "Int32", "h2": "Int32"})

    return frames.select("file_id", "ts_ms", "w", "h", "pixels").mapInPandas(run, _FRAME)


def file_features(features: DataFrame) -> DataFrame:
    """(file_id, frames, global_phash, laplacian_variance, dct_energy) over the mean grid of a file's frames; 0 without frames.

    Cell sums combine before the shuffle: a file's frames are never collected.
    """
    fine = features.where("error is null")
    cells = fine.select("file_id", F.posexplode("grid").alias("cell", "x")).groupBy("file_id", "cell").agg(F.avg("x").alias("x"))
    grids = cells.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "x"))), lambda c: c["x"]).alias("grid"))  # 1024 cells each

    @F.pandas_udf("long")
    def phash(grid: pd.Series) -> pd.Series:
        return grid.map(lambda g: phash_of_grid(np.asarray(g, float).reshape(GRID, GRID)))

    means = fine.groupBy("file_id").agg(F.count("*").alias("frames"), F.avg("laplacian").alias("laplacian_variance"), F.avg("energy").alias("dct_energy"))
    ids = features.select("file_id").distinct()
    out = ids.join(grids.withColumn("global_phash", phash("grid")).drop("grid"), "file_id", "left").join(means, "file_id", "left")
    return out.select("file_id", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("global_phash", F.lit(0)).alias("global_phash"), "laplacian_variance", "dct_energy")


# ---------------------------------------------------------------- sequences


def kept_scenes(sequences: DataFrame, step: int = SCENE_STEP_BITS) -> DataFrame:
    """(file_id, scenes): the first scene and each one that differs from the last kept one by more than step bits."""
    none = F.expr("cast(array() as array<struct<ts_ms: bigint, phash: bigint>>)")

    def fold(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)["phash"]
        new = (F.size(acc) == 0) | (hamming(last, x["phash"]) > step)
        return F.when(new, F.concat(acc, F.array(x))).otherwise(acc)

    return sequences.select("file_id", F.aggregate("scenes", none, fold).alias("scenes"))


def temporal_flow(sequences: DataFrame) -> DataFrame:
    """(file_id, flow): bits that differ between neighbours."""
    n = F.size("scenes")
    flow = F.zip_with(F.slice("scenes", 1, F.greatest(n - 1, F.lit(0))), F.slice("scenes", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: hamming(a["phash"], b["phash"]))
    return sequences.select("file_id", F.when(n > 1, flow).otherwise(F.expr("cast(array() as array<int>)")).alias("flow"))


def sequence_similarity(a: Column, b: Column) -> Column:
    """Mean likeness of scenes at equal places times the ratio of lengths; 1 for two empty sequences, 0 for one."""
    na, nb = F.size(a), F.size(b)
    low = F.least(na, nb)
    acc = F.aggregate(F.zip_with(F.slice(a, F.lit(1), low), F.slice(b, F.lit(1), low), lambda x, y: (F.lit(BITS) - hamming(x["phash"], y["phash"])) / F.lit(64.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when((na == 0) & (nb == 0), 1.0).when(low == 0, 0.0).otherwise(acc / low * (low / F.greatest(na, nb)))


def sparse_plan(keyframes: DataFrame, budget: int, step_ms: int = GRID_MS) -> DataFrame:
    """(file_id, steps) of keyframes (file_id, times in order): at least step_ms after the last taken one, budget at most."""
    def fold(acc: Column, x: Column) -> Column:
        take = (F.size(acc) == 0) | ((x - F.element_at(acc, -1)) >= step_ms)
        return F.when(take & (F.size(acc) < budget), F.concat(acc, F.array(x))).otherwise(acc)

    return keyframes.select("file_id", F.aggregate("times", F.expr("cast(array() as array<bigint>)"), fold).alias("steps"))


def fallback_grid(duration_ms: Column, cap: int, step_ms: int = GRID_MS) -> Column:
    """Times of an even grid over a duration, cap at most: with more, every so many points."""
    full = F.ceil(duration_ms / step_ms)
    stride = F.when(full <= cap, 1).otherwise(F.ceil(full / cap))
    times = F.slice(F.sequence(F.lit(0).cast("long"), F.greatest(duration_ms - 1, F.lit(0)), (stride * step_ms).cast("long")), 1, cap)
    return F.when((duration_ms > 0) & F.lit(cap > 0), times).otherwise(F.expr("cast(array() as array<bigint>)"))


def decode_health(frames: Column, grid_points: Column, fold_ms: Column, slow_ms: int = 1_000, factor: int = 4) -> list[Column]:
    """Milliseconds for a frame, and whether decoding was slow or decoded far more frames than asked."""
    per = F.when(frames > 0, F.floor(fold_ms / frames)).otherwise(0).cast("long")
    return [per.alias("ms_per_frame"), ((frames > 0) & (per > slow_ms)).alias("slow"), ((grid_points > 0) & (frames > grid_points * factor)).alias("over_decode")]


def fit_within(width: Column, height: Column, most: int = 320) -> tuple[Column, Column]:
    """Sides scaled down to at most most, rounded, at least 1."""
    top = F.greatest(width, height)
    fit = lambda x: F.when(top <= most, x).otherwise(F.greatest(F.floor(x * F.lit(float(most)) / top + 0.5), F.lit(1))).cast("long")
    return fit(width), fit(height)
