"""Which copy of a group is the best one, under six policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("archival", "space_saving", "compatible", "max_quality", "min_size", "max_resolution")
# How much a codec gets out of a bit, in hundredths, for the policies that weigh it.
CODEC_EFFICIENCY_X100 = {"av1": 350, "hevc": 300, "h265": 300, "vp9": 260, "h264": 200}
# Tools whose tags show that a file was encoded again.
ENCODER_MARKS = ("handbrake", "svt-av1", "svtav1", "x264", "x265", "xvid", "divx", "lavc", "ffmpeg")
_TOP = "18446744073709551615"


def codec_efficiency(codec: Column, mode: str) -> Column:
    if mode not in ("space_saving", "max_quality"):
        return F.lit(100)
    out = F.lit(100)
    for name, value in CODEC_EFFICIENCY_X100.items():
        out = F.when(codec == name, value).otherwise(out)
    return out


def _scaled(x: Column, by: int) -> Column:
    return F.coalesce(F.floor(F.greatest(x * F.lit(float(by)), F.lit(0.0))).cast("long"), F.lit(0).cast("long"))


def quality(mode: str) -> list[Column]:
    """The parts of a file's score, most important first."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    small = mode == "min_size"
    none = F.lit(0).cast("long")
    both = F.col("width_px").isNotNull() & F.col("height_px").isNotNull()
    pixels = F.when(both, F.col("width_px").cast("long") * F.col("height_px")).otherwise(none)
    if mode in ("max_quality", "max_resolution"):
        encoder = F.lit(1).cast("long")
    elif mode == "compatible":
        encoder = (F.when(F.col("codec") == "h264", 5).otherwise(0) + F.when(F.lower("container").contains("mp4"), 5).otherwise(0)).cast("long")
    else:
        again = F.lit(False)
        for m in ENCODER_MARKS:
            again = again | F.lower("encoder_tags").contains(m)
        encoder = F.when(again, 0).otherwise(1).cast("long")
    rate = F.greatest(F.coalesce("bitrate_bps", F.lit(0)), F.lit(0)).cast("decimal(38,0)") * codec_efficiency(F.col("codec"), mode)
    size = F.greatest(F.col("size_bytes"), F.lit(0)).cast("decimal(20,0)")
    parts = {
        "pixels": none if small else pixels, "encoder_score": none if small else encoder, "laplacian_x1000": none if small else _scaled(F.col("laplacian_variance"), 1000),
        "energy_x1000": none if small else _scaled(F.col("dct_energy"), 1000), "bpp_scaled": none if small else _scaled(F.col("bpp"), 1_000_000),
        "effective_bitrate": none if small else F.least(rate, F.lit(2**63 - 1)).cast("long"), "size_score": F.lit(_TOP).cast("decimal(20,0)") - size if small else size,
    }
    return [c.alias(k) for k, c in parts.items()]


_PARTS = ("pixels", "encoder_score", "laplacian_x1000", "energy_x1000", "bpp_scaled", "effective_bitrate", "size_score")


def best_copies(members: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """(group_id, best_id) over active members; the smallest id among equals.

    max over a struct is combined before the shuffle, so a large group costs no single task.
    """
    scored = files.where("deleted_at is null").select(F.col("id").alias("file_id"), *quality(mode))
    m = members.select("group_id", "file_id").join(scored, "file_id")
    return m.groupBy("group_id").agg((-F.max(F.struct(*_PARTS, (-F.col("file_id")).alias("neg")))["neg"]).alias("best_id"))


def assign_best(groups: DataFrame, members: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """(group_id, best_id, outcome): unchanged, updated or empty (no active member; best is null)."""
    best = groups.select("group_id", "best_file_id").join(best_copies(members, files, mode), "group_id", "left")
    outcome = F.when(F.col("best_id").isNull(), "empty").when(F.col("best_id").eqNullSafe(F.col("best_file_id")), "unchanged").otherwise("updated")
    return best.select("group_id", "best_id", outcome.alias("outcome"))


def scalar_score() -> Column:
    """The parts as one number, limited to 64 bits unsigned."""
    d = lambda c: F.col(c).cast("decimal(30,0)")
    total = d("pixels") * 10_000_000 + d("encoder_score") * 1_000_000 + d("laplacian_x1000") * 100 + d("energy_x1000") * 10
    total = total + F.floor(d("bpp_scaled") / 1000) + F.floor(d("effective_bitrate") / 1000) + F.floor(d("size_score") / 1_000_000)
    return F.least(total.cast("decimal(38,0)"), F.lit(_TOP).cast("decimal(38,0)")).cast("decimal(20,0)")


def client_order(mode: str) -> list[Column]:
    """The simpler order of the client, best first."""
    eff = F.lit(100.0)
    for name, value in CODEC_EFFICIENCY_X100.items():
        eff = F.when(F.lower("codec").contains(name), float(value)).otherwise(eff)
    pixels = F.coalesce(F.col("width_px").cast("long") * F.col("height_px"), F.lit(0))
    rate = F.coalesce("bitrate_bps", F.lit(0))
    fits = F.when(F.lower("codec").contains("h264"), 5).otherwise(0) + F.when(F.lower("container").contains("mp4"), 5).otherwise(0)
    orders = {
        "min_size": [F.asc("size_bytes")], "compatible": [F.desc(fits), F.desc(pixels), F.desc(rate)], "max_resolution": [F.desc(pixels), F.desc(rate), F.desc("size_bytes")],
        "space_saving": [F.desc(pixels), F.desc(rate * (eff / 100)), F.desc("size_bytes")], "max_quality": [F.desc(pixels), F.desc(rate * (eff / 100)), F.desc("size_bytes")],
        "archival": [F.desc(pixels), F.desc(rate), F.desc("size_bytes")],
    }
    return [*orders[mode], F.asc("file_id")]


def members_by_quality(members: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """(group_id, file_id, place) of members, best first. A group's order is its result; groups are the unit of work."""
    m = members.select("group_id", "file_id").join(files.select(F.col("id").alias("file_id"), "codec", "container", "width_px", "height_px", "bitrate_bps", "size_bytes"), "file_id")
    return m.select("group_id", "file_id", F.row_number().over(Window.partitionBy("group_id").orderBy(*client_order(mode))).cast("long").alias("place"))
