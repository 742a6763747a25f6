"""Labels and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that a redacted name keeps.
KNOWN_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "ts", "m4v", "wmv", "flv")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def redacted(path: Column, salt: str) -> Column:
    """A token for logs: 16 hex digits of a salted hash, and the extension if it is a known one."""
    ext = extension(path)
    return F.concat(F.substring(F.sha2(F.concat(F.lit(salt), path), 256), 1, 16), F.lit("."), F.when(ext.isin(*KNOWN_EXTENSIONS), ext).otherwise("bin"))


# Units of sizes, and labels of trust levels.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
TRUST_CLASS = {"EXACT": "exact", "VERY_LIKELY": "very-likely", "POSSIBLE": "possible"}
TRUST_LABEL = {"EXACT": "완전 동일", "VERY_LIKELY": "유사 (재인코딩)", "POSSIBLE": "유사 (추정)"}
TRUST_SHORT_LABEL = {"EXACT": "완전 동일", "VERY_LIKELY": "재인코딩", "POSSIBLE": "추정"}


def _tenths(value: Column) -> Column:
    """One decimal, halves up."""
    return F.format_string("%.1f", F.floor(value * 10 + F.lit(0.5)) / F.lit(10.0))


def size_label(size: Column) -> Column:
    """Bytes in the largest unit that gives at least one, with one decimal but for plain bytes; 0 B for none."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(SIZE_UNITS[1:], 1):
        out = F.when(size >= 1024**k, F.concat(_tenths(size / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size > 0, out).otherwise("0 B")


def duration_label(ms: Column) -> Column:
    """h:mm:ss or m:ss of milliseconds rounded to seconds."""
    s = F.greatest(_div(ms + 500, 1000), F.lit(0))
    minutes = _div(s, 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", _div(s, 3600), minutes % 60, s % 60)).otherwise(F.format_string("%d:%02d", minutes, s % 60))


def resolution_label(width: Column, height: Column) -> Column:
    """By the long edge for 4K and 1440p, else by the short edge; null unless both are known."""
    long_, short = F.greatest(width, height), F.least(width, height)
    named = F.when(long_ >= 3840, "4K").when(long_ >= 2560, "1440p").when(short >= 1080, "1080p").when(short >= 720, "720p").when(short >= 480, "480p")
    return F.when(width.isNotNull() & height.isNotNull(), named.otherwise(F.concat(short.cast("string"), F.lit("p"))))


def bitrate_label(bps: Column) -> Column:
    """Mbps with one decimal; a dash where there is none."""
    return F.when(bps > 0, F.concat(_tenths(bps / F.lit(1_000_000.0)), F.lit(" Mbps"))).otherwise("—")


def named(value: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def relative_activity(last_ms: Column, now_ms: Column) -> Column:
    """How long ago something happened; null if it never did."""
    s = F.greatest(_div(now_ms - last_ms, 1000), F.lit(0))
    ago = lambda n, unit: F.concat(_div(s, n).cast("string"), F.lit(unit))
    out = F.when(s < 5, "방금").when(s < 60, ago(1, "초 전")).when(s < 3600, ago(60, "분 전")).when(s < 86_400, ago(3600, "시간 전")).otherwise(ago(86_400, "일 전"))
    return F.when(last_ms.isNotNull(), out)


def backoff(attempt: Column, base: int, most: int) -> Column:
    """base * 2^attempt, limited; the first attempt is 0."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(40))), F.lit(most)).cast("long")


def truncated(message: Column, most: int = 2_000) -> Column:
    return F.substring(message, 1, most)
