"""Bit and bucket expressions over 64-bit hashes held as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def phash_of_coefficients(column: str) -> Column:
    """Bit 63 - i is set where coefficient i of 64 is above their median; all zero but the first gives 0."""
    v = F.col(column).cast("array<double>")
    ordered = F.sort_array(v)
    median = (F.element_at(ordered, BITS // 2) + F.element_at(ordered, BITS // 2 + 1)) / 2
    bits = F.transform(v, lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(BITS - 1) - i).cast("int"))).otherwise(F.lit(0).cast("long")))
    flat = ~F.exists(F.slice(v, 2, BITS), lambda x: F.abs(x) >= 1e-6)
    return F.when(flat, F.lit(0).cast("long")).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(phash: Column, index: Column | int, bands: int) -> Column:
    """Band index (from the low end) of a hash cut into equal bands."""
    width = BITS // bands
    index = F.lit(index) if isinstance(index, int) else index
    mask = -1 if width == BITS else (1 << width) - 1
    return F.call_function("shiftrightunsigned", phash, (index * width).cast("int")).bitwiseAND(F.lit(mask).cast("long"))


def floor_bucket(value: Column, width: int) -> Column:
    """Floor division that rounds towards minus infinity."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("long")


def similarity_x1000(distance: Column) -> Column:
    """(64 - min(d, 64)) * 1000 / 64 without remainder."""
    return F.floor((F.lit(BITS) - F.least(distance, F.lit(BITS))) * 1000 / BITS).cast("long")


def spread_buckets(offset: Column, width: int = 2_500, reach: int = 2) -> Column:
    """The buckets within reach of an offset's own one."""
    own = floor_bucket(offset, width)
    return F.sequence(own - reach, own + reach)
