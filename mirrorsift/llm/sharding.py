"""Sharding: minimax contiguous partition of groups of equal texts, with DataFrame functions only.

Groups are ordered by their texts' 64-bit hash. The smallest feasible shard capacity is found by binary
search with greedy checks; under it the cuts go where shards come out about even. The driver never sees groups but cells: hash ranges with the sum of their sizes, at
first 2^16 of equal width. A cell that the decision depends on is cut into 2^12 smaller ones by another query,
until every such cell holds one group; so the result is that over single groups, while the number of
cells on the driver stays bounded.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep

#: Bits of the hash that number the first cells, and that each later cut adds.
FIRST_BITS, MORE_BITS = 16, 12
#: Cells that rows are numbered in: hash ranges of the whole, times salts.
NUMBER_BITS, NUMBER_SALTS = 8, 64


@dataclass(frozen=True)
class Cell:
    begin: int  # smallest possible hash, as an unsigned number
    bits: int  # leading bits that are the same in the cell
    size: int
    groups: int


def greedy(sizes: list[int], sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where shards end (cell numbers, exclusive) if each takes as many whole cells as fit; None if cells are left."""
    ends, at = [], 0
    for _ in range(shards):
        base = sums[at]
        at = bisect_right(sums, base + capacity, lo=at) - 1
        ends.append(at)
        if at == len(sizes):
            return ends + [at] * (shards - len(ends))
    return None


def minimax(sizes: list[int], shards: int, least: int = 0) -> int:
    """The smallest capacity for which the greedy check places all cells; the answer isn't below least."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    low, high = max([least, -(-sums[-1] // shards), *sizes]), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_ends(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Where shards end if each stays within capacity and ends as near as it can to an equal part of what is left.

    capacity must be feasible. The earliest end of a shard is the one from which the later shards still hold the rest.
    """
    earliest = [len(sums) - 1]
    for _ in range(shards - 1):
        earliest.append(bisect_left(sums, sums[earliest[-1]] - capacity))
    ends, at = [], 0
    for k, low in enumerate(reversed(earliest)):
        high = bisect_right(sums, sums[at] + capacity, lo=at) - 1
        goal = sums[at] + (sums[-1] - sums[at]) / (shards - k)
        near = bisect_left(sums, goal, lo=at)
        near = min(near, len(sums) - 1)
        if near - 1 > at and goal - sums[near - 1] <= sums[near] - goal:
            near -= 1
        at = max(min(near, high), low, at)
        ends.append(at)
    return ends


def _open_cells(cells: list[Cell], shards: int, least: int) -> tuple[int, list[int], list[Cell]]:
    """Capacity over whole cells, its ends, and the cells of several groups that a smaller capacity could cut."""
    sizes = [c.size for c in cells]
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    capacity = minimax(sizes, shards)
    ends = greedy(sizes, sums, capacity, shards)
    # were cells of several groups divisible at will, this would do; no single group may be larger
    low = max(least, -(-sums[-1] // shards))
    doubt: dict[int, Cell] = {}
    if low < capacity:
        near = far = 0  # where the shard's begin may be: the earliest with low, the latest with capacity - 1
        for _ in range(shards):
            a = bisect_right(sums, near + low) - 1
            b = bisect_right(sums, far + capacity - 1) - 1
            for k in range(a, min(b, len(cells) - 1) + 1):
                if cells[k].groups > 1:
                    doubt[k] = cells[k]
            near = sums[a] if a < len(cells) else sums[-1]
            far = min(far + capacity - 1, sums[-1])
    return capacity, ends, list(doubt.values())


def _cells_of(groups: DataFrame, bits: int, within: list[Cell] | None) -> list[Cell]:
    """Non-empty cells with the given number of leading bits, inside the given wider cells."""
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(2**63)))  # order of unsigned numbers as that of signed ones
    cell = F.shiftright(unsigned, 64 - bits)
    if within is not None:
        wide = within[0].bits
        names = [(c.begin >> (64 - wide)) - (1 << (wide - 1)) for c in within]
        groups = groups.where(F.shiftright(unsigned, 64 - wide).isin(names))
    rows = groups.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
    return [Cell((r["cell"] + (1 << (bits - 1))) << (64 - bits), bits, r["size"], r["groups"]) for r in rows]


def partition_groups(groups: DataFrame, shards: int, most_open: int = 64) -> tuple[int, list[int]]:
    """(capacity, bounds): the smallest feasible capacity over groups (hash, size), and the hash, as an unsigned
    number, at which each later shard begins (2^64: the shard is empty)."""
    cells = sorted(_cells_of(groups, FIRST_BITS, None), key=lambda c: c.begin)
    largest = groups.agg(F.max("size")).first()[0] or 0
    while True:
        capacity, ends, doubt = _open_cells(cells, shards, largest)
        cut = [c for c in doubt if c.bits < 64]
        if not cut:
            break
        widest = min(c.bits for c in cut)
        cut = sorted((c for c in cut if c.bits == widest), key=lambda c: -c.size)[:most_open]
        finer = _cells_of(groups, min(64, widest + MORE_BITS), cut)
        gone = set(cut)
        cells = sorted([c for c in cells if c not in gone] + finer, key=lambda c: c.begin)
    sums = [0]
    for c in cells:
        sums.append(sums[-1] + c.size)
    ends = even_ends(sums, capacity, shards)
    return capacity, [cells[e].begin if e < len(cells) else 2**64 for e in ends[:-1]]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 1. Law "bytes": the largest shard is as small as contiguous
    runs of whole groups in hash order allow, and within that the shards are about even. Rows with equal texts are one group and share a shard (null and
    empty texts as well); texts that share a 64-bit hash count as one group. slot numbers a shard's rows from 0.
    grown_shard is null under this law. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
    )
    rows = keep(rows)
    groups = keep(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    capacity, bounds = partition_groups(groups, shards)
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    shard = F.lit(0)
    for bound in bounds:
        if bound < 2**64:
            shard = shard + F.when(unsigned >= F.lit(bound - 2**63), 1).otherwise(0)
    cells = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright(unsigned, 64 - NUMBER_BITS)).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(NUMBER_SALTS)))
    # slots: a number within the cell after the rows of the cells before; there are few cells, of even size
    counts = cells.groupBy("shard", "cell", "salt").agg(F.count("*").alias("rows"))
    before = counts.selectExpr("shard", "cell", "salt", "sum(rows) over (partition by shard order by cell, salt) - rows as before")
    own = cells.selectExpr("*", "row_number() over (partition by shard, cell, salt order by hash, doc_id) - 1 as own")
    out = own.join(before, ["shard", "cell", "salt"])
    out = out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    forget(groups)
    return out
