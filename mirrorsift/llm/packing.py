"""Best-fit packing of token sequences by exact-complement hashing.

Only the histogram of piece lengths (at most one count for each length up to the capacity) decides the plan.
Lengths are taken longest first; a gap is looked up among single lengths, sums of two and sums of three, and
the combinations that fill it exactly are consumed as often as their availability counts allow. What finds no
exact filling is placed by best fit. The plan is run-length coded: a pattern of lengths and how many sequences
have it. Pieces get a rank within their length, which the plan turns into sequence and offset.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, slices, tidy

CAPACITY = 4096
#: Chunks whose ids a worker remembers, and characters of them; beyond that it starts anew.
MOST_WORDS, MOST_CHARS = 300_000, 6_000_000
#: Marks that are one piece where they end a chunk; the pre-tokenizer's endings begin with a mark that isn't among them.
MARKS = ".,;:!?()[]{}\"%$#&*|<>+-=/_~^@"
#: Characters of a chunk from which on it isn't remembered.
LONG_CHUNK = 256
#: Bytes of text that a worker encodes at once; a longer text is encoded as a whole.
SLICE_BYTES = 1_000_000


class Encoder:
    """Ids by chunk: a text's parts between blanks and line feeds.

    The tokenizer drops white space and never looks across it, so a chunk's ids don't depend on its
    neighbours and are remembered. For chunks of Latin letters, digits and marks (where NFC changes nothing)
    the pieces that its pre-tokenizer makes go straight to its model; all other chunks go through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memory = Memory(self.ids)
        self.marked = True  # whether a token that the tokenizer takes before all others may be in a chunk
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n.get("type") for n in (settings.get("normalizer") or {}).get("normalizers") or []]
        # the short way holds for a pre-tokenizer that splits by one pattern and then maps bytes
        self.short = normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and bool(steps[0].get("invert"))
        self.plain = regex.compile(r"[!-~\u00A1-\u00AC\u00AE-\u012F\u0131-\u017F]+")
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]) if self.short else None
        self.model = self.whole.model
        self.special = [x["content"] for x in settings.get("added_tokens", [])]
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.alphabet = [chr(b) if b in own else chr(next(others)) for b in range(256)]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)

    @property
    def held(self) -> int:
        """Characters of what is remembered."""
        return self.memory.held

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        return self.pack([t.id for t in self.model.tokenize(plain)])

    def ids(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't remembered."""
        short = chunk.isprintable() if chunk.isascii() else self.plain.fullmatch(chunk)
        if not short or (self.marked and any(x in chunk for x in self.special)):
            return self.pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        low = chunk.lower()
        if low.isalpha():
            return self._piece(low) if low == chunk else self.memory[low]
        core = low.rstrip(MARKS)
        if core.isalpha():
            return self.memory[core] + self.memory[low[len(core) :]]
        pieces = self.cut.findall(low)
        return self._piece(low) if pieces == [chunk] else b"".join([self.memory[x] for x in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if not self.short:  # a tokenizer that may look across blanks gets the text as it is
                out.append(self.pack(self.whole.encode(text, add_special_tokens=False).ids))
                continue
            if len(self.memory) > MOST_WORDS or self.memory.held > MOST_CHARS:
                self.memory = Memory(self.ids)
            self.marked = any(x in text for x in self.special)
            out.append(b"".join(map(self.memory.__getitem__, text.replace("\n", " ").split(" "))))
        return out


class Memory(dict):
    """Ids by chunk, made when first asked for; those of long chunks aren't held."""

    def __init__(self, make):
        super().__init__({"": b""})
        self.make, self.held = make, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
            self.held += len(chunk)
        return ids


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks of a reused worker."""
    home = sys.modules.setdefault("_packing_memory", types.ModuleType("_packing_memory"))
    found = home.__dict__.get("found")
    if not found or found[0] != path:
        found = home.found = (path, Encoder(path))
    return found[1]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            columns: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), _encoder(path).encode(batch.column("text").to_pylist()), strict=True):
                raw += end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    for column, value in zip(columns, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            types_ = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# ---------------------------------------------------------------- the plan


class _Stock:
    """How many pieces of each length are left, and an index from sums to the lengths that make them.

    Single sums are the counts themselves. Pair sums are a table sorted by sum, largest first length first, with the place
    of each sum's first entry; entries whose pieces are used up are passed by. A triple sum is found as a
    length and the pair sum that completes it. The table has at most capacity^2 / 4 entries, whatever the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] += count
        lengths = np.flatnonzero(self.left)
        firsts, seconds = [], []
        for a in lengths[::-1]:
            some = lengths[(lengths <= a) & (lengths <= capacity - a)]
            firsts.append(np.full(len(some), a, np.int32))
            seconds.append(some.astype(np.int32))
        first, second = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (firsts, seconds))
        order = np.argsort(first + second, kind="stable")
        self.first, self.second = first[order], second[order]
        self.begin = np.searchsorted((first + second)[order], np.arange(capacity + 2))
        self.end = self.begin[1:].copy()

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The two lengths with the largest first one (up to most) that sum to gap."""
        first, second = self.first[self.begin[gap] : self.end[gap]], self.second[self.begin[gap] : self.end[gap]]
        able = (self.left[first] > 0) & (self.left[second] > 0) & ((first != second) | (self.left[first] > 1))
        if most is not None:
            able &= first <= most
        at = int(able.argmax()) if len(able) else 0
        return (int(first[at]), int(second[at])) if len(able) and able[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.left[1 : gap - 1])[::-1] + 1:
            if 3 * int(a) < gap:
                break
            self.left[a] -= 1
            two = self.pair(gap - int(a), int(a))
            self.left[a] += 1
            if two:
                return (int(a), *two)
        return None

    def take(self, pattern: tuple[int, ...], most: int | None = None) -> int:
        """Use the pattern as often as the counts allow."""
        need: dict[int, int] = {}
        for length in pattern:
            need[length] = need.get(length, 0) + 1
        times = min(int(self.left[length]) // n for length, n in need.items())
        times = times if most is None else min(times, most)
        for length, n in need.items():
            self.left[length] -= n * times
        return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that have it; all pieces are placed.

    Exact fillings are consumed longest piece first. Filling exactly may spend the short pieces that later gaps need: so
    the plan with the fewest sequences wins among those that stop filling exactly at some length and place
    the rest by best fit; one of them is best fit alone.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = None
    for stop in (0, capacity // 3, capacity // 2, 3 * capacity // 4, capacity):
        found = _filled(counts, capacity, stop)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= least:
            break
    return best


def _filled(counts: dict[int, int], capacity: int, stop: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fillings of gaps beside pieces longer than stop, then best fit."""
    stock = _Stock(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}
    for length in range(capacity, stop, -1):
        while stock.left[length]:
            gap = capacity - length
            if not gap:
                out.append(((length,), stock.take((length,))))
                continue
            stock.left[length] -= 1
            filling = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            stock.left[length] += 1
            if not filling:
                rest[length] = int(stock.left[length])
                stock.left[length] = 0
                break
            out.append(((length, *filling), stock.take((length, *filling))))
    rest.update({int(length): int(stock.left[length]) for length in np.flatnonzero(stock.left)})
    return out + _best_fit(rest, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: bins of one kind are filled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        count = counts[length]
        while count:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                pattern, bins = (length,), count
                # a bin takes this length again as long as nothing fits better
                fit = capacity // length
                if fit > 1 and count >= fit:
                    pattern, bins = (length,) * fit, count // fit
                elif fit > 1:
                    pattern, bins = (length,) * count, 1
                used = len(pattern) * bins
            else:
                base, there = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                again = min(gap // length, max(1, count // there))
                bins = min(there, count // again)
                if there > bins:
                    open_.setdefault(gap, []).append((base, there - bins))
                pattern, used = base + (length,) * again, again * bins
            count -= used
            open_.setdefault(capacity - sum(pattern), []).append((pattern, bins))
    return [x for own in open_.values() for x in own]


def _segments(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the first rank, the first sequence and the offset there."""
    nexts: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            begin = nexts.get(length, 0)
            rows.append((length, begin, sequence, offset))
            nexts[length] = begin + times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {name: table[:, k].copy() for k, name in enumerate(("length", "rank", "sequence", "offset"))}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for own in np.unique(length):
                low, high = np.searchsorted(seg["length"], [own, own + 1])
                here = np.flatnonzero(length == own)
                at[here] = low + np.searchsorted(seg["rank"][low:high], rank[here], side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            placed = [pa.array(seg["sequence"][at] + rank - seg["rank"][at]), pa.array(seg["offset"][at])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + placed, names=[*names, "sequence_id", "offset"])

    return run


def ranked(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """df with rank, gapless from 0 within each key, without one task for a frequent key.

    Rows are numbered within (key, salt); the counts of the salts before are added. order must tell rows apart
    only as far as equal rows may swap ranks.
    """
    cells = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    spec = ", ".join(order)
    numbered = cells.selectExpr("*", f"row_number() over (partition by {key}, _salt order by {spec}) - 1 as _own")
    sizes = cells.groupBy(key, "_salt").agg(F.count("*").alias("_size"))
    before = sizes.selectExpr(key, "_salt", f"sum(_size) over (partition by {key} order by _salt) - _size as _before")
    return numbered.join(before, [key, "_salt"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs (doc_id, text).

    A document's ids are those of the tokenizer, without special tokens added, and then end_id; null and empty
    texts have end_id alone. Documents longer than capacity are cut into pieces of it; the last may be shorter.
    Repeated rows are packed like others. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = keep(docs.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id), ("_packing_memory",)), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    shared = spark.sparkContext.broadcast(_segments(plan(counts, capacity)))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], salts)
    return numbered.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
