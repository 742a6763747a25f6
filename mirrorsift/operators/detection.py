"""Duplicate detection: exact groups, banded and multi-index Hamming joins, sequence alignment, ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorsift.functions.bits import BITS, band, hamming, similarity_x1000
from mirrorsift.operators import blocks as B

VOTE_BUCKET_MS = 2_500
MATCH_TOLERANCE_MS = 5_000
LEAST_VOTES = 2


@dataclass(frozen=True)
class BandParams:
    """Bands of a 64-bit hash and the largest distance of a match."""

    bands: int = 8
    distance: int = 6

    def __post_init__(self) -> None:
        if self.bands <= 0 or BITS % self.bands:
            raise ValueError(f"bands must divide {BITS}, got {self.bands}")
        if not 0 <= self.distance <= BITS:
            raise ValueError(f"distance must be between 0 and {BITS}, got {self.distance}")

    @property
    def finds_all(self) -> bool:
        """With more bands than differing bits one band is always equal."""
        return self.bands > self.distance


@dataclass(frozen=True)
class AlignParams:
    """Bands and distance of scenes, and what a clip's alignment must reach."""

    bands: int = 8
    distance: int = 6
    coverage_x1000: int = 600
    min_scenes: int = 3
    min_matched: int = 2**62

    def __post_init__(self) -> None:
        BandParams(self.bands, self.distance)
        if not 0 <= self.coverage_x1000 <= 1000:
            raise ValueError("coverage_x1000 must be between 0 and 1000")

    def required(self, scenes: int) -> int:
        return max(-(-scenes * self.coverage_x1000 // 1000), LEAST_VOTES)

    def needed(self, scenes: np.ndarray) -> np.ndarray:
        """The least matches that pass, for clips of so many scenes."""
        return np.minimum(np.maximum(-(-scenes * self.coverage_x1000 // 1000), LEAST_VOTES), self.min_matched)


#: What partial clips are asked for in production: whole coverage, or three matched scenes.
PARTIAL_CLIPS = AlignParams(coverage_x1000=1000, min_matched=3)


# ---------------------------------------------------------------- exact


def exact_groups(files: DataFrame) -> DataFrame:
    """(content_hash, first_id, n, members) of contents that several ids share; members in order, once each."""
    ids = files.where("content_hash is not null").select("content_hash", "id").distinct()
    g = ids.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"))
    return g.where("n > 1")


def exact_members(files: DataFrame) -> DataFrame:
    """(group_id, file_id): members as rows, for groups of any size; group_id is the smallest member."""
    ids = files.where("content_hash is not null").select("content_hash", "id").distinct()
    sizes = ids.groupBy("content_hash").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return ids.join(sizes, "content_hash").select("group_id", F.col("id").alias("file_id"))


def reconcile_exact(buckets: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each bucket (group_id, file_id) given the members of existing exact groups (group_id, file_id).

    (bucket_id, outcome, target_id, new_members): create without an existing group, extend (or unchanged) with one that
    has no foreign member, else ambiguous.
    """
    b = buckets.select(F.col("group_id").alias("bucket_id"), "file_id")
    e = existing.select(F.col("group_id").alias("target_id"), "file_id")
    met = b.join(e, "file_id", "left")
    per = met.groupBy("bucket_id").agg(
        F.countDistinct("target_id").alias("targets"), F.min("target_id").alias("target_id"), F.countDistinct(F.when(F.col("target_id").isNull(), F.col("file_id"))).alias("fresh"),
        F.countDistinct("file_id").alias("size"), F.countDistinct(F.when(F.col("target_id").isNotNull(), F.col("file_id"))).alias("mapped"))
    held = e.groupBy("target_id").agg(F.countDistinct("file_id").alias("held"))
    j = per.join(held, "target_id", "left")
    foreign = F.col("held") > F.col("mapped")
    outcome = F.when(F.col("targets") == 0, "create").when((F.col("targets") > 1) | foreign, "ambiguous").when(F.col("fresh") > 0, "extend").otherwise("unchanged")
    added = F.when(outcome == "create", F.col("size")).when(outcome == "extend", F.col("fresh")).otherwise(0).cast("long")
    return j.select("bucket_id", outcome.alias("outcome"), F.when(F.col("targets") == 1, F.col("target_id")).alias("target_id"), added.alias("new_members"))


# ---------------------------------------------------------------- near


def banded(hashes: DataFrame, key: str, params: BandParams) -> DataFrame:
    """Rows once for each band of their hash; the uninformative hash 0 has none."""
    index = F.explode(F.sequence(F.lit(0), F.lit(params.bands - 1))).alias("band")
    rows = hashes.where(F.col("phash").isNotNull() & (F.col("phash") != 0)).select("*", index)
    return rows.withColumn("value", band(F.col("phash"), F.col("band"), params.bands))


def first_rows(hashes: DataFrame) -> DataFrame:
    """One hash for each file_id: the smallest of several."""
    return hashes.groupBy("file_id").agg(F.min("phash").alias("phash"))


def hamming_join(hashes: DataFrame, params: BandParams) -> DataFrame:
    """(a, b, distance) with a < b for pairs that share a band and differ in few bits.

    An equi-join on (band, value). A pair comes from its lowest shared band alone, so nothing is counted twice and
    no pass removes repeats.
    """
    rows = banded(first_rows(hashes), "file_id", params)
    x = rows.select(F.col("file_id").alias("a"), F.col("phash").alias("p"), "band", "value")
    y = rows.select(F.col("file_id").alias("b"), F.col("phash").alias("q"), "band", "value")
    pairs = x.join(y, ["band", "value"]).where("a < b").withColumn("distance", hamming(F.col("p"), F.col("q"))).where(F.col("distance") <= params.distance)
    return pairs.where(_lowest_shared_band(params)).select("a", "b", F.col("distance").cast("long").alias("distance"))


def _lowest_shared_band(params: BandParams) -> Column:
    """Whether no band below this one is equal."""
    earlier = F.lit(True)
    for k in range(params.bands - 1):
        earlier = earlier & ((F.col("band") <= k) | (band(F.col("p"), k, params.bands) != band(F.col("q"), k, params.bands)))
    return earlier


def hamming_query(hashes: DataFrame, phash: int, params: BandParams) -> DataFrame:
    """(file_id, distance) of hashes that share a band with one hash and are near it, nearest first."""
    shared = F.lit(False)
    for k in range(params.bands):
        shared = shared | (band(F.col("phash"), k, params.bands) == band(F.lit(phash).cast("long"), k, params.bands))
    d = hamming(F.col("phash"), F.lit(phash).cast("long")).cast("long")
    return first_rows(hashes).where((F.col("phash") != 0) & shared).select("file_id", d.alias("distance")).where(F.col("distance") <= params.distance).orderBy("distance", "file_id")


def near_incremental(hashes: DataFrame, previous: DataFrame, changed: DataFrame, params: BandParams) -> DataFrame:
    """The edges of hamming_join from previous ones (a, b) and the changed ids (file_id): only these are searched again."""
    rows = banded(first_rows(hashes), "file_id", params)
    touched = rows.join(changed.select("file_id"), "file_id", "left_semi")
    still = first_rows(hashes)
    kept = previous.select("a", "b").join(changed.select(F.col("file_id").alias("a")), "a", "left_anti").join(changed.select(F.col("file_id").alias("b")), "b", "left_anti")
    kept = kept.join(still.select(F.col("file_id").alias("a"), F.col("phash").alias("p")), "a").join(still.select(F.col("file_id").alias("b"), F.col("phash").alias("q")), "b")
    kept = kept.where("p <> 0 and q <> 0").select("a", "b", hamming(F.col("p"), F.col("q")).cast("long").alias("distance")).where(F.col("distance") <= params.distance)
    x = touched.select(F.col("file_id").alias("i"), F.col("phash").alias("p"), "band", "value")
    y = rows.select(F.col("file_id").alias("j"), F.col("phash").alias("q"), "band", "value")
    new = x.join(y, ["band", "value"]).where("i <> j").withColumn("distance", hamming(F.col("p"), F.col("q")).cast("long")).where(F.col("distance") <= params.distance)
    new = new.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").distinct()
    return kept.unionByName(new)


def near_scores(edges: DataFrame) -> DataFrame:
    return edges.withColumn("score_x1000", similarity_x1000(F.col("distance")))


def mih_postings(hashes: DataFrame, chunks: int = 4) -> DataFrame:
    """Rows of the multi-index: (file_id, phash, chunk, slice_value, more columns)."""
    rows = hashes.where("phash <> 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return rows.withColumn("slice_value", band(F.col("phash"), F.col("chunk"), chunks))


def mih_join(hashes: DataFrame, distance: int = 6, probes: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of all pairs within the distance, by equal chunks of distinct hashes.

    a < b; with probes, some of the hashes, a is one of these and b any other one. Files of one hash are met by that hash.
    """
    rows = first_rows(hashes).where("phash <> 0")
    ends = rows if probes is None else first_rows(probes).where("phash <> 0")
    x, y = ends.select(F.col("file_id").alias("a"), F.col("phash").alias("p")), rows.select(F.col("file_id").alias("b"), F.col("phash").alias("q"))
    near = B.near_hashes(rows, distance).select(F.col("a").alias("p"), F.col("b").alias("q"), "distance")
    different = x.join(near, "p").join(y, "q").select("a", "b", "distance")
    same = x.join(y, F.col("p") == F.col("q")).select("a", "b", F.lit(0).cast("long").alias("distance"))
    return different.unionByName(same).where("a < b" if probes is None else "a <> b")


# ---------------------------------------------------------------- sequences


def scene_postings(scenes: DataFrame, distance: int) -> DataFrame:
    """(file_id, ts_ms, phash, key): scenes once for each other hash (key) that is near theirs."""
    near = B.near_hashes(scenes, distance).select(F.col("a").alias("phash"), F.col("b").alias("key"))
    return scenes.join(near, "phash").select("file_id", "ts_ms", "phash", "key")


def near_files(scenes: DataFrame, distance: int = 6) -> DataFrame:
    """(a, b, distance, pairs) of files a < b with near scenes: the least distance, and how many scene pairs are near."""

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        side, bits = len(y.ids).bit_length(), BITS.bit_length()

        def parts() -> Iterator[tuple[bool, list[np.ndarray]]]:
            for last, a, b in B.met(x, y, same, B.NearMeet(y)):
                yield last, [((x.file[a] << side | y.file[b]) << bits) + np.bitwise_count((x.h[a] ^ y.h[b]).view(np.uint64))]

        for ((keys, counts),) in B.gathered(parts()):
            pair = keys >> bits
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(first):
                f, g = x.ids[pair[first] >> side], y.ids[pair[first] & ((1 << side) - 1)]
                yield [np.minimum(f, g), np.maximum(f, g), keys[first] & ((1 << bits) - 1), np.add.reduceat(counts, first)]

    return B.block_pairs(scenes, reduce, "a long, b long, distance long, pairs long", scene_postings(scenes, distance))


def _clip_keys(o: B.Offsets, a: np.ndarray, b: np.ndarray, least: int, marked: bool) -> np.ndarray:
    """Keys of scene pairs of a clip of at least so many scenes and a source of more; with marked, one of them is so."""
    n, m = o.x.n[o.x.file[a]], o.y.n[o.y.file[b]]
    keep = (n != m) & (np.minimum(n, m) >= least)
    if marked:
        keep &= o.x.marked[o.x.file[a]] | o.y.marked[o.y.file[b]]
    return o.keys(a[keep], b[keep], (n > m)[keep])


def offset_votes(scenes: DataFrame, params: AlignParams, least: int = LEAST_VOTES) -> DataFrame:
    """(clip, source, bucket, votes), of at least so many votes, of scenes of different files that share a band.

    Each pair votes for the five offset buckets around its own.
    """

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        if (dense := B.dense_votes(x, y, same, params.bands, VOTE_BUCKET_MS)) is not None:
            for d in dense:
                clip, source = x.ids[d.f], y.ids[d.g]
                for some, bucket, votes in d.rows(least):
                    f, g = clip.take(some), source.take(some)
                    yield [f, g, bucket, votes]
                    yield [g, f, -bucket, votes]
            return
        o = B.Offsets(x, y, VOTE_BUCKET_MS)
        parts = ((last, [o.keys(a, b)] if o.grid else [o.keys(a, b), o.keys(a, b, True)]) for last, a, b in B.met(x, y, same, B.BandMeet(y, params.bands)))
        for lists in B.gathered(parts):
            for back in (False, True):
                keys, votes = B.votes_of(*lists[back and not o.grid], least)
                f, g = o.files(keys >> o.bits)
                bucket = o.offset(keys)
                yield [y.ids[g], x.ids[f], -bucket if o.grid else bucket, votes] if back else [x.ids[f], y.ids[g], bucket, votes]

    return B.block_pairs(scenes, reduce, "clip long, source long, bucket long, votes long")


def clip_candidates(scenes: DataFrame, params: AlignParams) -> DataFrame:
    """(clip, source, bucket, votes) worth verifying: two votes, a long enough clip, a source with more scenes."""

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        if (dense := B.dense_votes(x, y, same, params.bands, VOTE_BUCKET_MS)) is not None:
            for d in dense:
                n, m = x.n[d.f], y.n[d.g]
                back = n > m
                clip, source, sign = np.where(back, y.ids[d.g], x.ids[d.f]), np.where(back, x.ids[d.f], y.ids[d.g]), np.where(back, -1, 1)
                for some, bucket, votes in d.rows(LEAST_VOTES, (n != m) & (np.minimum(n, m) >= params.min_scenes)):
                    yield [clip.take(some), source.take(some), bucket * sign.take(some), votes]
            return
        o = B.Offsets(x, y, VOTE_BUCKET_MS)
        parts = ((last, [_clip_keys(o, a, b, params.min_scenes, False)]) for last, a, b in B.met(x, y, same, B.BandMeet(y, params.bands)))
        for (found,) in B.gathered(parts):
            keys, votes = B.votes_of(*found, LEAST_VOTES)
            f, g = o.files(keys >> o.bits)
            back = x.n[f] > y.n[g]
            yield [np.where(back, y.ids[g], x.ids[f]), np.where(back, x.ids[f], y.ids[g]), o.offset(keys), votes]

    return B.block_pairs(scenes, reduce, "clip long, source long, bucket long, votes long")


_ALIGNED = "matched long, source_start_ms long, source_end_ms long, clip_start_ms long, clip_end_ms long, clip_scenes long"


def align_one(clip_ts: np.ndarray, clip_hash: np.ndarray, source_ts: np.ndarray, source_hash: np.ndarray, offset: int, distance: int) -> tuple[int, int, int, int, int]:
    """(matched, source start, source end, clip start, clip end) of the greedy ordered alignment.

    Each informative clip scene takes the first source scene after the last taken one whose time is within the
    tolerance and whose hash is near.
    """
    at, matched = 0, 0
    ends = [0, 0, 0, 0]
    # bits are counted in unsigned words: of a negative one bitwise_count takes the absolute value
    lows = np.searchsorted(source_ts, clip_ts + offset - MATCH_TOLERANCE_MS, side="left")
    highs = np.searchsorted(source_ts, clip_ts + offset + MATCH_TOLERANCE_MS, side="right")
    for k in np.flatnonzero(clip_hash):
        begin = max(at, int(lows[k]))
        some = source_hash[begin : highs[k]]
        if not len(some):
            continue
        near = np.flatnonzero((np.bitwise_count((some ^ clip_hash[k]).view(np.uint64)) <= distance) & (some != 0))
        if len(near):
            at = begin + int(near[0]) + 1
            if not matched:
                ends[0], ends[2] = int(source_ts[at - 1]), int(clip_ts[k])
            ends[1], ends[3] = int(source_ts[at - 1]), int(clip_ts[k])
            matched += 1
    return matched, *ends


def verify_alignments(candidates: DataFrame, sequences: DataFrame, params: AlignParams, always: bool = False) -> DataFrame:
    """candidates (clip, source, offset_ms, more) with the columns of their alignment; those that fail go unless always.

    The pointer walk needs state that array functions would scan for again and again, so it runs on Arrow batches.
    """
    s = sequences.select("file_id", F.transform("scenes", lambda x: x["ts_ms"]).alias("ts"), F.transform("scenes", lambda x: x["phash"]).alias("ph"))
    j = candidates.join(s.select(F.col("file_id").alias("clip"), F.col("ts").alias("ct"), F.col("ph").alias("ch")), "clip")
    j = j.join(s.select(F.col("file_id").alias("source"), F.col("ts").alias("st"), F.col("ph").alias("sh")), "source")
    kept = candidates.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in j.select(*kept).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ct, ch, st, sh, offset in zip(pdf["ct"], pdf["ch"], pdf["st"], pdf["sh"], pdf["offset_ms"], strict=True):
                a = align_one(np.asarray(ct, np.int64), np.asarray(ch, np.int64), np.asarray(st, np.int64), np.asarray(sh, np.int64), int(offset), params.distance)
                rows.append((*a, len(ct)))
            out = pd.DataFrame(rows, columns=["matched", "source_start_ms", "source_end_ms", "clip_start_ms", "clip_end_ms", "clip_scenes"], dtype="int64")
            fine = [always or m >= params.required(n) or m >= params.min_matched for m, n in zip(out["matched"], out["clip_scenes"], strict=True)]
            both = pd.concat([pdf[kept].reset_index(drop=True), out], axis=1)
            yield both[np.array(fine, dtype=bool)] if len(both) else both

    return j.select(*kept, "ct", "ch", "st", "sh").mapInPandas(run, f"{types}, {_ALIGNED}")


_BEST = f"clip long, source long, {_ALIGNED}, source_offset long, coverage_x1000 long"


def _best_alignments(scenes: DataFrame, params: AlignParams, changed: DataFrame | None = None) -> DataFrame:
    """The best alignment of each (clip, source), with fine, how many of its candidates pass.

    Each matched scene pair of an alignment is within the distance and its time votes for the alignment's bucket, so only
    buckets with as many such votes as must match are walked: no other candidate of bands that find all can pass.
    """
    marked = changed is not None

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        o = B.Offsets(x, y, VOTE_BUCKET_MS)
        parts = ((last, [_clip_keys(o, a, b, params.min_scenes, marked)]) for last, a, b in B.met(x, y, same, B.NearMeet(y)))
        for (found,) in B.gathered(parts):
            keys, votes = B.votes_of(*found, LEAST_VOTES)
            f, g = o.files(keys >> o.bits)
            back = x.n[f] > y.n[g]
            some = np.flatnonzero(votes >= params.needed(np.minimum(x.n[f], y.n[g])))
            best: dict[tuple[int, int], list] = {}
            for i, j, turn, bucket in zip(f[some].tolist(), g[some].tolist(), back[some].tolist(), o.offset(keys[some]).tolist(), strict=True):
                clip, source = (y.scenes(j), x.scenes(i)) if turn else (x.scenes(i), y.scenes(j))
                n, offset = len(clip[0]), bucket * VOTE_BUCKET_MS
                m, s0, s1, c0, c1 = align_one(*clip, *source, offset, params.distance)
                if m < params.required(n) and m < params.min_matched:
                    continue
                rank = (-m, abs(s0 - c0), s0 - c0, s0, offset)
                ends = (int(y.ids[j]), int(x.ids[i])) if turn else (int(x.ids[i]), int(y.ids[j]))
                old = best.get(ends)
                row = [rank, (*ends, m, s0, s1, c0, c1, n, s0 - c0, min(m * 1000 // n, 1000)), 1 + (old[2] if old else 0)]
                best[ends] = row if old is None or rank < old[0] else [*old[:2], row[2]]
            if best:
                yield list(np.array([(*r, fine) for _, r, fine in best.values()], np.int64).T)

    return B.block_pairs(scenes, reduce, f"{_BEST}, fine long", scene_postings(scenes, params.distance), changed)


def _found_by_near(params: AlignParams) -> bool:
    return BandParams(params.bands, params.distance).finds_all and params.min_matched >= LEAST_VOTES


def partial_clips(scenes: DataFrame, sequences: DataFrame, params: AlignParams = PARTIAL_CLIPS, candidates: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """The best alignment of each (clip, source): more matches, then the smaller absolute offset, then the smaller one.

    With changed (file_id) only those with such an end. Bands that miss some near scenes, and given candidates, are
    verified one by one.
    """
    if candidates is None and _found_by_near(params):
        return _best_alignments(scenes, params, changed).drop("fine")
    c = clip_candidates(scenes, params) if candidates is None else candidates
    if changed is not None:
        mark = lambda end: changed.select(F.col("file_id").alias(end), F.lit(True).alias(f"{end}_changed")).distinct()
        c = c.join(mark("clip"), "clip", "left").join(mark("source"), "source", "left").where("clip_changed or source_changed")
    v = verify_alignments(c.select("clip", "source", (F.col("bucket") * VOTE_BUCKET_MS).alias("offset_ms")), sequences, params)
    v = v.withColumn("source_offset", F.col("source_start_ms") - F.col("clip_start_ms")).withColumn("coverage_x1000", F.least(F.floor(F.col("matched") * 1000 / F.col("clip_scenes")), F.lit(1000)).cast("long"))
    w = Window.partitionBy("clip", "source").orderBy(F.desc("matched"), F.abs("source_offset"), "source_offset", "source_start_ms", "offset_ms")
    return v.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "offset_ms")


def vote_counters(scenes: DataFrame, params: AlignParams) -> DataFrame:
    """(single_vote, examined): buckets of long enough clips with one vote, and the clip_candidates; counted where they are found."""

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        o = B.Offsets(x, y, VOTE_BUCKET_MS)
        dense = B.dense_counts(x, y, same, params.bands, VOTE_BUCKET_MS, params.min_scenes) if len(x.ids) and len(y.ids) else (0, 0)
        if dense is not None:
            yield [np.array([dense[0]]), np.array([dense[1]])]
            return
        single = examined = 0
        parts = ((last, [o.keys(a, b)] if o.grid else [o.keys(a, b), o.keys(a, b, True)]) for last, a, b in B.met(x, y, same, B.BandMeet(y, params.bands)))
        for lists in B.gathered(parts):
            for back in (False, True):
                # on the grid the other direction has opposite buckets, as many
                keys, counts = lists[back and not o.grid]
                f, g = o.files(keys >> o.bits)
                clip, source = (y.n[g], x.n[f]) if back else (x.n[f], y.n[g])
                long = clip >= params.min_scenes
                one, two = B.several_votes(keys[long], counts[long])
                single += one - two
                long &= source > clip
                examined += B.several_votes(keys[long], counts[long])[1]
        yield [np.array([single]), np.array([examined])]

    return B.block_pairs(scenes, reduce, "single_vote long, examined long").agg(F.sum("single_vote").alias("single_vote"), F.sum("examined").alias("examined"))


def partial_counters(scenes: DataFrame, sequences: DataFrame, params: AlignParams = PARTIAL_CLIPS) -> DataFrame:
    """(skipped_short, single_vote, examined, below_coverage) of a whole plan."""
    counts = scenes.groupBy("file_id").agg(F.count("*").alias("n"))
    short = counts.agg(F.sum(F.when(F.col("n") < params.min_scenes, 1).otherwise(0)).alias("skipped_short"))
    if _found_by_near(params):
        fine = _best_alignments(scenes, params).agg(F.coalesce(F.sum("fine"), F.lit(0)).alias("fine"))
    else:
        c = clip_candidates(scenes, params).select("clip", "source", (F.col("bucket") * VOTE_BUCKET_MS).alias("offset_ms"))
        fine = verify_alignments(c, sequences, params).agg(F.count("*").alias("fine"))
    out = short.join(F.broadcast(vote_counters(scenes, params))).join(F.broadcast(fine)).withColumn("below_coverage", F.col("examined") - F.col("fine"))
    return out.select(*[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("skipped_short", "single_vote", "examined", "below_coverage")])  # one row each


def partial_incremental(scenes: DataFrame, sequences: DataFrame, previous: DataFrame, changed: DataFrame, params: AlignParams = PARTIAL_CLIPS) -> DataFrame:
    """partial_clips from previous matches and the changed ids: only pairs with a changed end are searched again."""
    ids = changed.select("file_id")
    kept = previous.join(ids.withColumnRenamed("file_id", "clip"), "clip", "left_anti").join(ids.withColumnRenamed("file_id", "source"), "source", "left_anti")
    there = sequences.select("file_id")
    kept = kept.join(there.withColumnRenamed("file_id", "clip"), "clip", "left_semi").join(there.withColumnRenamed("file_id", "source"), "source", "left_semi")
    new = partial_clips(scenes, sequences, params, changed=ids)
    return kept.select(*new.columns).unionByName(new)


def oriented_matches(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored edges (file_a, file_b) as (clip, source): the clip has fewer scenes, file_a on a tie; the offset isn't stored and is 0."""
    c = edges.join(counts.select(F.col("file_id").alias("file_a"), F.col("n").alias("na")), "file_a").join(counts.select(F.col("file_id").alias("file_b"), F.col("n").alias("nb")), "file_b")
    a_first = F.col("na") <= F.col("nb")
    return c.select(F.when(a_first, F.col("file_a")).otherwise(F.col("file_b")).alias("clip"), F.when(a_first, F.col("file_b")).otherwise(F.col("file_a")).alias("source"), F.lit(0).cast("long").alias("source_offset"), "score_x1000")


def intro_outro(clip_start: Column, clip_end: Column, source_start: Column, source_end: Column, clip_ms: Column, source_ms: Column, clip_scenes: Column, limit_x1000: int = 370) -> Column:
    """Short on both sides, with both middles in the first or last third; false if a duration is unknown or 0."""
    span = lambda a, b: F.greatest(b - a, F.lit(0))
    short = lambda a, b, d: F.floor(span(a, b) * 1000 / d) <= limit_x1000

    def outside(a: Column, b: Column, d: Column) -> Column:
        mid, third = a + F.floor(span(a, b) / 2), F.floor(d / 3)
        return (mid <= third) | (mid >= d - third)

    known = (clip_scenes > 0) & (clip_ms > 0) & (source_ms > 0)
    tag = short(clip_start, clip_end, clip_ms) & short(source_start, source_end, source_ms) & outside(clip_start, clip_end, clip_ms) & outside(source_start, source_end, source_ms)
    return F.coalesce(F.when(known, tag), F.lit(False))


_WHOLE = "a long, b long, total long, offset_ab_ms long, consistency_ab double, offset_ba_ms long, consistency_ba double"
_ENDS = "span_ab long, matched_ab long, span_ba long, matched_ba long, ka long, kb long, da long, db long"


def _promising(o: B.Offsets, same: bool, params: AlignParams, ratio: float | None) -> np.ndarray:
    """File pairs with enough near scene pairs for an alignment; with a ratio, for both ways and with that scene ratio."""
    x, y = o.x, o.y
    out = [np.zeros(0, np.int64)]
    for ((keys, counts),) in B.gathered((last, [(x.file[a] << o.side) | y.file[b]]) for last, a, b in B.met(x, y, same, B.NearMeet(y))):
        f, g = o.files(keys)
        n, m = params.needed(x.n[f]), params.needed(y.n[g])
        keep = counts >= (np.minimum(n, m) if ratio is None else np.maximum(n, m))
        if ratio is not None:
            k, j = x.informative[f], y.informative[g]
            keep &= np.minimum(k, j) / np.maximum(k, j) >= ratio
        out.append(keys[keep])
    return np.concatenate(out)


def _of_pairs(o: B.Offsets, pairs: np.ndarray, bands: BandParams) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Scene pairs that share a band, of given file pairs."""
    x, y = o.x, o.y
    f, g = o.files(pairs)
    upto = np.concatenate([[0], np.cumsum(x.n[f] * y.n[g])])
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + B.HELD_PAIRS, "right")) - 1)
        src, a = B.expanded(x.begin[f[at:to]], x.n[f[at:to]])
        of, b = B.expanded(y.begin[g[at:to]][src], y.n[g[at:to]][src])
        a = a[of]
        d = (x.h[a] ^ y.h[b]).view(np.uint64)
        width = BITS // bands.bands
        shared = np.any([(d >> np.uint64(k * width)) & np.uint64(2**width - 1) == 0 for k in range(bands.bands)], axis=0) & (x.h[a] != 0) & (y.h[b] != 0)
        yield True, a[shared], b[shared]
        at = to


def _whole(scenes: DataFrame, params: AlignParams, aligned: bool, ratio: float | None = None) -> DataFrame:
    """whole_candidates; aligned, with spans and matches of both alignments (0 of those that fail), informative scenes and durations.

    With a ratio, only pairs that have this scene ratio and enough near scenes for both alignments.
    """
    bands = BandParams(params.bands, params.distance)

    def walked(clip: tuple, source: tuple, offset: int) -> tuple[int, int]:
        m, _, _, begin, end = align_one(*clip, *source, offset, params.distance)
        return (end - begin, m) if m >= params.required(len(clip[0])) or m >= params.min_matched else (0, 0)

    def reduce(x: B.Block, y: B.Block, same: bool) -> Iterator[list[np.ndarray]]:
        o = B.Offsets(x, y, VOTE_BUCKET_MS)
        some = _promising(o, same, params, ratio) if aligned else np.zeros(0, np.int64)

        def out(f: np.ndarray, g: np.ndarray, total: np.ndarray, top: tuple[np.ndarray, np.ndarray], way: np.ndarray, back: np.ndarray, walk: np.ndarray) -> list[np.ndarray]:
            """Columns of file pairs, whose votes are as many both ways; walk are those to align."""
            swap = x.ids[f] > y.ids[g]
            two = lambda p, q: (np.where(swap, q, p), np.where(swap, p, q))
            (a, b), (ab, ba), share = two(x.ids[f], y.ids[g]), two(way, back), [t / total for t in two(*top)]
            columns = [a, b, total, ab * VOTE_BUCKET_MS, share[0], ba * VOTE_BUCKET_MS, share[1]]
            if aligned:
                found = np.zeros((4, len(f)), np.int64)
                for k in walk.tolist():
                    p, q = x.scenes(f[k]), y.scenes(g[k])
                    found[:2, k], found[2:, k] = walked(p, q, int(way[k]) * VOTE_BUCKET_MS), walked(q, p, int(back[k]) * VOTE_BUCKET_MS)
                (s_ab, s_ba), (m_ab, m_ba) = two(found[0], found[2]), two(found[1], found[3])
                columns += [s_ab, m_ab, s_ba, m_ba, *two(x.informative[f], y.informative[g]), *two(x.lasting[f], y.lasting[g])]
            return columns

        if ratio is None and (dense := B.dense_votes(x, y, same, params.bands, VOTE_BUCKET_MS)) is not None:
            for d in dense:
                total, top, upper, lower = d.medians()
                rows = np.flatnonzero(total >= LEAST_VOTES)
                if len(rows):
                    f, g, most = d.f[rows], d.g[rows], top[rows]
                    # opposite buckets: the upper median of the other direction is the lower one of this
                    yield out(f, g, total[rows], (most, most), upper[rows], -lower[rows], np.flatnonzero(d.holds(*o.files(some))[rows]) if len(some) else some)
            return
        rows = B.met(x, y, same, B.BandMeet(y, params.bands)) if ratio is None else _of_pairs(o, some, bands)
        for lists in B.gathered((last, [o.keys(a, b)] if o.grid else [o.keys(a, b), o.keys(a, b, True)]) for last, a, b in rows):
            keys, counts, pair, total = B.at_least(o, *lists[0], LEAST_VOTES)
            if not len(pair):
                continue
            turned = B.counted(o.turned(keys), counts) if o.grid else B.at_least(o, *lists[1], LEAST_VOTES)[:2]
            (_, top, way), (_, top_back, back) = B.medians(o, keys, counts), B.medians(o, *turned)
            yield out(*o.files(pair), total, (top, top_back), way, back, np.flatnonzero(np.isin(pair, some)))

    return B.block_pairs(scenes, reduce, f"{_WHOLE}, {_ENDS}" if aligned else _WHOLE, scene_postings(scenes, params.distance) if aligned else None)


def whole_candidates(scenes: DataFrame, params: AlignParams) -> DataFrame:
    """(a, b, total, offset_ab_ms, consistency_ab, offset_ba_ms, consistency_ba) of pairs a < b with two shared scene pairs.

    The offset is the upper median of the buckets with the most votes.
    """
    return _whole(scenes, params, False)


def whole_matches(scenes: DataFrame, sequences: DataFrame, params: AlignParams, ratio: float = 0.80, span: float = 0.80, density: float = 0.15, passing: bool = False) -> DataFrame:
    """Candidate metrics of whole-file pairs with passes_gate and score_x1000.

    passing: at least those that pass the gate. Spans and the density are of alignments, so such pairs have near scenes enough.
    """
    near_only = passing and span > 0 and BandParams(params.bands, params.distance).finds_all
    j = _whole(scenes, params, True, ratio if near_only else None)
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    j = j.withColumn("scene_ratio", share(F.least("ka", "kb"), F.greatest("ka", "kb"))).withColumn("span_a", share(F.col("span_ab"), F.col("da"))).withColumn("span_b", share(F.col("span_ba"), F.col("db")))
    j = j.withColumn("coverage_ab", share(F.col("matched_ab"), F.col("ka"))).withColumn("coverage_ba", share(F.col("matched_ba"), F.col("kb")))
    low = F.least("coverage_ab", "coverage_ba")
    gate = (F.col("scene_ratio") >= ratio) & (F.col("span_a") >= span) & (F.col("span_b") >= span) & (low >= density)
    return j.select("a", "b", "total", "offset_ab_ms", "offset_ba_ms", "consistency_ab", "consistency_ba", "scene_ratio", "span_a", "span_b", "coverage_ab", "coverage_ba", gate.alias("passes_gate"), F.round(F.least(low, F.lit(1.0)) * 1000).cast("long").alias("score_x1000"))
