"""The registered scene queries with eight bands against brute force, on scenes whose differing bits fall in all four 16-bit bands."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest
from mirrorsift.operators import detection as D
from mirrorsift.plans import catalog
from pyspark.sql import functions as F
from test_detection import naive_align, signed, splitmix

catalog.queries()


def spread(h, rng):
    """h with four to six differing bits, one in each 16-bit band at least."""
    for k in [*range(4), *rng.sample(range(4), rng.randint(0, 2))]:
        h ^= 1 << (16 * k + rng.randrange(16))
    return h


@pytest.fixture(scope="module")
def tables(spark):
    g, rng, rows = splitmix(21), random.Random(21), []
    for s in range(6):
        source = [next(g) for _ in range(14)]
        rows += [(s, k, k * 2500, signed(h)) for k, h in enumerate(source)]
        rows += [(100 + s, k, k * 2500, signed(spread(h, rng))) for k, h in enumerate(source[3 : 3 + 4 + s % 3])]
    rows += [(200, k, k * 2500, h) for k, h in enumerate([0, 5, 5, 0, 5])] + [(201, k, k * 2500, h) for k, h in enumerate([5, 5, 5, 0, 7, 5])]
    scenes = spark.createDataFrame(rows, "file_id long, scene_index long, ts_ms long, phash long").cache()
    seqs = scenes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "phash"))).alias("scenes"))
    documents = spark.createDataFrame([(3,), (101,), (201,)], "doc_id long")
    return SimpleNamespace(scenes=scenes, sequences=seqs, raw=lambda _: documents, rows=rows)


def run(name, tables):
    return catalog._QUERIES[name](tables)


def sharing(rows):
    bands = lambda h: [(h >> 8 * k) & 255 for k in range(8)]
    return [(x, y) for x in rows for y in rows if x[0] != y[0] and x[3] and y[3] and any(a == b for a, b in zip(bands(x[3]), bands(y[3]), strict=True))]


def brute_votes(rows):
    return Counter((x[0], y[0], (y[2] - x[2]) // 2500 + o) for x, y in sharing(rows) for o in range(-2, 3))


def brute_candidates(rows):
    n = Counter(r[0] for r in rows)
    return {k: v for k, v in brute_votes(rows).items() if v >= 2 and n[k[0]] >= 3 and n[k[1]] > n[k[0]]}


def brute_aligned(rows):
    by = {}
    for f, _, t, h in rows:
        by.setdefault(f, []).append((t, h))
    n = {f: len(v) for f, v in by.items()}
    return [(c, s, n[c], naive_align(*zip(*by[c], strict=True), *zip(*by[s], strict=True), b * 2500, 6)) for c, s, b in brute_candidates(rows)]


def brute_clips(rows):
    best = {}
    for c, s, n, a in brute_aligned(rows):
        if a[0] >= 3 or a[0] >= max(n, 2):
            key = (-a[0], abs(a[1] - a[3]), a[1] - a[3], a[1])
            best[c, s] = min(best.get((c, s), key), key)
    return {(c, s, -k[0], k[2]) for (c, s), k in best.items()}


def clips(df):
    return {(r["clip"], r["source"], r["matched"], r["source_offset"]) for r in df.collect()}


def test_votes_and_candidates(tables):
    got = {(r["clip"], r["source"], r["bucket"]): r["votes"] for r in run("join_offset_votes_eight_bands", tables).collect()}
    assert got == {k: v for k, v in brute_votes(tables.rows).items() if v >= 2}
    got = {(r["clip"], r["source"], r["bucket"]): r["votes"] for r in run("dup_clip_candidates_eight_bands", tables).collect()}
    assert got == brute_candidates(tables.rows)


def test_clips_that_four_bands_miss(tables):
    want = brute_clips(tables.rows)
    assert {(100 + s, s, 4 + s % 3, 7500) for s in range(6)} <= want
    assert clips(run("dup_partial_clips", tables)) == want
    assert clips(run("dup_partial_incremental", tables)) == want


def test_candidates_that_cannot_align_are_all_that_is_left_out(tables):
    whole = D.partial_clips(tables.scenes, tables.sequences, D.PARTIAL_CLIPS, D.clip_candidates(tables.scenes, D.PARTIAL_CLIPS))
    assert sorted(map(tuple, run("dup_partial_clips", tables).collect())) == sorted(map(tuple, whole.collect()))


def test_counters(tables):
    aligned, n = brute_aligned(tables.rows), Counter(r[0] for r in tables.rows)
    fine = sum(a[0] >= 3 or a[0] >= max(k, 2) for _, _, k, a in aligned)
    single = sum(v == 1 and n[k[0]] >= 3 for k, v in brute_votes(tables.rows).items())
    r = run("dup_partial_counters", tables).first()
    assert (r["skipped_short"], r["single_vote"], r["examined"], r["below_coverage"]) == (0, single, len(aligned), len(aligned) - fine)


def test_whole_pairs(tables):
    totals = Counter((x[0], y[0]) for x, y in sharing(tables.rows) if x[0] < y[0])
    got = {(r["a"], r["b"]): r["total"] for r in run("dup_whole_candidates_eight_bands", tables).collect()}
    assert got == {k: v for k, v in totals.items() if v >= 2}
    assert {(r["a"], r["b"]) for r in run("dup_whole_matches", tables).collect()} == set(got)
