"""Pairs met block by block: off the time grid, in parts of a file, over any blocks, and without a shuffle of pairs."""

import random
from collections import Counter

import pytest
from mirrorsift.operators import blocks as B
from mirrorsift.operators import detection as D
from pyspark.sql import functions as F
from test_detection import hashes, signed


@pytest.fixture(scope="module", params=[2500, 1100])
def rows(request):
    rng, hs = random.Random(6), [*hashes(150, 17), 0, 0, *[77] * 30]
    return [(i % 23 * 10**12, i // 23, i // 23 * request.param, signed(h)) for i, h in enumerate(rng.sample(hs, len(hs)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id long, scene_index long, ts_ms long, phash long")


def sharing(rows, bands):
    w = 64 // bands
    return [(x, y) for x in rows for y in rows if x[0] != y[0] and x[3] and y[3] and any(((x[3] ^ y[3]) >> w * k) & (2**w - 1) == 0 for k in range(bands))]


def votes(rows, bands):
    return Counter((x[0], y[0], (y[2] - x[2]) // 2500 + o) for x, y in sharing(rows, bands) for o in range(-2, 3))


@pytest.mark.parametrize("held", [1 << 20, 5])
@pytest.mark.parametrize("bands", [4, 8])
def test_votes(spark, rows, bands, held, monkeypatch):
    monkeypatch.setattr(B, "HELD_PAIRS", held)
    monkeypatch.setattr(B, "LEAST_BLOCKS", 3)
    params = D.AlignParams(bands=bands)
    scenes, want, n = frame(spark, rows), votes(rows, bands), Counter(r[0] for r in rows)
    got = lambda df: {tuple(r)[:3]: r["votes"] for r in df.select("clip", "source", "bucket", "votes").collect()}
    assert got(D.offset_votes(scenes, params, 1)) == want
    assert got(D.offset_votes(scenes, params)) == {k: v for k, v in want.items() if v >= 2}
    assert got(D.clip_candidates(scenes, params)) == {k: v for k, v in want.items() if v >= 2 and n[k[0]] >= 3 and n[k[1]] > n[k[0]]}
    r = D.vote_counters(scenes, params).first()
    assert r["single_vote"] == sum(v == 1 and n[k[0]] >= 3 for k, v in want.items())
    assert r["examined"] == sum(v >= 2 and n[k[0]] >= 3 and n[k[1]] > n[k[0]] for k, v in want.items())


def test_whole_offsets(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "LEAST_BLOCKS", 3)
    v, total = votes(rows, 8), Counter((x[0], y[0]) for x, y in sharing(rows, 8))
    want = {}
    for (a, b), t in total.items():
        if t >= 2:
            top = max(n for k, n in v.items() if k[:2] == (a, b))
            tied = sorted(k[2] for k, n in v.items() if k[:2] == (a, b) and n == top)
            want[a, b] = (t, tied[len(tied) // 2] * 2500, top / t)
    got = D.whole_candidates(frame(spark, rows), D.AlignParams()).collect()
    assert {(r["a"], r["b"]) for r in got} == {k for k in want if k[0] < k[1]}
    for r in got:
        assert (r["total"], r["offset_ab_ms"], r["consistency_ab"]) == want[r["a"], r["b"]]
        assert (r["total"], r["offset_ba_ms"], r["consistency_ba"]) == want[r["b"], r["a"]]


def test_passing_pairs_are_those_of_all_matches(spark, rows):
    rng = random.Random(3)
    more = [(f, k, t, signed((h ^ (1 << rng.randrange(64))) & (2**64 - 1)) if h else 0) for f0, k, t, h in rows if f0 < 6 * 10**12 for f in (f0 + 1, f0 + 2)]
    scenes = frame(spark, rows + more)
    seqs = scenes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "phash"))).alias("scenes"))
    params = D.AlignParams()
    full = sorted(map(tuple, D.whole_matches(scenes, seqs, params).where("passes_gate").collect()))
    assert full and sorted(map(tuple, D.whole_matches(scenes, seqs, params, passing=True).where("passes_gate").collect())) == full


@pytest.mark.parametrize("make", [
    lambda s: D.offset_votes(s, D.AlignParams(bands=4)), lambda s: D.offset_votes(s, D.PARTIAL_CLIPS), lambda s: D.clip_candidates(s, D.PARTIAL_CLIPS), lambda s: D.whole_candidates(s, D.AlignParams()),
])
def test_no_pairs_are_shuffled(spark, make):
    plan = make(spark.createDataFrame([(1, 0, 0, 5)], "file_id long, scene_index long, ts_ms long, phash long"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_near_hashes_with_few_varying_bits(spark):
    hs = [*range(1, 60), *(2**63 + 2**40 + k for k in range(40)), 5, 5]
    got = {(r["a"], r["b"]): r["distance"] for r in B.near_hashes(spark.createDataFrame([(signed(h),) for h in hs], "phash long"), 3).collect()}
    assert got == {(signed(a), signed(b)): (a ^ b).bit_count() for a in set(hs) for b in set(hs) if a != b and (a ^ b).bit_count() <= 3}
