import random

import numpy as np
import pytest
from mirrorsift.operators import detection as D
from pyspark.sql import functions as F


def splitmix(seed):
    state = seed
    while True:
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        yield z ^ (z >> 31)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hashes(n, seed=1):
    g, rng, out = splitmix(seed), random.Random(seed), []
    for _ in range(n):
        if out and rng.random() < 0.5:
            h = rng.choice(out)
            for _ in range(rng.randint(0, 8)):
                h ^= 1 << rng.randrange(64)
            out.append(h)
        else:
            out.append(next(g))
    return out


def frame(spark, hs):
    return spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "file_id long, phash long")


def pairs(df):
    return {(r["a"], r["b"], r["distance"]) for r in df.collect()}


def brute(hs, distance):
    return {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(len(hs)) for j in range(i + 1, len(hs)) if hs[i] and hs[j] and (hs[i] ^ hs[j]).bit_count() <= distance}


def test_bands_find_all_pairs_when_there_are_more_than_bits(spark):
    hs = [*hashes(300), 0, 0]
    assert D.BandParams(8, 6).finds_all and not D.BandParams(4, 6).finds_all
    assert pairs(D.hamming_join(frame(spark, hs), D.BandParams(8, 6))) == brute(hs, 6)
    assert pairs(D.hamming_join(frame(spark, hs), D.BandParams(4, 6))) <= brute(hs, 6)
    assert pairs(D.mih_join(frame(spark, hs), 6)) == brute(hs, 6)
    assert pairs(D.mih_join(frame(spark, hs), 7)) == brute(hs, 7)


def test_incremental_equals_full(spark):
    hs = hashes(200, 3)
    p = D.BandParams(8, 6)
    later = list(hs)
    g = splitmix(9)
    for i in range(0, 200, 11):
        later[i] = hs[i + 1] ^ 1 if i % 2 else next(g)
    changed = spark.createDataFrame([(i,) for i in range(0, 200, 11)], "file_id long")
    before = D.hamming_join(frame(spark, hs), p)
    assert pairs(D.near_incremental(frame(spark, later), before, changed, p)) == brute(later, 6)


@pytest.mark.parametrize("bands, distance", [(0, 6), (7, 6), (8, 65), (8, -1)])
def test_parameters_are_checked(bands, distance):
    with pytest.raises(ValueError):
        D.BandParams(bands, distance)


def test_required_matches():
    assert D.AlignParams(coverage_x1000=600).required(5) == 3 and D.AlignParams(coverage_x1000=600).required(2) == 2
    assert D.AlignParams(coverage_x1000=1000).required(7) == 7


def naive_align(ct, ch, st, sh, offset, distance):
    at, found = 0, []
    for t, h in zip(ct, ch, strict=True):
        if not h:
            continue
        k = next((i for i in range(at, len(st)) if t + offset - 5000 <= st[i] <= t + offset + 5000 and sh[i] and int(h ^ sh[i]) & (2**64 - 1) and bin(int(h ^ sh[i]) & (2**64 - 1)).count("1") <= distance or (i >= at and t + offset - 5000 <= st[i] <= t + offset + 5000 and sh[i] == h)), None)
        if k is not None:
            found.append((st[k], t))
            at = k + 1
    return (len(found), found[0][0], found[-1][0], found[0][1], found[-1][1]) if found else (0, 0, 0, 0, 0)


def test_alignment_against_a_plain_walk():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 30, 2)
        st, ct = np.sort(rng.integers(0, 60_000, n)), np.sort(rng.integers(0, 40_000, m))
        sh, ch = rng.integers(0, 6, n) * 255, rng.integers(0, 6, m) * 255
        offset = int(rng.integers(-4, 4)) * 2500
        assert D.align_one(ct, ch, st, sh, offset, 6) == naive_align(ct.tolist(), ch.tolist(), st.tolist(), sh.tolist(), offset, 6)


def test_clips_are_found_in_their_source(spark):
    g = splitmix(5)
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(12):
        source = [next(g) | (1 << 40) for _ in range(30)]
        rows += [(s, k, k * 2500, signed(h)) for k, h in enumerate(source)]
        begin = rng.randint(0, 20)
        clip = [h ^ ((1 << rng.randint(2, 5)) - 1) for h in source[begin : begin + 6]]
        rows += [(100 + s, k, k * 2500, signed(h)) for k, h in enumerate(clip)]
        want[100 + s] = (s, begin * 2500)
    scenes = spark.createDataFrame(rows, "file_id long, scene_index long, ts_ms long, phash long")
    seqs = scenes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "phash"))).alias("scenes"))
    params = D.AlignParams()
    full = D.partial_clips(scenes, seqs, params)
    got = {r["clip"]: (r["source"], r["source_offset"]) for r in full.collect()}
    assert got == want
    changed = spark.createDataFrame([(3,), (105,)], "file_id long")
    again = D.partial_incremental(scenes, seqs, full, changed, params)
    key = lambda d: sorted(map(tuple, d.select("clip", "source", "matched", "source_offset", "coverage_x1000").collect()))
    assert key(again) == key(full)


def test_whole_file_gate(spark):
    g = splitmix(8)
    a = [next(g) for _ in range(40)]
    b = [h ^ 1 for h in a]
    unrelated = [next(g) for _ in range(40)]
    rows = [(f, k, k * 2500, signed(h)) for f, s in ((1, a), (2, b), (3, unrelated)) for k, h in enumerate(s)]
    scenes = spark.createDataFrame(rows, "file_id long, scene_index long, ts_ms long, phash long")
    seqs = scenes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "phash"))).alias("scenes"))
    out = {(r["a"], r["b"]): r for r in D.whole_matches(scenes, seqs, D.AlignParams()).collect()}
    assert out[(1, 2)]["passes_gate"] and out[(1, 2)]["score_x1000"] == 1000 and abs(out[(1, 2)]["offset_ab_ms"]) <= 5000
    assert not any(r["passes_gate"] for k, r in out.items() if 3 in k)


def test_exact_reconciliation(spark):
    buckets = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (5, 6), (5, 7), (9, 9), (9, 10), (20, 20), (20, 21)], "group_id long, file_id long")
    existing = spark.createDataFrame([(50, 5), (50, 6), (60, 9), (61, 10), (70, 20), (70, 99)], "group_id long, file_id long")
    out = {r["bucket_id"]: (r["outcome"], r["target_id"], r["new_members"]) for r in D.reconcile_exact(buckets, existing).collect()}
    assert out == {1: ("create", None, 2), 5: ("extend", 50, 1), 9: ("ambiguous", None, 0), 20: ("ambiguous", 70, 0)}
