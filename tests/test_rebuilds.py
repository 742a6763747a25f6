from types import SimpleNamespace

import pytest
from mirrorsift.operators import graph as G
from mirrorsift.plans import catalog
from mirrorsift.plans.detection import NEAR
from test_detection import brute, frame, hashes

catalog.queries()


def brute_groups(ids, edges):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    out = {}
    for i, r in low.items():
        out.setdefault(r, set()).add(i)
    return {r: m for r, m in out.items() if len(m) > 1}


@pytest.fixture(scope="module")
def stored(spark):
    g = [(1, "EXACT", False), (2, "VERY_LIKELY", False), (3, "VERY_LIKELY", True), (4, "POSSIBLE", False), (5, "VERY_LIKELY", False)]
    m = [(1, 10), (1, 11), (2, 11), (2, 12), (3, 20), (3, 21), (4, 30), (4, 31), (5, 40), (5, 41)]
    return spark.createDataFrame(g, "group_id long, trust string, non_transitive boolean"), spark.createDataFrame(m, "group_id long, file_id long")


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["group_id"], r["trust"], r["non_transitive"]), set()).add(r["file_id"])
    return out


def test_near_rebuild_writes_components_over_its_own_groups(spark, stored):
    hs = [h | 1 for h in hashes(120, 31)]
    near = [(a, b) for a, b, d in brute(hs, NEAR.distance) if any((hs[a] ^ hs[b]) >> 8 * k & 255 == 0 for k in range(8))]
    t = SimpleNamespace(phashes=frame(spark, hs), active=spark.range(120).where("id <> 7"), groups=stored[0], members=stored[1])
    got = {low: set() for low in (r["low"] for r in catalog._QUERIES["dup_near_groups"](t).collect())}
    for r in catalog._QUERIES["dup_near_groups"](t).collect():
        got[r["low"]].add(r["file_id"])
    assert got == brute_groups(range(120), near) and got
    out = grouped(catalog._QUERIES["reb_near"](t))
    active = brute_groups(range(120), [e for e in near if 7 not in e])
    kept = {(1, "EXACT", False): {10, 11}, (3, "VERY_LIKELY", True): {20, 21}, (4, "POSSIBLE", False): {30, 31}}
    assert out == kept | {(5 + 1 + low, "VERY_LIKELY", False): m for low, m in active.items()}
    edges = {(r["low"], r["a"], r["b"]) for r in catalog._QUERIES["reb_near_edges"](t).collect()}
    assert {(a, b) for _, a, b in edges} == {e for e in near if 7 not in e} and all({a, b} <= active[low] for low, a, b in edges)


def test_whole_rebuild_skips_pairs_of_one_component(spark, stored):
    rows = [(10, 12, True, 900), (11, 12, True, 900), (12, 40, True, 800), (30, 31, True, 700), (20, 21, True, 600), (50, 51, True, 500), (52, 53, False, 400)]
    out = G.rebuilt_whole(*stored, spark.createDataFrame(rows, "a long, b long, passes_gate boolean, score_x1000 long")).collect()
    new = {}
    for r in out:
        if r["non_transitive"]:
            assert r["trust"] == "VERY_LIKELY" and r["group_id"] > 5
            new.setdefault((r["group_id"], r["score_x1000"]), set()).add(r["file_id"])
    # 10, 11 and 12 are one component; 20 and 21 were in a non-transitive group only, 30 and 31 in a possible one
    assert sorted(map(sorted, new.values())) == [[12, 40], [20, 21], [30, 31], [50, 51]]
    assert {r["group_id"] for r in out if not r["non_transitive"]} == {1, 2, 4, 5}
