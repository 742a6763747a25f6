from types import SimpleNamespace

from mirrorsift.plans import catalog
from test_detection import hashes, signed

catalog.queries()


def test_multi_index_links_files_by_any_scene(spark):
    hs = [*hashes(160, 12), 0, 0, *[77] * 20]
    rows = [(i % 37, i // 37, i * 100, signed(h)) for i, h in enumerate(hs)]
    want = {}
    for x in rows:
        for y in rows:
            d = ((x[3] ^ y[3]) & (2**64 - 1)).bit_count()
            if x[0] < y[0] and x[3] and y[3] and d <= 6:
                least, n = want.get((x[0], y[0]), (64, 0))
                want[x[0], y[0]] = (min(least, d), n + 1)
    scenes = spark.createDataFrame(rows, "file_id long, scene_index long, ts_ms long, phash long")
    t = SimpleNamespace(scenes=scenes)
    got = {(r["a"], r["b"]): (r["distance"], r["pairs"]) for r in catalog._QUERIES["join_hamming_multi_index_scenes"](t).collect()}
    assert got == want
    first = {(r["a"], r["b"]) for r in catalog._QUERIES["join_hamming_multi_index"](t).collect()}
    assert first < set(got)
