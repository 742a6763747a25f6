import random
import time

import numpy as np
import pytest
from mirrorsift.operators import changes, features, graph, selection
from mirrorsift.sources import listing, store
from mirrorsift.streaming import watch
from pyspark.sql import functions as F


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}


def groups(spark, rows):
    g = spark.createDataFrame([(i, t, nt, None) for i, t, nt, _ in rows], "group_id long, trust string, non_transitive boolean, best_file_id long")
    m = spark.createDataFrame([(i, f) for i, _, _, fs in rows for f in fs], "group_id long, file_id long")
    out = {}
    for r in graph.clusters(g, m).collect():
        out.setdefault(r["cluster_id"], {})[r["file_id"]] = r["trust"]
    return out


def test_clusters(spark):
    e, v, p = "EXACT", "VERY_LIKELY", "POSSIBLE"
    assert groups(spark, [(1, e, False, [1, 2]), (2, v, False, [2, 3])]) == {1: {1: e, 2: e, 3: v}}
    base = [(1, e, False, [1, 2]), (2, v, False, [2, 3])]
    assert 3 not in groups(spark, [*base, (3, p, False, [1, 3])])  # inside one cluster
    assert groups(spark, [*base, (3, p, False, [1, 9]), (4, p, False, [3, 9])])[3] == {1: p, 3: p, 9: p}  # one card
    two = groups(spark, [*base, (3, p, False, [1, 9]), (4, p, False, [1, 8])])
    assert two[3] == {1: p, 9: p} and two[4] == {1: p, 8: p}
    assert groups(spark, [*base, (5, v, True, [3, 4])])[5] == {3: v, 4: v}
    with pytest.raises(Exception, match="unknown trust"):
        groups(spark, [(1, "MAYBE", False, [1, 2])])


def test_frames():
    assert features.phash_of_grid(features.shrink(np.full((90, 70), 8, np.uint8))) == 0
    assert np.allclose(features.shrink(np.arange(64, dtype=np.uint8).reshape(8, 8))[0, :4], 0)
    assert (features.whole_frame(b"\x05\x06", 2, 2) == [[5, 6], [0, 0]]).all()
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 256, (50, 61)).astype(np.uint8)
    grid = features.shrink(frame)
    for ty, tx in ((0, 0), (7, 13), (31, 31)):
        y0, y1, x0, x1 = ty * 50 // 32, max((ty + 1) * 50 // 32, ty * 50 // 32 + 1), tx * 61 // 32, max((tx + 1) * 61 // 32, tx * 61 // 32 + 1)
        assert np.isclose(grid[ty, tx], frame[y0:y1, x0:x1].mean())
    k = np.arange(32)
    want = sum(grid[y, x] * np.cos((2 * y + 1) * 3 * np.pi / 64) * np.cos((2 * x + 1) * 5 * np.pi / 64) for y in k for x in k)
    assert np.isclose(features.dct(grid)[3, 5], want)
    assert features.laplacian_variance(frame[:2]) == 0 and features.laplacian_variance(np.full((9, 9), 3, np.uint8)) == 0
    box = np.zeros((40, 60), np.uint8)
    box[10:30, 5:50] = 200
    assert features.trim_borders(box).shape == (20, 45)
    assert features.trim_borders(np.zeros((4, 5), np.uint8)).shape == (4, 5)


def test_frame_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, b"x"), (1, 1, 4, 4, bytes(range(16))), (2, 0, None, 4, b"")], "file_id long, ts_ms long, w int, h int, pixels binary")
    f = features.frame_features(df)
    assert {(r["file_id"], r["ts_ms"]): r["error"] for r in f.collect()} == {(1, 0): "empty frame", (1, 1): None, (2, 0): "empty frame"}
    assert {r["file_id"]: r["frames"] for r in features.file_features(f).collect()} == {1: 1, 2: 0}


def test_kept_scenes_compare_with_the_last_kept(spark):
    hs = [7, 7, 7 ^ 0xFF, 7 ^ 0xFF ^ 0b111, 7 ^ 0xFF ^ 0b111111]
    seq = spark.createDataFrame([(1, [(k * 1000, h) for k, h in enumerate(hs)]), (2, [])], "file_id long, scenes array<struct<ts_ms: long, phash: long>>")
    out = {r["file_id"]: [s["ts_ms"] for s in r["scenes"]] for r in features.kept_scenes(seq).collect()}
    assert out == {1: [0, 2000, 4000], 2: []}
    sim = seq.select(features.sequence_similarity(F.col("scenes"), F.col("scenes")).alias("s")).collect()
    assert [r["s"] for r in sim] == [1.0, 1.0]


def test_eta_holds_and_counts_down():
    step = changes.next_shown
    first = step(changes.Shown(), 0, 0, 1000, 5)
    assert first.label() is None
    second = step(first, 1, 100, 900, 5)
    assert second.speed == 100 and second.label() == 9
    third = step(second, 1, 800, 100, 5)
    assert third.label() == 7 and step(third, 1, 100, 0, 0).label() is None
    held, out = changes.Shown(10.0, 50.0, 0), []
    for _ in range(11):
        held = step(held, 1, 0, 0, 3)
        out.append(held.label())
    assert out[0] == 49 and out[7] == 42 and out[8] is None


def test_eta_of_a_table_equals_the_steps(spark):
    """Series in one table, with a repeated time, bytes that grow and an end."""
    rows = [("a", 0, 1000), ("a", 1000, 900), ("a", 1000, 900), ("a", 4000, 950), ("a", 9000, 300), ("a", 12000, 0), ("b", 5, 10), ("b", 2005, 4)]
    s = spark.createDataFrame([(*r, r[2], 0, 0, 0, 1) for r in rows], "series string, ts_ms long, pending_bytes long, pending long, running long, done long, failed long, total long")
    got = sorted((r["series"], r["ts_ms"], r["eta_seconds"]) for r in changes.smoothed_eta(s).collect())
    want, past = [], {}
    for name, t, b in rows:
        now, t0, b0 = past.get(name, (changes.Shown(), t, b))
        now = changes.next_shown(now, (t - t0) / 1000, b0 - b, b, b)
        past[name] = (now, t, b)
        want.append((name, t, now.label()))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_debounced_stream(spark, tmp_path):
    rows = [(1, 0, "create", "/a.mp4", None), (2, 100, "remove", "/a.mp4", None), (3, 900, "modify", "/a.mp4", None), (4, 50, "rename_both", "/b.mkv", "/c.mkv"), (5, 60, "create", "/x.txt", None), (6, 120_000, "create", "/z.mp4", None)]
    df = spark.createDataFrame(rows, "event_id long, ms long, kind string, path string, new_path string")
    df = df.select("event_id", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms")).alias("ts"), "kind", "path", "new_path")
    for k in range(2):
        df.where("event_id % 2 = " + str(k)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = watch.debounced_changes(watch.read_events(spark, f"{tmp_path}/in/*"))
    q = watch.for_each_batch(stream, watch.merge_batches(f"{tmp_path}/out"), f"{tmp_path}/cp")
    q.awaitTermination(90)
    assert q.exception() is None
    got = {r["path"]: r["change"] for r in watch.read_latest(spark, f"{tmp_path}/out").collect()}
    assert got == {"/a.mp4": "Upsert", "/b.mkv": "Remove", "/c.mkv": "Upsert"}
    batch = {(r["path"], r["n"]) for r in changes.debounce(changes.classify_events(df), "500 milliseconds").collect()}
    assert ("/a.mp4", 2) in batch and ("/a.mp4", 1) in batch


def test_smoothed_eta_stream_equals_batch(spark, tmp_path):
    rows = [("s", k * 1000, 1000 - 37 * k, 20 - k) for k in range(20)]
    df = spark.createDataFrame(rows, "series string, ts_ms long, pending_bytes long, left long")
    for k in range(2):
        part = df.where(f"ts_ms {'<' if k == 0 else '>='} 9000").select("series", F.timestamp_millis("ts_ms").alias("ts"), "pending_bytes", "left")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)
    stream = spark.readStream.schema(watch.SAMPLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    watch.for_each_batch(watch.smoothed_eta_stream(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b{i}"), f"{tmp_path}/cp").awaitTermination(90)
    got = {r["ts_ms"]: r["eta_seconds"] for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()}
    want = changes.smoothed_eta(df.select("series", "ts_ms", "pending_bytes", F.col("left").alias("pending"), F.lit(0).alias("running"))).collect()
    assert got == {r["ts_ms"]: r["eta_seconds"] for r in want}


def test_listing_and_store(spark, tmp_path):
    for name in ("a.MP4", "sub/b.mkv", "sub/note.txt", "Recovery/c.mp4", "found.007/d.mp4", "sub/deep/e.avi"):
        p = tmp_path / "media" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    root = f"{tmp_path}/media"
    got = [r["path"].removeprefix(root) for r in listing.list_files(spark, root).collect()]
    assert got == ["/a.MP4", "/sub/b.mkv", "/sub/deep/e.avi"]
    assert listing.list_files(spark, root, max_depth=2).count() == 2
    assert listing.content_hashes(spark, root).count() == 6
    store.write_features(spark.range(3), f"{tmp_path}/f", "tier1")
    assert store.read_features(spark, f"{tmp_path}/f", "tier1").count() == 3
    with pytest.raises(Exception, match="not a tier2 table"):
        store.read_features(spark, f"{tmp_path}/f", "tier2").collect()


def test_twins(spark):
    f = spark.createDataFrame([(1, "/a", "h", None), (2, "/b", "h", None), (3, "/c", "h", 5), (4, "/d", "g", None)], "id long, path string, content_hash string, deleted_at long")
    fp = spark.createDataFrame([(1,), (2,), (3,), (4,)], "file_id long")
    assert {r["id"]: r["twin_id"] for r in selection.twins_with_features(f, fp).collect()} == {1: 2, 2: 1, 3: 1}
