import numpy as np
from mirrorsift.llm.embedding_dedup import embedding_links


def brute(ids, x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        low = np.where(hit, label[None, :], label[:, None]).min(1)
        if (low == label).all():
            return hit.sum(1), label
        label = low


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long, cell int").repartition(5)
    return {r["vec_id"]: r for r in embedding_links(df, **more).collect()}, df


def clustered(seed=2, n=700, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n - 60, 7):
        x[k + 1] = x[k] + rng.normal(size=dim) * rng.choice([0.1, 0.25, 0.32, 0.4])
    x[-60:] = x[3] + rng.normal(size=(60, dim)) * 0.2  # a dense group
    x[-80:-70] = x[5]  # exact copies
    return x.astype(np.float32)


def test_links_and_components(spark):
    x = clustered()
    ids = list(range(len(x)))
    rows = [(i, [float(v) for v in x[i]], 0, 1, 2) for i in ids]
    want, root = brute(ids, x.astype(np.float64))
    for block in (2048, 16):
        out, _ = run(spark, rows, block=block)
        found = np.array([out[i]["n_links"] for i in ids])
        assert found.sum() >= 0.99 * want.sum() and (found <= want).all()
        assert np.mean([out[i]["component_id"] == root[i] for i in ids]) >= 0.99
        assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in ids)


def test_links_count_alike_from_both_sides(spark):
    x = clustered(seed=5, n=300, dim=16)
    out, _ = run(spark, [(i, [float(v) for v in x[i]], 0, 1, 2) for i in range(len(x))])
    assert sum(r["n_links"] for r in out.values()) % 2 == 0


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [5.0])]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "vec_id long, embedding array<float>, label int, rep long, cell int")
    out = embedding_links(df).collect()
    assert len(out) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    for k in (1, 2, 3, 4, 5, 6, 9, 11, None):
        assert links[k] == (0, k)
    assert links[8] == (3, 7) and links[7] == (3, 7)
    assert embedding_links(df.limit(0)).count() == 0
