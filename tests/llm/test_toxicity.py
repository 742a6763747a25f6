import random
import zlib

import numpy as np
from mirrorsift.llm import toxicity


def texts(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "le", "so") for c in ("n", "t", "")]
    out, y = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(20, 160))
        if k % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grubble", "Grubblex,", "zanky", "zankyo"])
        out.append(" ".join(words))
        y.append(int(k % 3 == 0))
    return out, np.array(y)


def test_held_out_accuracy():
    x, y = texts(700, 1)
    model = toxicity.fit(x, y)
    fresh, want = texts(200, 2)
    score = toxicity.score_texts(fresh, model)
    assert ((score >= 0.7) == want).mean() > 0.97
    # one bad passage anywhere in a long text counts
    long = " ".join(fresh[k] for k in np.flatnonzero(want == 0)[:60])
    assert toxicity.score_texts([long, long + " zanky grubble zanky"], model)[1] >= 0.7


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._new(5, rng).items()}
    names = [b"alpha", b"beta", b"gam", b"d"]
    words = (np.array([1, 2, 0, 5]), *toxicity.char_grams(names))
    ids, there = rng.integers(0, 4, (toxicity.WINDOW, 3)), np.arange(toxicity.WINDOW)[:, None] < np.array([[24, 7, 1]])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 1.5])

    def loss():
        x = toxicity._inputs(p, *words).astype(np.float64)
        z = toxicity._logits(p, (x @ p["wf"] + p["bf"])[ids], (x @ p["wb"] + p["bb"])[ids], there)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    grads = {}
    saved = toxicity._step
    toxicity._step = lambda p_, g, *_: grads.update(g)
    try:
        toxicity._train_batch(p, ids, there, y, weight, words, {}, 0.1)
    finally:
        toxicity._step = saved
    for name in ("wf", "ub", "att", "att_v", "out", "out_b", "bf"):
        flat, g = p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            own = flat[k]
            flat[k] = own + 2e-3
            up = loss()
            flat[k] = own - 2e-3
            down = loss()
            flat[k] = own
            assert abs((up - down) / 4e-3 - g[k]) < 2e-3 + 0.03 * abs(g[k]), name


def test_windows_cover_all_words():
    begin, length, text = toxicity.windows(np.array([0, 1, 24, 25, 100]))
    seen = [set() for _ in range(5)]
    base = np.cumsum([0, 0, 1, 24, 25])
    for b, n, t in zip(begin, length, text, strict=True):
        assert 0 < n <= toxicity.WINDOW
        seen[t].update(range(b - base[t], b - base[t] + n))
    assert [len(s) for s in seen] == [0, 1, 24, 25, 100]


def test_odd_rows(odd, none, labels):
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert toxicity.toxicity_scores(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
