"""What a Python worker holds: between tasks little more than before them, and little at once while it scores."""

import json
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from mirrorsift.llm import toxicity
from mirrorsift.llm.quality_rules import labelled_sample

HEAD = """
import json, re, sys, types
from mirrorsift.llm import common

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", f.read()))) / 1024
"""

LEFT = """
def run(batches):
    for b in batches:
        small = [bytes(600 + k % 7) for k in range(200_000)]
        kept.extend(small[::50])
        yield b

kept = []
sys.modules["_packing_memory"] = types.ModuleType("_packing_memory")
before = held()
list(common.tidy(run, ("_packing_memory",))(iter([1])))
mine = "_packing_memory" in sys.modules
list(common.tidy(run)(iter([1])))
print(json.dumps([held() - before, mine, "_packing_memory" in sys.modules]))
"""


def told(code):
    return json.loads(subprocess.run([sys.executable, "-c", HEAD + code], capture_output=True, text=True, check=True, timeout=300).stdout)


def test_inputs_take_little_at_once():
    rng = np.random.default_rng(0)
    p = toxicity._new(5, rng)
    rows, ends = rng.integers(0, toxicity.CHAR_ROWS, 400_000).astype(np.int32), np.arange(1, 20_001) * 20
    tracemalloc.start()
    out = toxicity._inputs(p, np.zeros(20_000, np.int64), rows, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(out[[0, 4000, -1], toxicity.WORD_DIM :], [p["char"][rows[20 * k : 20 * k + 20]].mean(0) for k in (0, 4000, 19_999)], atol=1e-6)
    assert peak < 20e6, peak


def test_a_waiting_worker_is_small():
    held, kept, left = told(LEFT)
    assert held < 60 and kept and not left


def test_scoring_takes_little_at_once():
    rng = np.random.default_rng(1)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (20_000, 7))])
    texts = [" ".join(words[rng.integers(0, 20_000, 600)]) for _ in range(200)]  # about 1 MB
    model = {"p": toxicity._new(3, rng), "vocabulary": {words[k].encode(): k + 1 for k in range(3)}, "slope": 1.0, "offset": 0.0}
    each = np.array([toxicity.score_texts([t], model)[0] for t in texts[:20]])
    tracemalloc.start()
    got = toxicity.score_texts(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:20], each, atol=1e-5) and got.std() > 0
    assert peak < 25e6, peak


def test_labelled_sample_starts_no_python_workers(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("rows go through Python workers"))
    texts, y = labelled_sample(docs, labels, "toxic", 5, 1000)
    assert sorted(y.tolist()) == [0] * 5 + [1] * 5 and all(int(t.split()[1]) % 2 == v for t, v in zip(texts, y, strict=True))
