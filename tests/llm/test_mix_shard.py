import math
import random
from collections import Counter

import pytest
from mirrorsift.llm import mixing, sharding
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(5))
def test_exponent_meets_entropy_and_limit(seed):
    rng = random.Random(seed)
    tokens = [rng.randint(1, 10_000) for _ in range(rng.randint(1, 12))]
    total = sum(tokens)
    shares = [t / total for t in tokens]
    weights = lambda a: [s**a / sum(x**a for x in shares) for s in shares]
    natural = -sum(s * math.log(s) for s in shares)
    target = (natural + math.log(len(shares))) / 2
    a, _, _, entropy = mixing.choose_exponent(shares, total, total, target, None)
    assert math.isclose(entropy, target, abs_tol=1e-6) and math.isclose(entropy, -sum(w * math.log(w) for w in weights(a)), abs_tol=1e-9)
    a, budget, _, _ = mixing.choose_exponent(shares, total, None, None, 1.7)
    repeats = [w * budget / t for w, t in zip(weights(a), tokens, strict=True)]
    assert max(repeats) <= 1.7 + 1e-3 and min(repeats) >= 1 - 1e-9
    assert a == 0 or max(repeats) > 1.69 - 1 / min(tokens)


def test_sources_get_their_weights(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), ["big", "mid", "small", None][min(3, int(rng.expovariate(0.8)))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_report(docs, repetition_limit=2.0, block_tokens=2000).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    own, used = Counter(), Counter()
    for i, _, s in rows:
        own[s] += size[i]
    for r in out:
        assert r["n_tokens"] == size[r["doc_id"]]
        used[r["source"]] += r["n_tokens"]
    repeats = {s: used[s] / own[s] for s in own}
    assert min(repeats.values()) >= 1 - 1e-9 and 1.9 < max(repeats.values()) <= 2.0 + 1e-9
    assert {r["doc_id"] for r in out} == set(size)
    assert Counter((r["doc_id"], r["epoch"]) for r in out).most_common(1)[0][1] == 1
    total = sum(used.values())
    blocks = Counter(r["block"] for r in out)
    for b in list(range(len(blocks)))[1:-2]:
        part = Counter()
        for r in out:
            if r["block"] == b:
                part[r["source"]] += r["n_tokens"]
        for s in own:
            assert abs(part[s] - 2000 * used[s] / total) <= 62
    again = mixing.mix_documents(docs, repetition_limit=2.0).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in again} == Counter(r["doc_id"] for r in out)


def test_mix_odd_rows(odd, none):
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}
    assert mixing.mix_report(odd, target_entropy=0.5, repetition_limit=None).count() > 0
    assert mixing.mix_documents(none).count() == 0 and mixing.mix_report(none).count() == 0
    empty = odd.where("doc_id in (1, 2)")
    assert mixing.mix_report(empty).count() == 2 and mixing.mix_documents(empty).count() == 2


def least_largest(sizes, shards):
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return best[-1]


def test_minimax_against_all_cuts():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, 5, rng.randint(1, 60)]) for _ in range(rng.randint(1, 20))]
        shards = rng.randint(1, 8)
        assert sharding.minimax(sizes, shards) == least_largest(sizes, shards)


def test_even_cuts_stay_within_the_capacity():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.choice([1, 5, rng.randint(1, 60)]) for _ in range(rng.randint(1, 40))]
        shards = rng.randint(1, 8)
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        capacity = sharding.minimax(sizes, shards)
        ends = sharding.even_ends(sums, capacity, shards)
        parts = [sums[b] - sums[a] for a, b in zip([0, *ends], ends)]
        assert ends[-1] == len(sizes) and max(parts) == capacity and min(parts) >= 0
    sizes = [1] * 50 + [60] + [1] * 50
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    ends = sharding.even_ends(sums, 60, 8)
    parts = [sums[b] - sums[a] for a, b in zip([0, *ends], ends)]
    assert max(parts) == 60 and min(parts) >= 6


def test_shards(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 200) + str(rng.randint(0, 40) if i % 3 else 0)) for i in range(900)] + [(900 + k, "hot text") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard_documents(docs).withColumn("h", F.lit(0)).collect()
    by_text = {}
    for r in out:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert len(out) == len(rows) and all(len(s) == 1 for s in by_text.values())
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    hashes = docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()
    weight = Counter()
    for r in out:
        weight[dict(rows)[r["doc_id"]]] += r["size"]
    ordered = [weight[r["text"]] for r in sorted(hashes, key=lambda r: r["h"] % 2**64)]
    largest = max(sum(r["size"] for r in out if r["shard"] == s) for s in range(8))
    assert largest == sharding.minimax(ordered, 8)
    assert sharding.shard_documents(odd).count() == odd.count() and sharding.shard_documents(none).count() == 0
