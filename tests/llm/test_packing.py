import random
import zlib
from collections import Counter

import numpy as np
import pytest
from mirrorsift.llm import packing
from mirrorsift.llm.packing import Encoder, pack_documents, plan
from mirrorsift.llm.queries import tokenizer_file
from tokenizers import Tokenizer


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 64, 257])
    counts = dict(Counter(rng.choice([rng.randint(1, capacity), capacity, 1 + capacity // 2, 3]) for _ in range(rng.randint(0, 800))))
    used = Counter()
    for pattern, times in plan(counts, capacity):
        assert sum(pattern) <= capacity and times > 0
        for length in pattern:
            used[length] += times
    assert used == Counter(counts)
    total = sum(k * v for k, v in counts.items())
    bins = sum(times for _, times in plan(counts, capacity))
    assert bins >= -(-total // capacity)


def test_exact_fillings_are_found():
    assert sum(n for _, n in plan({70: 5, 30: 5}, 100)) == 5
    assert sum(n for _, n in plan({60: 4, 25: 4, 15: 4}, 100)) == 4
    assert sum(n for _, n in plan({50: 3, 20: 3, 16: 3, 14: 3}, 100)) == 3
    assert sum(n for _, n in plan({50: 7}, 100)) == 4
    assert plan({}, 100) == []


def check(docs, out, capacity):
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        raw = np.array(ids, "<u4").tobytes()
        for k, a in enumerate(range(0, len(ids), capacity)):
            want[(r["doc_id"], k, a, min(capacity, len(ids) - a), zlib.crc32(raw[4 * a : 4 * (a + capacity)]))] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_odd_rows(odd, none):
    check(odd, pack_documents(odd, tokenizer_file()), 4096)
    assert pack_documents(none, tokenizer_file()).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, pack_documents(docs, tokenizer_file(), capacity=512), 512)


def test_chunks_are_encoded_like_whole_texts():
    rng = random.Random(4)
    letters = [chr(k) for k in [*range(33, 127), *range(161, 384), 0x3A3, 0x130, 0x301, 0x3000, 0x85, 0xA0, 0x1C, 0x4E2D]] + [" ", "\n", "<|endoftext|>", "'s", "'LL"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    whole = Tokenizer.from_file(tokenizer_file())
    got = Encoder(tokenizer_file()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_plan_takes_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(4)
    kinds = (rng.integers(1, 1025, 20_000), rng.integers(75, 451, 20_000), np.clip(rng.lognormal(4, 1, 20_000).astype(int), 1, 1024), rng.integers(250, 1025, 300))
    for lengths, slack in zip(kinds, (1.005, 1.01, 1.001, 1.2), strict=True):
        counts = dict(Counter(lengths.tolist()))
        found = packing.plan(counts, 1024)
        used = Counter()
        for pattern, times in found:
            assert sum(pattern) <= 1024
            for length in pattern:
                used[length] += times
        bins = sum(n for _, n in found)
        assert used == counts and bins <= sum(n for _, n in packing._best_fit(counts, 1024)) and bins <= slack * -(-int(lengths.sum()) // 1024)


def test_worker_memory_is_bounded_by_characters(monkeypatch):
    path = tokenizer_file()
    own, whole = packing.Encoder(path), packing.Encoder(path).whole
    monkeypatch.setattr(packing, "MOST_CHARS", 2_000)
    texts = ["longword" * 400, "short words here", "x" * 1000 + " tail"] + [f"some{k}word other{k}thing" for k in range(300)]
    for at in range(0, len(texts), 10):
        some = texts[at : at + 10]
        assert own.encode(some) == [packing.Encoder.pack(whole.encode(t, add_special_tokens=False).ids) for t in some]
        assert own.held <= 2_000 + 10 * 2 * 40 and max(map(len, own.memory)) <= packing.LONG_CHUNK
