import random
import re
from collections import Counter, defaultdict

from mirrorsift.llm.ngram_join import ngram_jaccard_components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter((i, j) for ids in where.values() for k, i in enumerate(ids) for j in ids[:k])
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_copies_of_a_text_and_a_common_passage(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"e{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    for i in range(160, 260):
        own = [f"o{i}y{k}" for k in range(rng.randint(5, 250))]
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    rows += [(260 + i, rows[i][1]) for i in range(0, 40, 3)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(ngram_jaccard_components(docs)) == want
    assert got(ngram_jaccard_components(docs, block=16)) == want  # groups that are compared block by block


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(ngram_jaccard_components(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, odd, none):
    out = got(ngram_jaccard_components(odd))
    assert out[1] == (0, 1) and out[2] == (0, 2) and out[3] == (0, 3)
    assert out[6][1] == 5 and out[14][1] == 5 and out[13] == (1, 12)
    assert ngram_jaccard_components(odd).count() == odd.count()
    assert ngram_jaccard_components(none).count() == 0
    assert ngram_jaccard_components(odd.where(F.col("doc_id") == 4)).count() == 1


def test_classes_of_rows_without_id_connect_others(spark):
    base = [f"w{k}" for k in range(100)]
    a, c = list(base), list(base)
    a[10], c[60] = "x", "y"  # each is near base, but not near the other one
    a[30], c[80] = "x2", "y2"
    docs = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(base)), (2, " ".join(c)), (3, "far away from all of them")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_components(docs).collect()}
    assert out == {1: 1, None: 1, 2: 1, 3: 3}
