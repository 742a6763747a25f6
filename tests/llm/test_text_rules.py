import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from mirrorsift.llm import licenses, pii, quality_rules

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            own.append(m.span())
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(2500):
        text = "".join(rng.choices(rng.choice(["ab@.1 ", "12.5 ", "0123456789 -", "+12() .-", "a@.b-_%+1", "é@a.1+ -"]), k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def test_checksums_and_context():
    text = "é card 4111 1111 1111 1111, iban GB82 WEST 1234 5698 7654 32 and DE00 1234 5678 9012 3456 78"
    row = pii.digest(text)
    assert row[2] == 1 and "iban:33:60" in row[5] and row[5].count("iban") == 1
    assert "short_card" in pii.digest("credit card 378282246310005 thanks")[5]
    assert "short_card" not in pii.digest("number 378282246310006 credit")[5]
    assert "social" in pii.digest("her ssn is 123-45-6789.")[5] and "social" not in pii.digest("part 123-45-6789.")[5]
    assert pii.digest(None)[4] == hashlib.sha256(b"").hexdigest() and pii.digest(None)[5] == ""


def test_pii_odd_rows(odd, none):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == odd.count() and pii.find_personal_data(none).count() == 0


def test_quality_counts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a a a a a a a a a a a", "x\n\nx\n x\n", "é#*$%&|<> z"]
    texts += ["".join(rng.choices(["ab ", "cd ", "e\n", "f\t", "#", "a b c d e "], k=rng.randint(0, 60))) for _ in range(200)]
    *counts, _ = quality_rules.base_counts(texts)
    for k, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[a : a + 5]) for a in range(len(words) - 4))
        cover = {b for a in range(len(words) - 4) if grams[tuple(words[a : a + 5])] > 1 for b in range(a, a + 5)}
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(cover))
        assert tuple(int(c[k]) for c in counts) == want


def test_quality_learns_and_odd_rows(spark, odd, none, labels):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "river", "stone", "light", "walks", "under"], k=40)) for _ in range(120)]
    bad = [" ".join(rng.choices(["BUY!!", "NOW!!", "free!!", "click|", "win|"], k=40)) for _ in range(120)]
    model = quality_rules.fit(good[:80] + bad[:80], np.array([1] * 80 + [0] * 80))
    *counts, hashes = quality_rules.base_counts(good[80:] + bad[80:])
    score = model["slope"] * quality_rules.raw_scores(good[80:] + bad[80:], hashes, counts[0], model) + model["offset"]
    assert (score[:40] > 0).all() and (score[40:] < 0).all()
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(odd, labels).collect()}
    assert rows[1]["base_failed"] and rows[1]["n_words"] == 0 and not rows[1]["kept"]
    assert quality_rules.quality_rules(odd, labels.limit(0)).count() == odd.count()
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    grams = np.random.default_rng(3).integers(0, 50, 300).astype(np.uint64)
    kept = set(licenses.winnow(grams))
    assert all(kept.intersection(range(k, k + licenses.WINNOW)) for k in range(len(grams) - licenses.WINNOW + 1))


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(max(row[-1], last[k + 1], last[k] + 1 if x == y else 0))
    return row[-1]


def test_alignment_against_whole_table():
    rng = np.random.default_rng(5)
    for _ in range(150):
        t = rng.integers(0, 12, rng.integers(3, 30)).astype(np.uint64)
        keep = rng.random(len(t)) > 0.15
        d = np.concatenate([rng.integers(20, 30, 4), t[keep], rng.integers(20, 30, 5)]).astype(np.uint64)
        n, first, end = licenses.align(t, d, 4, band=40)
        assert n == brute_lcs(t.tolist(), d.tolist()) and 4 <= first < end <= 4 + keep.sum()


def test_license_spans(spark, odd, none):
    text = "intro words here " + licenses.TEMPLATES["MIT"].replace("sublicense, ", "").replace("persons", "people") + " outro"
    df = spark.createDataFrame([(1, text), (2, "Licensed under CC BY-NC 4.0."), (3, "This license is not a known one at all")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    name, coverage, begin, end = rows[1]["licenses"].split(":")
    assert name == "MIT" and int(coverage) > 950 and text[int(begin) :].startswith("Permission") and text[: int(end)].endswith("Software.")
    assert rows[2]["licenses"].startswith("CC-BY-NC-4.0-line:1000:0:28") and rows[3]["n_licenses"] == 0
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0
