"""Quality rules: counting rules over whole texts, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams, fitted with numpy on a bounded
sample of labelled rows, calibrated on rows held back from the fit, and scored in Arrow batches against a
fixed threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, gram_hashes, mix, slices, split_words, word_hashes

#: Labelled rows of each class that the model is fitted on, at most, and characters of a class beyond which no more rows join.
FIT_ROWS, FIT_CHARS = 1500, 24_000_000
#: log2 of the number of hashed features of each kind (words, word pairs, 2- and 4-byte windows).
BITS = 16
KINDS = 4
#: Calibrated probability of good quality below which a text is dropped.
KEEP_FROM = 0.5

SYMBOLS = "#*$%&|<>"


def base_counts(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text, with all its word hashes."""
    words, counts = split_words(texts)
    hashes = word_hashes(words)
    chars, symbols, lines = (np.zeros(len(texts), np.int64) for _ in range(3))
    for k, text in enumerate(texts):
        if text:
            chars[k] = len(text) - sum(map(text.count, WORD_GAPS))
            symbols[k] = sum(map(text.count, SYMBOLS))
            full = [x for x in text.split("\n") if x.strip(WORD_GAPS)]
            lines[k] = len(full) - len(set(full))
    repeated = np.zeros(len(texts), np.int64)
    if len(hashes) >= 5:
        owner = np.repeat(np.arange(len(texts)), counts)
        grams = gram_hashes(hashes, 5)
        whole = owner[:-4] == owner[4:]
        keys = grams + mix(owner[:-4].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys[whole], kind="stable")
        places = np.flatnonzero(whole)[order]
        own = keys[places]
        same = np.zeros(len(own) + 1, bool)
        same[1:-1] = own[1:] == own[:-1]
        twice = places[same[1:] | same[:-1]]
        marks = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + 5, -1)
        covered = np.cumsum(marks)[:-1] > 0
        repeated = np.bincount(owner[covered], minlength=len(texts)).astype(np.int64)
    return counts, chars, symbols, lines, repeated, hashes


def _features(texts: list[str | None], hashes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed feature numbers in text order, and how many each text has."""
    shift = np.uint64(64 - BITS)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = [((mix(hashes) >> shift).astype(np.int32), counts)]
    pairs = gram_hashes(hashes, 2)
    whole = owner[:-1] == owner[1:] if len(owner) > 1 else np.zeros(0, bool)
    out.append(((pairs[whole] >> shift).astype(np.int32), np.maximum(counts - 1, 0)))
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for n in (2, 4):
        if len(flat) >= n:
            code = np.zeros(len(flat) - n + 1, np.uint32)
            for k in range(n):
                code |= flat[k : len(flat) - n + 1 + k] << np.uint32(8 * k)
            number = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
            out.append((number[owner[: len(number)] == owner[n - 1 :]], np.maximum(sizes - n + 1, 0)))
        else:
            out.append((np.zeros(0, np.int32), np.zeros(len(texts), np.int64)))
    return out


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return (running[ends] - running[ends - counts]) / np.maximum(counts, 1)


def raw_scores(texts: list[str | None], hashes: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    score = np.full(len(texts), model["bias"], np.float64)
    for kind, (number, own) in enumerate(_features(texts, hashes, counts)):
        score += _means(model["weights"][kind][number], own)
    return score


def fit(texts: list[str], labels: np.ndarray, rounds: int = 120) -> dict:
    """Weights for the mean over each kind's n-grams, with a calibration (slope, offset) from held-back rows."""
    labels = labels.astype(np.float64)
    if len(set(labels.tolist())) < 2:  # one class only: its rate is all that can be learned
        rate = (labels.sum() + 1) / (len(labels) + 2)
        return {"weights": np.zeros((KINDS, 1 << BITS), np.float32), "bias": 0.0, "slope": 1.0, "offset": float(np.log(rate / (1 - rate)))}
    words, counts = split_words(texts)
    kinds = _features(texts, word_hashes(words), counts)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held = np.zeros(len(texts), bool)
    use = ~held
    weight = np.where(labels == 1, 0.5 / max(1, labels[use].sum()), 0.5 / max(1, (1 - labels)[use].sum())) * use
    packed = []
    for number, own in kinds:
        owner = np.repeat(np.arange(len(texts)), own)
        cell, times = np.unique(owner.astype(np.int64) << BITS | number, return_counts=True)
        row, column = cell >> BITS, (cell & ((1 << BITS) - 1)).astype(np.int64)
        packed.append((row, column, times / np.maximum(own, 1)[row]))
    weights, moment, second, bias = np.zeros((KINDS, 1 << BITS)), np.zeros((KINDS, 1 << BITS)), np.zeros((KINDS, 1 << BITS)), 0.0
    score = np.zeros(len(texts))
    for step in range(1, rounds + 1):
        score = np.full(len(texts), bias)
        for kind, (row, column, value) in enumerate(packed):
            score += np.bincount(row, value * weights[kind][column], minlength=len(texts))
        slack = weight * (1 / (1 + np.exp(-score)) - labels)
        bias -= 0.5 * slack.sum()
        for kind, (row, column, value) in enumerate(packed):
            g = np.bincount(column, value * slack[row], minlength=1 << BITS) + 1e-7 * weights[kind]
            moment[kind] = 0.9 * moment[kind] + 0.1 * g
            second[kind] = 0.99 * second[kind] + 0.01 * g * g
            weights[kind] -= 0.3 * (moment[kind] / (1 - 0.9**step)) / (np.sqrt(second[kind] / (1 - 0.99**step)) + 1e-6)
    # Platt scaling at the classes' own rates
    who = held if held.any() else use
    s, y = score[who], labels[who]
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * s + offset, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(v * s * s).sum() + 1e-6, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess, np.array([((p - target) * s).sum(), (p - target).sum()]))
        slope, offset = slope - float(np.clip(move[0], -2, 2)), offset - float(np.clip(move[1], -2, 2))
    return {"weights": weights.astype(np.float32), "bias": float(bias), "slope": max(slope, 1e-3), "offset": offset}


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, most_chars: int, rule=None) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most rows rows of each class, chosen by a hash of the id.

    Rows of a class beyond most_chars characters in all, in the order of the hash, are left out as a whole. The bounds
    hold for the fit alone; scores read all texts.
    """
    chosen = labels.where(f"{column} is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    if rule is not None:
        chosen = chosen.where(rule)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    picks = [r for v in (0, 1) for r in chosen.where(F.col("label") == v).orderBy(*order).limit(rows).collect()]
    if not picks:
        return [], np.zeros(0)
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("text is not null")

    def few(ids: list[int]) -> DataFrame:
        # at most 2 * rows rows; from Arrow, since a list would start another set of Python workers in each executor
        return F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())})))

    sizes: dict[int, int] = {}
    for r in texts.join(few(sorted({r["doc_id"] for r in picks})), "doc_id").select("doc_id", F.length("text").alias("n")).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n"]
    taken, wanted = [0, 0], {}
    for r in picks:
        if r["doc_id"] in sizes and taken[r["label"]] < most_chars:
            taken[r["label"]] += sizes[r["doc_id"]]
            wanted.setdefault(r["doc_id"], set()).add(r["label"])
    found = texts.join(few(sorted(wanted)), "doc_id").collect() if wanted else []
    got = sorted({(zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"], v) for r in found for v in wanted[r["doc_id"]]})
    return [g[2] for g in got], np.array([g[3] for g in got])


def quality_rules(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text) with the rules' counts and verdicts.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good.
    labels (doc_id, quality) teach the classifier; without any, all texts have p_good 0.5. Null and empty texts
    have no words and fail. Ties at the threshold are kept. Other columns are ignored.
    """
    texts, y = labelled_sample(docs, labels, "quality", fit_rows, FIT_CHARS)
    model = fit(texts, y) if texts else {"weights": np.zeros((KINDS, 1 << BITS), np.float32), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            *counts, hashes = base_counts(texts)
            n, repeated = counts[0], counts[4]
            score = model["slope"] * raw_scores(texts, hashes, n, model) + model["offset"]
            good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            failed = (n < 10) | (100 * repeated > 20 * n)
            arrays = [batch.column("doc_id"), *map(pa.array, counts), pa.array(failed), pa.array(~failed & (good >= keep_from)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
    )
