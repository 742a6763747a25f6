"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own vector (frequent words of the fit) beside the mean of its hashed character n-gram
vectors. A text is read in overlapping windows; each window gives a logit, the highest one counts for the
text and is calibrated on rows held back from the fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, tidy
from .quality_rules import labelled_sample

#: Labelled rows of each class that the model is fitted on, at most, and characters of a class beyond which no more rows join.
FIT_ROWS, FIT_CHARS = 1500, 24_000_000
#: Words of a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, POOL_DIM = 8, 8, 12, 8
#: Hashed character n-grams, and words with a vector of their own, at most.
CHAR_ROWS, WORD_ROWS = 1 << 13, 4096
#: Texts of the fit that a word must be in to get a vector of its own.
WORD_TEXTS = 8
#: Bytes of text that a worker scores at once; a longer text is scored as a whole.
SLICE_BYTES = 1_000_000
#: Logit of a text without words before calibration.
EMPTY_LOGIT = -12.0
#: Rounds over a small sample in each phase of the fit, at most.
MOST_ROUNDS = 24
#: Shrinking of word and character vectors at each step of the fit, times the rate.
DECAY = 0.5
MARKS = b".,;:!?\"'()[]{}<>*_-"


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(MARKS) or w for w in text.lower().encode("utf-8", "surrogatepass").split()] if text else []


class _Codes(dict):
    """A number for each distinct word, in the order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts, one after another, as numbers of distinct ones; each text's count; the distinct ones.

    One text's words are held at a time.
    """
    index, codes = _Codes(), []
    for text in texts:
        own = words_of(text)
        codes.append(np.fromiter(map(index.__getitem__, own), np.int64, len(own)))
    return np.concatenate([*codes, np.zeros(0, np.int64)]), np.array([len(c) for c in codes], np.int64), list(index)


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the hashed 2-, 3- and 4-byte windows of each word between boundary marks, and each word's end in them."""
    marked = [b"\x01" + w + b"\x02" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    for n in (2, 3, 4):
        if len(flat) < n:
            continue
        code = np.full(len(flat) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ flat[k : len(flat) - n + 1 + k]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
        whole = owner[: len(code)] == owner[n - 1 :]
        rows.append(code[whole].astype(np.int32))
        owners.append(owner[: len(code)][whole])
    if not rows:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    rows_, owners_ = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return rows_[order], np.cumsum(np.bincount(owners_, minlength=len(words)))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, text) of every window over texts that lie one after another."""
    per = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(counts) - counts, per) + nth * STRIDE
    return start, np.minimum(WINDOW, counts[text] - nth * STRIDE), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _new(words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = WORD_DIM + CHAR_DIM
    p = {"word": rng.normal(0, 0.1, (words + 1, WORD_DIM)), "char": rng.normal(0, 0.3, (CHAR_ROWS, CHAR_DIM))}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 0.4, (wide, 3 * HIDDEN))
        p[f"u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p[f"b{d}"] = np.zeros(3 * HIDDEN)
    p["att"], p["att_b"], p["att_v"] = rng.normal(0, 0.3, (2 * HIDDEN, POOL_DIM)), np.zeros(POOL_DIM), rng.normal(0, 0.3, POOL_DIM)
    p["out"], p["out_b"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _inputs(p: dict, word_row: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Input vectors of words."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    count = np.maximum(ends - begins, 1)
    out = np.empty((len(ends), WORD_DIM + CHAR_DIM), np.float32)
    out[:, :WORD_DIM] = p["word"][word_row]
    for at in range(0, len(ends), 4_000):  # bounded memory
        to = min(len(ends), at + 4_000)
        low, high = begins[at], ends[to - 1]
        some = p["char"][rows[low:high]]
        some = np.concatenate([some, np.zeros((1, CHAR_DIM), np.float32)])
        total = np.add.reduceat(some, begins[at:to] - low, axis=0) if to > at else some[:0]
        total[ends[at:to] == begins[at:to]] = 0
        out[at:to, WORD_DIM:] = total / count[at:to, None]
    return out


def _inputs_of(p: dict, names: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Input vectors of distinct words, some of them at a time: their n-grams take far more memory than the vectors."""
    parts = [names[at : at + 2_000] for at in range(0, len(names), 2_000)]
    return np.concatenate([_inputs(p, _rows_of(part, vocabulary), *char_grams(part)) for part in parts])


class _Steps:
    """The inputs by time, as x[ids] would have them, but made for one step when it is asked for."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids

    def __getitem__(self, t: int) -> np.ndarray:
        return self.x[self.ids[t]]


def _direction(x: np.ndarray | _Steps, there: np.ndarray, u: np.ndarray, back: bool, store: list | None, out: np.ndarray) -> None:
    """Hidden states into out (time, window, HIDDEN); x has the projected inputs by time."""
    steps, n = there.shape
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g, own = h @ u, x[t]
        zr = _sigmoid(own[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(own[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        now = c + z * (h - c)
        m = there[t][:, None]
        if store is not None:
            store.append((t, h, z, r, c, g[:, 2 * HIDDEN :], m))
        h = np.where(m, now, h)
        out[t] = h


def _direction_back(d_out: np.ndarray, store: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, n = d_out.shape[:2]
    d_x, d_u, d_h = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t, h, z, r, c, gc, m in reversed(store):
        d_h = d_h + d_out[t]
        own = d_h * m
        d_c = own * (1 - z) * (1 - c * c)
        d_z = own * (h - c) * z * (1 - z)
        d_r = d_c * gc * r * (1 - r)
        d_x[t] = np.concatenate([d_z, d_r, d_c], 1)
        d_g = np.concatenate([d_z, d_r, d_c * r], 1)
        d_u += h.T @ d_g
        d_h = d_h * ~m + own * z + d_g @ u.T
    return d_x, d_u


def _logits(p: dict, xf: np.ndarray | _Steps, xb: np.ndarray | _Steps, there: np.ndarray, store: dict | None = None) -> np.ndarray:
    """A logit for each window; only the hidden states are held for all steps at once, and what store asks for."""
    sf, sb = ([], []) if store is not None else (None, None)
    h = np.empty((*there.shape, 2 * HIDDEN), np.float32)
    _direction(xf, there, p["uf"], False, sf, h[:, :, :HIDDEN])
    _direction(xb, there, p["ub"], True, sb, h[:, :, HIDDEN:])
    e, each = np.empty(there.shape, np.float32), []
    for t in range(len(there)):
        a = np.tanh(h[t] @ p["att"] + p["att_b"])
        e[t] = np.where(there[t], a @ p["att_v"], -30)
        if store is not None:
            each.append(a)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    c = np.zeros(h.shape[1:], np.float32)
    for t in range(len(there)):
        c += alpha[t][:, None] * h[t]
    if store is not None:
        store.update(h=h, a=np.stack(each), alpha=alpha, c=c, sf=sf, sb=sb)
    return c @ p["out"] + p["out_b"][0]


def _step(p: dict, grads: dict, state: dict, rate: float) -> None:
    state["n"] = state.get("n", 0) + 1
    for k, g in grads.items():
        m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        if k in ("word", "char"):
            p[k] *= 1 - rate * DECAY
        p[k] -= rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.99 ** state["n"])) + 1e-5)


def _train_batch(p: dict, ids: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray, words: tuple, state: dict, rate: float) -> None:
    """One Adam step on windows: ids (time, window) are words of the fit."""
    word_row, rows, ends = words
    names, where = np.unique(ids, return_inverse=True)
    where = where.reshape(ids.shape)
    begins = np.where(names > 0, ends[names - 1], 0)
    lengths = ends[names] - begins
    own_ends = np.cumsum(lengths)
    own_rows = rows[np.repeat(begins - own_ends + lengths, lengths) + np.arange(own_ends[-1] if len(own_ends) else 0)]
    x = _inputs(p, word_row[names], own_rows, own_ends)
    store: dict = {}
    logit = _logits(p, (x @ p["wf"] + p["bf"])[where], (x @ p["wb"] + p["bb"])[where], there, store)
    d_logit = ((_sigmoid(logit) - y) * weight / max(weight.sum(), 1e-6)).astype(np.float32)
    h, a, alpha, c = (store[k] for k in ("h", "a", "alpha", "c"))
    grads = {"out": c.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
    d_c = d_logit[:, None] * p["out"]
    d_alpha = (h * d_c).sum(2)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
    grads["att_v"], grads["att_b"] = np.tensordot(d_e, a, 2), d_a.sum((0, 1))
    grads["att"] = np.tensordot(h, d_a, ((0, 1), (0, 1)))
    d_h = alpha[:, :, None] * d_c + d_a @ p["att"].T
    d_in = np.zeros_like(x)
    flat = where.ravel()
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(len(names)))
    for d, d_out, kept in (("f", d_h[:, :, :HIDDEN], store["sf"]), ("b", d_h[:, :, HIDDEN:], store["sb"])):
        d_x, grads[f"u{d}"] = _direction_back(d_out, kept, p[f"u{d}"])
        by_word = np.add.reduceat(d_x.reshape(-1, 3 * HIDDEN)[order], cuts, axis=0)
        grads[f"w{d}"], grads[f"b{d}"] = x.T @ by_word, by_word.sum(0)
        d_in += by_word @ p[f"w{d}"].T
    grads["word"] = np.zeros_like(p["word"])
    np.add.at(grads["word"], word_row[names], d_in[:, :WORD_DIM])
    per = np.repeat(d_in[:, WORD_DIM:] / np.maximum(lengths, 1)[:, None], lengths, axis=0)
    grads["char"] = np.stack([np.bincount(own_rows, per[:, k], minlength=CHAR_ROWS) for k in range(CHAR_DIM)], 1).astype(np.float32)
    _step(p, grads, state, rate)


def _gather(begin: np.ndarray, length: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) word ids and whether there is a word."""
    there = np.arange(WINDOW)[:, None] < length[None, :]
    at = np.minimum(begin[None, :] + np.arange(WINDOW)[:, None], max(len(ids) - 1, 0))
    return np.where(there, ids[at], 0), there


def window_logits(p: dict, x: np.ndarray, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    xf, xb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    out = np.empty(len(begin), np.float32)
    for at in range(0, len(begin), 4096):
        own, there = _gather(begin[at : at + 4096], length[at : at + 4096], ids)
        out[at : at + 4096] = _logits(p, _Steps(xf, own), _Steps(xb, own), there)
    return out


def _highest(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, EMPTY_LOGIT, np.float64)
    if len(logits):
        found, at = np.unique(text, return_index=True)
        out[found] = np.maximum.reduceat(logits, at)
    return out


def _rows_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.array([vocabulary.get(w, 0) for w in words], np.int64)


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> dict:
    """The network's weights, its words, and the calibration of the highest logit."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        rate = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.05
        return {"p": None, "vocabulary": {}, "slope": 0.0, "offset": float(np.log(rate / (1 - rate)))}
    rng = np.random.default_rng(seed)
    codes, counts, names = coded(texts)
    if not names:
        codes, names = np.zeros(1, np.int64), [b""]
    owner = np.repeat(np.arange(len(texts)), counts)
    spread = np.bincount(np.unique(codes[: len(owner)] * len(texts) + owner) // len(texts), minlength=len(names))
    del owner
    frequent = [int(k) for k in np.argsort(-spread, kind="stable")[:WORD_ROWS] if spread[k] >= WORD_TEXTS]
    vocabulary = {names[k]: r + 1 for r, k in enumerate(frequent)}
    words = (_rows_of(names, vocabulary), *char_grams(names))
    begin, length, text = windows(counts)
    y = labels[text] if len(text) else np.zeros(0, np.float32)
    held = (np.arange(len(texts)) % 5 == 4)[text] if len(text) else np.zeros(0, bool)
    p, state = _new(len(vocabulary), rng), {}

    def epoch(chosen: np.ndarray, rate: float) -> None:
        chosen = rng.permutation(chosen)
        share = y[chosen].mean() if len(chosen) else 0.5
        for at in range(0, len(chosen), 256):
            some = chosen[at : at + 256]
            ids, there = _gather(begin[some], length[some], codes)
            weight = np.where(y[some] > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
            _train_batch(p, ids, there, y[some], weight, words, state, rate)

    def sample(per_text: int, who: np.ndarray) -> np.ndarray:
        who = rng.permutation(who)
        nth = pd.Series(text[who]).groupby(text[who]).cumcount().to_numpy()
        return who[nth < per_text]

    usable = np.flatnonzero(~held)
    # first every window of a toxic text counts as toxic; then only the likeliest ones of each text
    rounds = int(np.clip(40_000 // max(1, len(sample(8, usable))), 3, MOST_ROUNDS))
    for _ in range(rounds):
        epoch(sample(8, usable), 0.01)
    x = None
    for k in range(rounds + 1):
        x = _inputs(p, *words)
        logit = window_logits(p, x, codes, begin, length)
        order = usable[np.argsort(-logit[usable], kind="stable")]
        nth = pd.Series(text[order]).groupby(text[order]).cumcount().to_numpy()
        top = order[nth < 2]
        clean = sample(6, usable[y[usable] == 0])
        epoch(np.unique(np.concatenate([top, clean])), 0.006 if k < rounds else 0.002)
    x = _inputs(p, *words)
    high = _highest(window_logits(p, x, codes, begin, length), text, len(texts))
    who = np.arange(len(texts)) % 5 == 4
    if len(set(labels[who].tolist())) < 2:
        who[:] = True
    slope, offset = _calibrate(high[who], labels[who])
    return {"p": p, "vocabulary": vocabulary, "slope": slope, "offset": offset}


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with its softened targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(slope * s + offset, -30, 30)))
        v = np.maximum(q * (1 - q), 1e-6)
        hess = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
        move = np.linalg.solve(hess, [((q - target) * s).sum(), (q - target).sum()])
        slope, offset = slope - float(np.clip(move[0], -0.5, 0.5)), offset - float(np.clip(move[1], -0.5, 0.5))
    return max(slope, 1e-3), offset


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    """The calibrated score of each whole text."""
    if model["p"] is None:
        high = np.zeros(len(texts))
    else:
        codes, counts, names = coded(texts)
        if names:
            x = _inputs_of(model["p"], names, model["vocabulary"])
            begin, length, text = windows(counts)
            high = _highest(window_logits(model["p"], x, codes, begin, length), text, len(texts))
        else:
            high = np.full(len(texts), EMPTY_LOGIT)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * high + model["offset"], -30, 30)))


def scored(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the scores of their texts; what a slice took is given back before the next one."""
    for batch in slices(batches, most_bytes=SLICE_BYTES):
        score = score_texts(batch.column("text").to_pylist(), model)
        give_back()
        yield batch, score


def learned(rule_column: str = "doc_id"):
    """Rows that may teach: crc32 of the id's text leaves another remainder than 1 by 3."""
    return F.crc32(F.col(rule_column).cast("string").cast("binary")) % 3 != 1


def fit_on_labels(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    model = fit(*labelled_sample(docs, labels, "toxic", fit_rows, FIT_CHARS, learned()))
    give_back()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    labels (doc_id, toxic) teach from rows that aren't held out; without both classes every text gets the rate
    seen. Null and empty texts get the score of no words. Ties with the threshold are predicted 1. Repeated rows
    each give a row; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_on_labels(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches, shared.value):
            out = [zlib.crc32(str(d).encode()) % 3 == 1 if d is not None else None for d in batch.column("doc_id").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs with a score below threshold, with all their columns and whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_on_labels(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches, shared.value):
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
