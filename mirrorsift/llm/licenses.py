"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, then banded sequence
alignment reports how much of a template a text holds and where."""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gram_hashes, slices, word_hashes

#: Words of a fingerprint, and fingerprints of which the least is kept.
GRAM, WINNOW = 3, 4
#: How far an alignment may stray from the diagonal, and the least part of a template's words that counts.
BAND, LEAST_COVERAGE = 12, 0.8

# Public license notices and short license texts.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""",
    "MIT-line": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}

_MARKS = b".,;:!?\"'()[]{}<>*"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: str) -> list[bytes]:
    return [w.strip(_MARKS) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def winnow(grams: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the fingerprints: the least gram of every window of grams, the last one among equals."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else []
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return sorted(set((np.arange(len(views)) + window - 1 - views.argmin(1)).tolist()))


class Index:
    """Templates' words, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM):
        self.names = list(templates)
        self.gram = gram
        self.words = [word_hashes(_words(t)) for t in templates.values()]
        where = defaultdict(list)
        for k, words in enumerate(self.words):
            if len(words) < gram:
                raise ValueError(f"template {self.names[k]} has fewer than {gram} words")
            grams = gram_hashes(words, gram)
            for at in winnow(grams):
                where[int(grams[at])].append((k, at))
        self.where = dict(where)
        self.keys = np.array(sorted(self.where), dtype=np.uint64)

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in the template, place in the text) of equal fingerprints."""
        grams = gram_hashes(words, self.gram)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return [(k, t, int(d)) for d in np.flatnonzero(self.keys[at] == grams) for k, t in self.where[int(grams[d])]]

    def candidates(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """(template, begin in the text): each diagonal that has hits."""
        return sorted({(k, d - t) for k, t, d in hits})


def align(template: np.ndarray, words: np.ndarray, begin: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end): the longest common subsequence near the diagonal that starts at begin; of several
    the one in the fewest words of the text, then the first.

    Cells farther than band from the diagonal aren't computed. first and end are places of the first and after
    the last matched word in words.
    """
    # each row: for offset o in -band..band, best (matches, start) with text words up to begin + i + o
    wide = 2 * band + 1
    none = (0, 0)
    before = [none] * wide
    top = (0, 0, 0)
    for i, want in enumerate(template):
        row = []
        for o in range(wide):
            j = begin + i + o - band
            best = before[o + 1] if o + 1 < wide else none  # leave out the template's word
            if o and row[o - 1] > best:
                best = row[o - 1]  # leave out the text's word
            if 0 <= j < len(words) and words[j] == want:
                n, start = before[o]
                one = (n + 1, start if n else j)
                best = max(best, one)
                top = max(top, (one[0], one[1] - j - 1, -one[1]))
            row.append(best)
        before = row
    n, span, start = top
    return n, -start, -start - span


def part(template: list[int], words: list[int], begin: int, need: int) -> list[tuple[int, int, int]]:
    """align() where need words match, else nothing; a passage that holds several separate ones gives all of these."""
    n, first, end = align(template, words, begin)
    if n < need:
        return []
    best: tuple = ()
    for cut in range(first + need, end - need + 1):
        a, b = align(template, words[first:cut], begin - first), align(template, words[cut:end], begin - cut)
        if min(a[0], b[0]) >= need and (not best or a[0] + b[0] > best[0]):
            best = (a[0] + b[0], cut)
    if not best:
        return [(n, first, end)]
    cut = best[1]
    return [(m, f + at, e + at) for at, stop in ((first, cut), (cut, end)) for m, f, e in part(template, words[at:stop], begin - at, need)]


def scan_text(text: str | None, words: np.ndarray, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of a text's license passages, in code points; overlapping ones: the longest
    match stays, then the higher coverage, and the others are aligned again with the words that are left."""
    hits = index.hits(words) if len(words) >= index.gram else []
    if not hits:
        return []
    templates = {k: index.words[k].tolist() for k, _, _ in hits}
    shared = {k: np.concatenate([[0], np.cumsum(np.isin(words, index.words[k]))]) for k in templates}
    taken: list[tuple[int, int]] = []  # places of passages that stay, by place
    heap: list[tuple] = []
    turns: dict[tuple[int, int], int] = {}  # proposals of a diagonal; older ones than its last don't count

    def propose(k: int, begin: int) -> None:
        size = len(templates[k])
        need = max(math.ceil(least * size), 1)
        turns[k, begin] = turn = turns.get((k, begin), 0) + 1
        low, high = max(begin - BAND, 0), min(begin + size + BAND, len(words))
        at = bisect.bisect_left(taken, (low, low))
        for first, end in [*taken[max(at - 1, 0) : bisect.bisect_left(taken, (high, high))], (high, high)]:
            # no more words can match than the template has in common with the free stretch
            if first - low >= need and shared[k][first] - shared[k][low] >= need:
                for n, f, e in part(templates[k], words[low:first].tolist(), begin - low, need):
                    heapq.heappush(heap, (-n, -n / size, index.names[k], e - f, low + f, low + e, k, begin, turn))
            low = max(low, end)

    for k, begin in index.candidates(hits):
        propose(k, begin)
    found = []
    while heap:
        n, _, name, _, first, end, k, begin, turn = heapq.heappop(heap)
        if turn != turns[k, begin]:
            continue
        at = bisect.bisect_left(taken, (first, end))
        if not (at and taken[at - 1][1] > first) and not (at < len(taken) and taken[at][0] < end):
            taken.insert(at, (first, end))
            found.append((name, -n / len(templates[k]), first, end))
        propose(k, begin)
    spans = [m.span() for m in _WORD.finditer(text)] if found else []
    kept = [(name, coverage, spans[first][0], spans[end - 1][1]) for name, coverage, first, end in found]
    return sorted(kept, key=lambda x: (x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, n_licenses, max_coverage, licenses) for each row of docs (doc_id, text).

    licenses joins template:coverage in thousandths:start:end by commas, by start (code points, end exclusive).
    Null, empty and short texts have none. Repeated rows each give a row; other columns are ignored.
    """
    index = Index(templates or TEMPLATES)
    parts = (index.names, index.gram, index.words, index.where, index.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)
        index.names, index.gram, index.words, index.where, index.keys = parts
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            own = [_words(t) if t else [] for t in texts]
            hashes = word_hashes([w for ws in own for w in ws])
            ends = np.cumsum([len(ws) for ws in own])
            found = [scan_text(t, hashes[e - len(ws) : e], index, least) for t, ws, e in zip(texts, own, ends, strict=True)]
            text = [",".join(f"{n}:{int(1000 * c)}:{b}:{e}" for n, c, b, e in f) for f in found]
            arrays = [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([max((c for _, c, _, _ in f), default=0.0) for f in found], pa.float64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_licenses", "max_coverage", "licenses"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, max_coverage double, licenses string")
