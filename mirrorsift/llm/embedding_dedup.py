"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in halves; each half has its own codebook (fitted on a bounded sample), and the
pairs of codewords form a grid of cells. Every vector is indexed in its nearest cell. As a query it visits
cells in multi-sequence order, nearest sum of half distances first, as many as the measured target recall
asks, and skips cells that cannot hold a partner (the distance to a cell's region bounds it). Vectors of the
visited cells are verified by their cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, keep

#: Rows that codebooks and the visit count are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Queries of the sample whose links brute force finds, to measure recall.
PROBES = 2_000
#: Rows of a cell that one task compares with as many queries.
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _gaps(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all codewords, and squared least distances to their regions."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)
    near = d.argmin(1)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(-1), 1e-24))
    low = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / (2 * apart[near])
    return d, low**2


def traverse(d1: np.ndarray, d2: np.ndarray, low1: np.ndarray, low2: np.ndarray, reach2: float, most: int) -> list[int]:
    """Multi-sequence traversal: cell numbers, nearest first, without those out of reach."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    # regions out of reach by one half alone end that sequence
    o1, o2 = o1[low1[o1] <= reach2], o2[low2[o2] <= reach2]
    width, out = len(d2), []
    heap, pushed = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap and len(out) < most:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        if low1[i] + low2[j] <= reach2 + 1e-12:
            out.append(int(i) * width + int(j))
        for p, q in ((a + 1, b), (a, b + 1)):
            if p < len(o1) and q < len(o2) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (d1[o1[p]] + d2[o2[q]], p, q))
    return out


class Index:
    """Codebooks of one vector length and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, cosine: float, target_recall: float, codewords: int):
        self.half = sample.shape[1] // 2
        self.reach2 = 2 - 2 * cosine + 1e-9
        self.c1, self.c2 = _kmeans(sample[:, : self.half], codewords), _kmeans(sample[:, self.half :], codewords)
        self.visits, self.recall = len(self.c1) * len(self.c2), 1.0
        cells = self.cell(sample)
        # visits: the least number that finds the target share of the sample's links; a probe's links weigh as much as one
        # over their number, so that a large group counts no more than a small one
        ranks, weights = [], []
        for at in range(0, min(len(sample), PROBES), 500):
            q = sample[at : at + 500]
            near = q @ sample.T >= cosine
            near[np.arange(len(q)), at + np.arange(len(q))] = False
            for a in np.flatnonzero(near.any(1)):
                homes, times = np.unique(cells[near[a]], return_counts=True)
                walk = {c: r for r, c in enumerate(self.walk(q[a : a + 1])[0])}
                ranks += [0 if c == cells[at + a] else walk.get(int(c), self.visits) for c in homes]
                weights += (times / (times.sum() * (times.sum() + 1))).tolist()
        if ranks:
            order = np.argsort(ranks, kind="stable")
            ranks, weights = np.array(ranks)[order], np.array(weights)[order]
            found = np.cumsum(weights) / weights.sum()
            self.visits = int(max(8, 2 * (ranks[min(len(ranks) - 1, int(np.searchsorted(found, target_recall)))] + 1)))
            self.recall = float(weights[ranks < self.visits].sum() / weights.sum())

    def parts(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def of(cls, parts: dict) -> Index:
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def cell(self, x: np.ndarray) -> np.ndarray:
        return _gaps(x[:, : self.half], self.c1)[0].argmin(1) * len(self.c2) + _gaps(x[:, self.half :], self.c2)[0].argmin(1)

    def walk(self, x: np.ndarray) -> list[list[int]]:
        d1, l1 = _gaps(x[:, : self.half], self.c1)
        d2, l2 = _gaps(x[:, self.half :], self.c2)
        return [traverse(d1[k], d2[k], l1[k], l2[k], self.reach2, self.visits) for k in range(len(x))]


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _visit(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000).to_pandas()
                for dim, part in some.groupby("dim"):
                    index = Index.of(shared.value[dim])
                    x = _unit(part["embedding"].tolist())
                    walks, own = index.walk(x), index.cell(x)
                    walks = [w if c in w else [int(c), *w] for w, c in zip(walks, own, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["rep"].to_numpy()), pa.array(part["copies"].to_numpy()), pa.array(part["dim"].to_numpy(np.int64)), pa.array(own.astype(np.int64)), pa.array(walks, pa.list_(pa.int64())), pa.array([v.tobytes() for v in x], pa.binary())],
                        names=["rep", "copies", "dim", "cell", "visits", "unit"],
                    )

    return run


def _verify(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between one block of a cell's vectors and one block of its visitors.

        A link met in both directions counts for the visitor here and for the other side there; a link
        whose other side doesn't visit the visitor's cell counts for both here.
        """
        own, ask = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(own) or not len(ask):
            return pd.DataFrame(columns=["rep", "links", "root"]).astype("int64")
        y = np.array([np.frombuffer(u) for u in own["unit"]])
        x = np.array([np.frombuffer(u) for u in ask["unit"]])
        names = np.concatenate([ask["rep"].to_numpy(), own["rep"].to_numpy()])
        copies_x, copies_y = ask["copies"].to_numpy(), own["copies"].to_numpy()
        cell_x, cell_y = ask["home"].to_numpy(), own["home"].to_numpy()
        visits_y = [set(v) for v in own["visits"]]
        a, b = np.nonzero(x @ y.T >= cosine)
        keep_ = ask["rep"].to_numpy()[a] != own["rep"].to_numpy()[b]
        a, b = a[keep_], b[keep_]
        links_x = np.bincount(a, weights=copies_y[b], minlength=len(x)).astype(np.int64)
        links_y = np.zeros(len(y), np.int64)
        far = cell_x[a] != cell_y[b]
        for p, q in zip(a[far], b[far], strict=True):
            if int(cell_x[p]) not in visits_y[q]:
                links_y[q] += copies_x[p]
        label = names.copy()
        b = b + len(x)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (before == label).all():
                break
        out = pd.DataFrame({"rep": names, "links": np.concatenate([links_x, links_y]), "root": label})
        return out[(out["links"] > 0) | (out["root"] != out["rep"])]

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.95, target_recall: float = 0.995, codewords: int = 32, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding; others are ignored).

    Null, empty or zero vectors, those with null or non-finite components and those without id have no links. Vectors of
    different lengths never link. Equal vectors link; rows that repeat a vec_id count like others. An empty
    table gives no rows. component_id is the smallest vec_id that links reach; kept marks it.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    fine = (F.size("embedding") > 0) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = rows.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    # + 0.0 makes -0.0 and 0.0 equal before hashing
    flat = F.transform("embedding", lambda e: e + F.lit(0.0))
    rows = rows.select("vec_id", "embedding", F.xxhash64(flat).alias("h1"), F.xxhash64(F.lit("second"), flat).alias("h2"))
    distinct = keep(
        rows.where("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding").cast("long"))
    )
    indexes = {}
    for (dim,) in distinct.select("dim").distinct().collect():
        sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").toPandas()
        indexes[dim] = Index(_unit(sample["embedding"].tolist()), cosine, target_recall, codewords)
    shared = spark.sparkContext.broadcast({dim: index.parts() for dim, index in indexes.items()})
    placed = keep(distinct.select("rep", "copies", "dim", "embedding").mapInArrow(_visit(shared), "rep long, copies long, dim long, cell long, visits array<long>, unit binary"))

    calls = placed.select("rep", "copies", "dim", F.col("cell").alias("home"), "unit", F.explode("visits").alias("cell"))
    members = placed.groupBy("dim", "cell").agg(F.count("*").alias("size"))
    asked = calls.groupBy("dim", "cell").agg(F.count("*").alias("asks"))
    plan = members.join(asked, ["dim", "cell"]).select("dim", "cell", F.ceil(F.col("size") / block).cast("int").alias("mb"), F.ceil(F.col("asks") / block).cast("int").alias("qb"))
    plan = keep(plan)
    salt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    own = (
        placed.join(plan, ["dim", "cell"]).withColumn("m", salt("mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .select("dim", "cell", "m", "q", F.lit(True).alias("member"), "rep", "copies", F.col("cell").alias("home"), "visits", "unit")
    )
    ask = (
        calls.join(plan, ["dim", "cell"]).withColumn("q", salt("qb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        .select("dim", "cell", "m", "q", F.lit(False).alias("member"), "rep", "copies", "home", F.lit(None).cast("array<long>").alias("visits"), "unit")
    )
    found = keep(own.unionByName(ask).groupBy("dim", "cell", "m", "q").applyInPandas(_verify(cosine), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        distinct.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    good = rows.where("embedding is not null").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keep(good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    for used in (distinct, placed, plan, found):
        forget(used)
    return out
