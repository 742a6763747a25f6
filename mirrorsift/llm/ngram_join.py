"""Set-similarity join of documents on word shingles through a token-group matrix.

Documents are dealt into groups of similar ones (equal minimum hash). For each group the union of its
members' signature tokens is stored, as rows (token, group) of a sparse matrix. A document's bound on the
overlap with a group is the number of its own signature tokens in that union; only groups whose bound
reaches the least overlap that a link needs are opened, and pairs are verified there on whole sets.

Signature: tokens are put in one global order, frequent ones last, and the first n - ceil(t n) + L are
kept. Two sets that link share at least min(L, ceil(t n)) tokens of their signatures, so no link is lost.
Frequent tokens only steer the order: any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, forget, keep, mix, shingle_sets, slices, tidy

#: Shared signature tokens asked of a pair with large sets.
DEPTH = 3
#: Frequent tokens known to all tasks, at most: 8 bytes each.
MOST_FREQUENT = 262_144
#: Documents seen with a token before it counts as frequent.
FREQUENT_FROM = 12
#: Members of a group that one task compares with one another; larger groups are compared block by block.
BLOCK = 1024
#: Bytes of text that a worker cuts into shingles at once, and tokens that wait at most to be counted.
SLICE_BYTES, WAITING = 1_000_000, 1_000_000

_SCAN = "kind int, doc_id long, n long, token long, docs long, dh long"


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent n / 100)."""
    return -(-n * percent // 100)


def _fingerprint(tokens: np.ndarray) -> int:
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ (np.uint64(len(tokens)) * np.uint64(0xD6E8FEB86659FD93))]))[0].astype(np.int64))


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and at the end a row for each token that several sets of the task hold."""
        held: list[np.ndarray] = []
        counted: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        seen: set[int] = set()
        waiting = 0

        def fold(counted):
            flat, own = np.unique(np.concatenate(held), return_counts=True)
            names, total = counted
            at = np.searchsorted(names, flat)
            known = at < len(names)
            known[known] = names[at[known]] == flat[known]
            total[at[known]] += own[known]
            # merged in place of sorting both again, which takes several times the memory
            at, flat, own = at[~known], flat[~known], own[~known]
            names = np.insert(names, at, flat)
            total = np.insert(total, at, own)  # of 32 bits: a task has fewer texts
            if len(names) > 6_000_000:  # only tokens met more than once may stay: memory is bounded
                names, total = names[total > 1], total[total > 1]
            return names, total

        for batch in slices(batches, most_bytes=SLICE_BYTES):
            ids = batch.column("doc_id")
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            prints = [_fingerprint(s) for s in sets]
            for s, p in zip(sets, prints, strict=True):
                if len(s) and p not in seen:
                    seen.add(p)
                    held.append(s)
                    waiting += len(s)
            if waiting > WAITING:
                counted, held, waiting = fold(counted), [], 0
            k = len(sets)
            nothing = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k, pa.int32()), ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), nothing, batch.column("dh")],
                names=["kind", "doc_id", "n", "token", "docs", "dh"],
            )
        if held:
            counted = fold(counted)
        names, total = counted[0][counted[1] > 1], counted[1][counted[1] > 1]
        for at in range(0, len(names), 100_000):
            some = names[at : at + 100_000]
            k = len(some)
            nothing = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * k, pa.int32()), nothing, nothing, pa.array(_long(some)), pa.array(total[at : at + 100_000], pa.int64()), nothing],
                names=["kind", "doc_id", "n", "token", "docs", "dh"],
            )

    return run


def _sign(shingle: int, percent: int, depth: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signature rows (token, class, group, code); sets met before in the task give none.

        code is 8 times the share of infrequent tokens in a thousand, plus the shared tokens that a link needs.
        """
        often = frequent.value
        seen: set[int] = set()
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingle_sets(batch.column("text").to_pylist(), shingle):
                name = _fingerprint(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    is_often = often[at] == s
                else:
                    is_often = np.zeros(len(s), bool)
                overlap = least_overlap(len(s), percent)
                own = np.concatenate([s[~is_often], s[is_often]])[: len(s) - overlap + depth]
                out[0].append(_long(own))
                # the group: the least remixed hash among frequent tokens (copies share these), else among all
                base = s[is_often] if is_often.sum() * 2 >= len(s) else s
                light = 1000 * int((~is_often).sum()) // len(s)
                group = int(mix(base ^ np.uint64(0xA5A5A5A55A5A5A5A)).min().astype(np.int64))
                for column, value in ((1, name), (2, group), (3, 8 * light + min(depth, overlap))):
                    out[column].append(np.full(len(own), value, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["token", "class", "grp", "code"])

    return run


def _sets(shingle: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their text's token set in place of the text; a doc_id may have several texts."""
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle)
            own = pa.array([_fingerprint(s) == name for s, name in zip(sets, batch.column("class").to_pylist(), strict=True)], pa.bool_())
            tokens = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(own) for c in columns] + [tokens.filter(own)], names=[*columns, "tokens"])

    return run


def _compare(percent: int):
    def links(left: list[np.ndarray], right: list[np.ndarray], same: bool, marked_l: np.ndarray, marked_r: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs that connect sets not connected before; marked sets count as connected with one another.

        Each round takes one set and counts its tokens in all others that it is not connected with.
        """
        sets = left if same else left + right
        marked = marked_l if same else np.concatenate([marked_l, marked_r])
        group = np.arange(len(sets))
        if marked.any():
            group[marked] = np.flatnonzero(marked)[0]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, flat = np.unique(flat, return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        has = np.zeros(int(flat.max()) + 1, np.int64)
        for i in range(len(left)):
            first = i + 1 if same else len(left)
            others = np.arange(first, len(sets))
            big, small = np.maximum(sizes[others], sizes[i]), np.minimum(sizes[others], sizes[i])
            others = others[(group[others] != group[i]) & (100 * small >= percent * big)]
            if not len(others):
                continue
            own = flat[begins[i] : begins[i + 1]]
            has[own] = 1
            if len(others) * 3 > len(sets) - first:
                cut = begins[others]
                running = np.concatenate([[0], np.cumsum(has[flat])])
                inter = running[begins[others + 1]] - running[cut]
            else:
                inter = np.array([has[flat[begins[j] : begins[j + 1]]].sum() for j in others])
            has[own] = 0
            union = sizes[i] + sizes[others] - inter
            for j in others[100 * inter >= percent * union]:
                if group[j] != group[i]:
                    yield i, int(j)
                    group[group == group[j]] = group[i]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["class", "side"])
        sides = {s: part.sort_values("class") for s, part in pdf.groupby("side")}
        pairs: list[tuple[int, int]] = []
        arrays = {s: ([np.frombuffer(t, np.uint64) for t in part["tokens"]], part["class"].to_numpy(), part["near"].to_numpy(bool)) for s, part in sides.items()}
        if 2 in arrays:  # one block with itself
            sets, names, near = arrays[2]
            pairs += [(names[i], names[j]) for i, j in links(sets, sets, True, near, near)]
        elif 0 in arrays and 1 in arrays:
            names = np.concatenate([arrays[0][1], arrays[1][1]])
            pairs += [(names[i], names[j]) for i, j in links(arrays[0][0], arrays[1][0], False, arrays[0][2], arrays[1][2])]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


@F.pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def ngram_jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased (A-Z) runs of characters other than space and tab to carriage return. Sets with
    100 * intersection >= percent * union link. Null or empty texts: no shingles, own component. A doc_id on
    several rows is in all its rows' components. class_id is a 64-bit hash of the set (0: empty). An empty
    table gives no rows.
    """
    if not 1 <= depth <= 7:
        raise ValueError(f"depth must be between 1 and 7, got {depth}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    scan = keep(docs.mapInArrow(tidy(_scan(shingle)), _SCAN))
    rows = scan.where("kind = 0").select("doc_id", "n", F.col("token").alias("class"), "dh")
    often = (
        scan.where("kind = 1").groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= FREQUENT_FROM).orderBy(F.desc("docs"), "token").limit(MOST_FREQUENT)
    )
    tokens = np.sort(np.array([r[0] for r in often.select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(tokens)

    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dh")).alias("rep"))
    signed = docs.mapInArrow(tidy(_sign(shingle, percent, depth, frequent)), "token long, class long, grp long, code long")
    # tokens of one class only can't be shared: a window over the one exchange by token drops them
    spread = signed.repartition(F.col("token")).selectExpr("*", "min(class) over (partition by token) as lo", "max(class) over (partition by token) as hi")
    spread = keep(spread.where("lo <> hi").select("token", "class", F.col("grp").alias("own"), "code").distinct())
    matrix = spread.groupBy("token", F.col("own").alias("grp")).agg(F.count("*").alias("holders"))
    # in its own group a set's bound counts only tokens that another member holds as well
    bounds = spread.join(matrix, "token").where("own <> grp or holders > 1").groupBy("class", "own", "grp").agg(F.count("*").alias("bound"), F.max("code").alias("code"))
    bounds = keep(bounds.where("bound >= code % 8").select("class", "own", "grp", "code"))
    # two sets of different groups reach each other's group: the smaller one is where they meet
    visits = (
        bounds.where("grp < own").select("class", "grp", "code").unionByName(bounds.where("grp >= own").select("class", F.col("own").alias("grp"), "code").distinct())
    )
    sizes = visits.groupBy("grp").agg(F.count("*").alias("size"), F.min(F.struct("code", "class"))["class"].alias("leader")).where("size > 1")
    visits = keep(visits.join(sizes, "grp").select("class", "grp", "size", "leader"))

    def with_tokens(rows: DataFrame) -> DataFrame:
        """Rows with a class, each with the class's token set, read from the text of one of the class's documents."""
        placed = rows.join(classes.select("class", F.col("rep.doc_id").alias("rid"), F.col("rep.dh").alias("rh")), "class")
        columns = [c for c in placed.columns if c not in ("rid", "rh")]
        # a class may have rows without id only: the text's hash finds those
        texts = docs.join(placed.hint("shuffle_hash"), (docs["dh"] == placed["rh"]) & docs["doc_id"].eqNullSafe(placed["rid"])).select(*columns, "text")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*columns).schema)
        return texts.mapInArrow(tidy(_sets(shingle, columns)), f"{kinds}, tokens binary")

    # in a large group first the leader, the set with the least share of rare tokens, with all others:
    # near copies of one text are mostly settled by it
    large = visits.where(F.col("size") > block)
    led = None
    if not large.isEmpty():
        found = keep(with_tokens(large.select("class", "grp", "leader")))
        heads = found.where("class = leader").select("grp", F.col("tokens").alias("lt")).dropDuplicates(["grp"])
        first = found.where("class <> leader").join(heads, "grp").withColumn("n", F.octet_length("tokens") / 8).withColumn("ln", F.octet_length("lt") / 8)
        first = first.where(F.least("n", "ln") * 100 >= F.greatest("n", "ln") * percent)
        first = first.withColumn("inter", _shared("tokens", "lt")).where((F.col("n") + F.col("ln") - F.col("inter")) * percent <= F.col("inter") * 100)
        led = keep(first.select("class", "grp", "leader").distinct())
        forget(found)

    # then the rest, block by block: a pair needs a look unless both are linked with the leader
    marks = visits.withColumn("near", F.lit(False))
    if led is not None:
        marks = visits.join(led.select("class", "grp", F.lit(True).alias("linked")), ["class", "grp"], "left")
        marks = marks.withColumn("near", F.coalesce("linked", (F.col("class") == F.col("leader")) & (F.col("size") > block)))
    marks = marks.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("class", "grp"), F.col("blocks")).cast("int"))
    dealt = marks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "class", "grp", "near", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    if led is not None:  # a pair of blocks in which all sets are near has nothing to find
        dealt = dealt.join(dealt.where(~F.col("near")).select("grp", "i", "j").distinct(), ["grp", "i", "j"])
    rest = with_tokens(dealt).groupBy("grp", "i", "j").applyInPandas(_compare(percent), "a long, b long")
    if led is not None:
        rest = rest.unionByName(led.select(F.col("class").alias("a"), F.col("leader").alias("b")))

    links = keep(rest.distinct())
    roots = components(links)
    by_class = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    smallest = by_class.groupBy("root").agg(F.min("first").alias("component_id"))
    named = by_class.join(smallest, "root").select("class", "component_id")
    out = rows.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).otherwise(F.lit(0)).alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    out = keep(out)
    for used in (scan, spread, bounds, visits, links) if led is None else (scan, spread, bounds, visits, links, led):
        forget(used)
    return out
