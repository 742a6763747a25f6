"""Mixing sources to target weights by temperature.

Shares of tokens are raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised;
the exponent is bisected until the weights have the target entropy, or until no source repeats more often than
the limit. Each source then fills its part of the budget by passes over a permutation of its documents, whole
ones first and a prefix of the last one, dealt into blocks in which the sources have their weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_names, keep

WORDS = r"[^ \t\n\x0B\f\r]+"
#: Parts of a pass that are summed one by one: no task sees a whole source.
PARTS = 1024
#: Sources whose shares are held on the driver (one number each); with more the sums are made by queries.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: int
    #: sum of share ** exponent over the sources, the tokens of all, and the weights' entropy in nats
    norm: float
    total: int
    entropy: float

    def repeats(self, tokens: Column) -> Column:
        """How often a source with so many tokens is used."""
        share = tokens / F.lit(float(self.total))
        return F.pow(share, F.lit(self.exponent)) / F.lit(self.norm) * F.lit(float(self.budget)) / tokens


def _sums(shares: list[float] | DataFrame, exponent: float) -> tuple[float, float, float, float]:
    """Sums over sources of s^a and of s^a log s, and the least and largest s^(a-1)."""
    if isinstance(shares, DataFrame):
        s, a = F.col("share"), F.lit(exponent)
        row = shares.agg(F.sum(F.pow(s, a)), F.sum(F.pow(s, a) * F.log(s)), F.min(F.pow(s, a - 1)), F.max(F.pow(s, a - 1))).first()
        return tuple(row)
    powers = [s**exponent for s in shares]
    ratios = [p / s for p, s in zip(powers, shares, strict=True)]
    return math.fsum(powers), math.fsum(p * math.log(s) for p, s in zip(powers, shares, strict=True)), min(ratios), max(ratios)


def choose_exponent(shares: list[float] | DataFrame, total: int, budget: int | None, target_entropy: float | None, repetition_limit: float | None) -> tuple[float, int, float, float]:
    """(exponent, budget, norm, entropy). Without a budget it is the least one that uses every source whole."""

    def state(a: float) -> tuple[float, float, int, float]:
        norm, logs, low, high = _sums(shares, a)
        entropy = math.log(norm) - a * logs / norm
        own = budget if budget is not None else math.ceil(total * norm / low - 1e-9)
        return norm, entropy, own, high / norm * own / total

    def fine(a: float) -> bool:
        norm, entropy, _, most = state(a)
        return entropy <= target_entropy if target_entropy is not None else most <= (repetition_limit or math.inf) + 1e-12

    # both conditions hold from some exponent on: the least such one is wanted
    low, high = 0.0, 1.0
    if fine(0.0):
        high = 0.0
    else:
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if fine(mid) else (mid, high)
    norm, entropy, own, _ = state(high)
    return high, own, norm, entropy


def _narrow(docs: DataFrame) -> DataFrame:
    """One row per row of docs without its text. Null sources are a source of their own."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dh"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def _place(seed: int) -> Column:
    """A document's place in the permutation of a pass."""
    return F.xxhash64(F.lit(seed), "skey", "epoch", "doc_id", "dh")


def plan_mixture(rows: DataFrame, budget: int | None, target_entropy: float | None, repetition_limit: float | None) -> tuple[Mixture | None, DataFrame]:
    """The mixture over rows (skey, n_tokens), and (skey, tokens) of its sources with tokens."""
    sources = keep(rows.groupBy("skey").agg(F.sum("n_tokens").alias("tokens")))
    used = sources.where("tokens > 0")
    total, count = used.agg(F.sum("tokens"), F.count("*")).first()
    if not count:
        return None, sources
    shares = used.select((F.col("tokens") / F.lit(float(total))).alias("share"))
    given = [r[0] for r in shares.collect()] if count <= MOST_SOURCES else shares
    exponent, own, norm, entropy = choose_exponent(given, total, budget, target_entropy, repetition_limit)
    return Mixture(exponent, own, norm, total, entropy), sources


def _passes(rows: DataFrame, mixture: Mixture | None, sources: DataFrame, seed: int) -> DataFrame:
    """Rows once for each pass that takes them, with epoch, place, and the tokens of the pass up to and with them."""
    if mixture is None:
        return rows.select("*", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("upto"), F.lit(1.0).alias("repeats"), F.lit(0).cast("long").alias("tokens"))
    repeats = sources.select("skey", "tokens", F.when(F.col("tokens") > 0, mixture.repeats(F.col("tokens"))).otherwise(F.lit(1.0)).alias("repeats"))
    passes = rows.join(repeats, "skey").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("repeats") - 1e-9).cast("int"), F.lit(1)) - 1)))
    placed = passes.withColumn("place", _place(seed)).withColumn("part", F.shiftright("place", 54))
    sums = placed.groupBy("skey", "epoch", "part").agg(F.sum("n_tokens").alias("own"))
    before = sums.selectExpr("skey", "epoch", "part", "sum(own) over (partition by skey, epoch order by part) - own as before")
    run = placed.selectExpr("*", "sum(n_tokens) over (partition by skey, epoch, part order by place range between unbounded preceding and current row) as within")
    full = run.join(before, ["skey", "epoch", "part"]).withColumn("upto", F.col("within") + F.col("before"))
    # the last pass ends where the source's part of the budget does
    quota = (F.col("repeats") - F.col("epoch")) * F.col("tokens")
    taken = full.where((F.col("epoch") + 1 <= F.col("repeats") + 1e-9) | (F.col("upto") <= quota + 1e-6) | (F.col("tokens") == 0))
    return taken.select(*rows.columns, "epoch", "place", "upto", "repeats", "tokens")


def mix_report(
    docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, repetition_limit: float | None = 2.0, block_tokens: int = 1_000_000, seed: int = 1
) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place) for each use of a row of docs (doc_id, text, source).

    Tokens are words. Without a budget every row is used at least once. block counts from 0: in each one a source
    has about its weight of block_tokens tokens; place orders a block's rows. Null and empty texts have no tokens and
    are used once; sources of such texts alone as well. Equal rows share places. An empty table gives no rows.
    """
    rows = keep(_narrow(docs))
    mixture, sources = plan_mixture(rows, budget, target_entropy, repetition_limit)
    passes = _passes(rows, mixture, sources, seed)
    weight = F.col("repeats") * F.col("tokens") / F.lit(float(mixture.budget if mixture else 1))
    at = F.col("epoch") * F.col("tokens") + F.col("upto") - F.col("n_tokens")
    block = F.when(F.col("tokens") > 0, F.floor(at / F.greatest(weight * F.lit(float(block_tokens)), F.lit(1e-9)))).otherwise(0).cast("long")
    source = F.when(F.col("skey") != "", F.substring("skey", 2, 2**31 - 1))
    return passes.select("doc_id", source.alias("source"), "n_tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"), "place")


def mix_documents(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, repetition_limit: float | None = 2.0, seed: int = 1) -> DataFrame:
    """docs with each row as often as the mixture uses it; the columns stay. The texts aren't shuffled."""
    rows = keep(_narrow(docs))
    mixture, sources = plan_mixture(rows, budget, target_entropy, repetition_limit)
    if mixture is None:
        return docs
    # how far the last pass of each source goes in its permutation
    ends = keep(_passes(rows, mixture, sources, seed).groupBy("skey", "epoch").agg(F.max("place").alias("end"), F.max("repeats").alias("repeats")))
    key, end, copy = free_names(docs, "_skey", "_last", "_copy")
    last = ends.groupBy("skey").agg(F.max_by(F.struct("epoch", "end", "repeats"), "epoch").alias(end)).withColumnRenamed("skey", key)
    skey = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    tagged = docs.withColumn(key, skey).join(last, key, "left")
    epoch = F.coalesce(F.col(f"{end}.epoch"), F.lit(0))
    place = F.xxhash64(F.lit(seed), key, epoch, F.col("doc_id").cast("long"), F.xxhash64("text"))
    whole = epoch + 1 <= F.coalesce(F.col(f"{end}.repeats"), F.lit(1.0)) + 1e-9
    times = epoch + F.when(whole | (place <= F.col(f"{end}.end")), 1).otherwise(0)
    out = tagged.withColumn(copy, F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    forget(rows)
    return out.select(*docs.columns)
