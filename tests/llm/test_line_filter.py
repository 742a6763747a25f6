import random

from mirrorsift.llm.line_dedup import _PARITY, _near
from pyspark.sql import functions as F


def test_filter_tells_long_lines_apart(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        one = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
        rows.append((k, False, one, one[:1] + [rng.randrange(-(2**62), 2**62) for _ in range(399)]))
        changed = one[:]
        for at in rng.sample(range(1, 400), 44):  # 100 * 356 >= 80 * 444: just alike
            changed[at] = rng.randrange(-(2**62), 2**62)
        rows.append((k, True, one, changed))
    pairs = spark.createDataFrame(rows, "k int, alike boolean, a array<bigint>, b array<bigint>")
    side = lambda c: F.struct(F.size("tokens").alias("n"), F.lit(0).alias("place"), F.expr(_PARITY).alias("parity")).alias(c)
    x = pairs.select("k", "alike", F.col("a").alias("tokens")).select("k", "alike", side("x"))
    y = pairs.select("k", "alike", F.col("b").alias("tokens")).select("k", "alike", side("y"))
    found = x.join(y, ["k", "alike"]).groupBy("alike").agg(F.sum(_near("x", "y", 80).cast("int")).alias("n")).collect()
    assert {r["alike"]: r["n"] for r in found} == {True: 40, False: 0}
