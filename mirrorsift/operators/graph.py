"""Connected components and clusters of groups over trust levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorsift.sources.store import materialize

RANKS = {"POSSIBLE": 1, "VERY_LIKELY": 2, "EXACT": 3}


def trust_rank(trust: Column) -> Column:
    """3 for the strongest; unknown text is an error."""
    out = F.raise_error(F.concat(F.lit("unknown trust level "), trust)).cast("int")
    for name, rank in RANKS.items():
        out = F.when(trust == name, rank).otherwise(out)
    return out


def trust_name(rank: Column) -> Column:
    return F.when(rank == 3, "EXACT").when(rank == 2, "VERY_LIKELY").when(rank == 1, "POSSIBLE")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that edges (a, b) reach.

    Large-star and small-star steps in turn; rounds grow with the logarithm of the graph and each one is written to
    the shared folder, so lineage stays short. Only counts reach the driver.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    state = now.agg(*mark).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, now.agg(*mark).first()
        if state == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _named(groups: DataFrame, members: DataFrame) -> DataFrame:
    g = groups.select("group_id", "trust", "non_transitive")
    return members.select("group_id", "file_id").distinct().join(g, "group_id").withColumn("rank", trust_rank(F.col("trust")))


def transitive_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(root, file_id, group_id, rank) of groups that merge: EXACT and VERY_LIKELY ones not marked non-transitive."""
    m = _named(groups, members).where("rank >= 2 and not non_transitive")
    low = m.groupBy("group_id").agg(F.min("file_id").alias("low"))
    roots = components(m.join(low, "group_id").select(F.col("file_id").alias("a"), F.col("low").alias("b")))
    return m.join(roots, m["file_id"] == roots["node"], "left").select(F.coalesce("root", "file_id").alias("root"), "file_id", "group_id", "rank")


def _free_ids(groups: DataFrame) -> DataFrame:
    """One row: the highest group_id there is, 0 without one; new groups are numbered from the next one on."""
    return groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("taken"))


def near_groups(edges: DataFrame) -> DataFrame:
    """(low, file_id) of the components of near edges (a, b); low is the smallest member. A component has two members at least."""
    return components(edges).select(F.col("root").alias("low"), F.col("node").alias("file_id"))


def rebuilt_near(groups: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, trust, non_transitive, file_id) after a near rebuild: near groups replace the transitive VERY_LIKELY ones."""
    kept = groups.where("trust <> 'VERY_LIKELY' or non_transitive").select("group_id", "trust", "non_transitive")
    old = kept.join(members.select("group_id", "file_id").distinct(), "group_id")
    new = near_groups(edges).join(F.broadcast(_free_ids(groups))).select((F.col("taken") + 1 + F.col("low")).alias("group_id"), F.lit("VERY_LIKELY").alias("trust"), F.lit(False).alias("non_transitive"), "file_id")
    return old.unionByName(new)


def uncovered(pairs: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, more) whose ends aren't in one transitive component."""
    roots = transitive_members(groups, members).select("file_id", "root").distinct()
    j = pairs.join(roots.select(F.col("file_id").alias("a"), F.col("root").alias("root_a")), "a", "left").join(roots.select(F.col("file_id").alias("b"), F.col("root").alias("root_b")), "b", "left")
    return j.where("not coalesce(root_a = root_b, false)").select(*pairs.columns)


def rebuilt_whole(groups: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """(group_id, trust, non_transitive, file_id, score_x1000) after a whole-file rebuild: each match (a, b, passes_gate,
    score_x1000) that passes and isn't covered is a non-transitive group of two; these replace the non-transitive
    VERY_LIKELY ones. Scores of kept groups are null.
    """
    kept = groups.where("trust <> 'VERY_LIKELY' or not non_transitive").select("group_id", "trust", "non_transitive")
    old = kept.join(members.select("group_id", "file_id").distinct(), "group_id").withColumn("score_x1000", F.lit(None).cast("long"))
    plan = materialize(uncovered(matches.where("passes_gate").select("a", "b", "score_x1000"), kept, members))
    # one number for each pair, without numbering all pairs in one task
    wide = plan.agg(F.coalesce(F.max("b"), F.lit(0)).alias("most")).join(_free_ids(groups))
    new = plan.join(F.broadcast(wide)).select((F.col("taken") + 1 + F.col("a") * (F.col("most") + 1) + F.col("b")).alias("group_id"), F.lit("VERY_LIKELY").alias("trust"), F.lit(True).alias("non_transitive"), F.explode(F.array("a", "b")).alias("file_id"), "score_x1000")
    return old.unionByName(new)


def clusters(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, file_id, trust, representative, first_member) of all clusters; cluster_id is the smallest group id.

    Transitive groups merge. POSSIBLE groups go if they lie inside one merged cluster; those with the same ends outside
    one cluster become one card; others, and non-transitive groups, are clusters of their own.
    """
    t = materialize(transitive_members(groups, members))
    head = t.groupBy("root").agg(F.min("group_id").alias("cluster_id"), F.max("rank").alias("top"))
    merged = t.groupBy("root", "file_id").agg(F.max("rank").alias("rank")).join(head, "root").select("cluster_id", "file_id", "rank", "top")

    m = _named(groups, members)
    inside = t.select("file_id", "root").distinct()
    p = m.where("rank = 1 and not non_transitive").join(inside, "file_id", "left")
    per = p.groupBy("group_id").agg(F.countDistinct("root").alias("roots"), F.min("root").alias("root"), F.sort_array(F.collect_set(F.when(F.col("root").isNull(), F.col("file_id")))).alias("ends"))
    kind = F.when((F.col("roots") == 1) & (F.size("ends") == 0), "gone").when((F.col("roots") == 1) & (F.size("ends") > 0), "card").otherwise("own")
    per = per.withColumn("kind", kind)
    cards = per.where("kind = 'card'").selectExpr("group_id", "min(group_id) over (partition by ends, root) as cluster_id")
    own = per.where("kind = 'own'").select("group_id", F.col("group_id").alias("cluster_id"))
    apart = m.where("non_transitive").select("group_id", F.col("group_id").alias("cluster_id")).distinct()
    rest = m.join(cards.unionByName(own).unionByName(apart), "group_id").select("cluster_id", "file_id", "rank", F.col("rank").alias("top")).distinct()
    out = merged.unionByName(rest)
    first = out.groupBy("cluster_id").agg(F.min("file_id").alias("first_member"))
    return out.join(first, "cluster_id").select("cluster_id", "file_id", trust_name(F.col("rank")).alias("trust"), trust_name(F.col("top")).alias("representative"), "first_member")


def cluster_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, group_id) of the groups that clusters() merges into each cluster."""
    t = materialize(transitive_members(groups, members))
    head = t.groupBy("root").agg(F.min("group_id").alias("cluster_id"))
    merged = t.select("root", "group_id").distinct().join(head, "root").select("cluster_id", "group_id")
    m = _named(groups, members)
    p = m.where("rank = 1 and not non_transitive").join(t.select("file_id", "root").distinct(), "file_id", "left")
    per = p.groupBy("group_id").agg(F.countDistinct("root").alias("roots"), F.min("root").alias("root"), F.sort_array(F.collect_set(F.when(F.col("root").isNull(), F.col("file_id")))).alias("ends"))
    cards = per.where("roots = 1 and size(ends) > 0").selectExpr("min(group_id) over (partition by ends, root) as cluster_id", "group_id")
    alone = per.where("roots <> 1").select("group_id").unionByName(m.where("non_transitive").select("group_id").distinct())
    return merged.unionByName(cards).unionByName(alone.select(F.col("group_id").alias("cluster_id"), "group_id"))


def cluster_best(cl: DataFrame, of_groups: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster_id, best_file_id): the best copy stored with the smallest group of the cluster's own trust that has one."""
    own = cl.select("cluster_id", F.col("representative").alias("trust")).distinct()
    g = of_groups.join(groups.where("best_file_id is not null").select("group_id", "trust", "best_file_id"), "group_id").join(own, ["cluster_id", "trust"])
    return g.groupBy("cluster_id").agg(F.min_by("best_file_id", "group_id").alias("best_file_id"))


def cluster_summary(cl: DataFrame, best: DataFrame, files: DataFrame) -> DataFrame:
    """(cluster_id, representative, members, total_bytes, reclaimable_bytes); the best copy is kept, the largest where no member is the best."""
    j = cl.select("cluster_id", "representative", "file_id").join(files.select(F.col("id").alias("file_id"), "size_bytes"), "file_id").join(best, "cluster_id", "left")
    kept = F.coalesce(F.max(F.when(F.col("file_id") == F.col("best_file_id"), F.col("size_bytes"))), F.max("size_bytes"))
    return j.groupBy("cluster_id", "representative").agg(F.count("*").alias("members"), F.sum("size_bytes").alias("total_bytes"), F.greatest(F.sum("size_bytes") - kept, F.lit(0)).alias("reclaimable_bytes"))


def prewarm(cl: DataFrame, best: DataFrame, files: DataFrame, most: int = 4) -> DataFrame:
    """(cluster_id, file_id, place) of each cluster's first hashed members: the best copy, then by pixels, size and id."""
    px = F.coalesce(F.col("width_px").cast("long") * F.col("height_px"), F.lit(0))
    f = files.where("content_hash is not null").select(F.col("id").alias("file_id"), px.alias("px"), "size_bytes")
    j = cl.select("cluster_id", "file_id").join(f, "file_id").join(best, "cluster_id", "left").withColumn("best", F.coalesce(F.col("file_id") == F.col("best_file_id"), F.lit(False)))
    return j.selectExpr("cluster_id", "file_id", "row_number() over (partition by cluster_id order by best desc, px desc, size_bytes desc, file_id) as place").where(F.col("place") <= most)


def cluster_report(cl: DataFrame, of_groups: DataFrame) -> DataFrame:
    """One row: clusters by trust, all members, the largest, how many mix trust levels, and how many merge several groups."""
    per = cl.groupBy("cluster_id", "representative").agg(F.count("*").alias("n"), F.countDistinct("trust").alias("levels")).join(of_groups.groupBy("cluster_id").agg(F.count("*").alias("groups")), "cluster_id", "left")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    r = F.col("representative")
    return per.agg(
        F.count("*").alias("clusters"), one(r == "EXACT").alias("exact"), one(r == "VERY_LIKELY").alias("very_likely"), one(r == "POSSIBLE").alias("possible"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        one(F.col("levels") > 1).alias("cross_trust"), F.coalesce(F.sum("n"), F.lit(0)).alias("members_total"), one(F.col("groups") > 1).alias("multi_group"),
    )


def without_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without those in gone (file_id); groups left with fewer than two go as a whole."""
    left = members.join(gone.select("file_id"), "file_id", "left_anti")
    enough = left.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    return left.join(enough, "group_id", "left_semi")
