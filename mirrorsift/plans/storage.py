"""Queries of merges and of changes to tables."""

from pyspark.sql import functions as F

from mirrorsift.operators import detection as D
from mirrorsift.operators import graph as G
from mirrorsift.sources import store as ST
from mirrorsift.plans.catalog import query
from mirrorsift.plans.detection import NEAR


@query("src_merge_by_key", "SELECT id, 'new' AS v FROM files WHERE id % 3 = 0 UNION ALL SELECT id + 100000000, 'new' FROM files WHERE id % 3 = 0 UNION ALL SELECT id, 'old' FROM files WHERE id % 3 <> 0")
def _(t):
    new = t.files.where("id % 3 = 0").select("id", F.lit("new").alias("v"))
    return ST.merge_by_key(t.files.select("id", F.lit("old").alias("v")), new.unionByName(new.withColumn("id", F.col("id") + 100_000_000)), ["id"])


@query("src_insert_absent", "SELECT id, 'old' AS v FROM files UNION ALL SELECT DISTINCT id + 500, 'new' FROM files WHERE id + 500 NOT IN (SELECT id FROM files)")
def _(t):
    new = t.files.select((F.col("id") + 500).alias("id"), F.lit("new").alias("v"))
    return ST.insert_absent(t.files.select("id", F.lit("old").alias("v")), new.unionByName(new), ["id"])


@query("src_snapshot_retention", "SELECT 'snap-' || c_custkey::VARCHAR AS name, c_nationkey::BIGINT AS mtime FROM customer ORDER BY mtime DESC, name DESC LIMIT 3")
def _(t):
    return ST.newest(t.raw("customer").select(F.concat(F.lit("snap-"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").cast("long").alias("mtime")))


@query("src_versioned_features", "SELECT file_id, phash FROM phashes")
def _(t):
    import uuid

    path = f"{ST.shared_folder(t.spark)}/features-{uuid.uuid4().hex}"
    ST.write_features(t.phashes, path, "tier1")
    return ST.read_features(t.spark, path, "tier1").where("format_version = 1").select("file_id", "phash")


@query("dml_update_metadata", "SELECT id, CASE WHEN id % 4 = 1 THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN id % 4 = 1 THEN 'h264' ELSE codec END AS codec FROM files")
def _(t):
    new = t.files.where("id % 4 = 1").withColumn("deleted_at", F.lit(None).cast("long")).withColumn("codec", F.lit("h264"))
    return ST.merge_by_key(t.files, new, ["id"]).select("id", "deleted_at", "codec")


@query("dml_column_updates", "SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE content_hash END AS content_hash, CASE WHEN id % 6 = 1 THEN 1800000000 ELSE last_seen_at END AS last_seen_at, CASE WHEN id % 6 = 2 THEN 1800000001 ELSE deleted_at END AS deleted_at FROM files WHERE id % 6 <> 5")
def _(t):
    k = F.col("id") % 6
    return t.files.where(k != 5).select("id", F.when(k != 0, F.col("content_hash")).alias("content_hash"), F.when(k == 1, F.lit(1_800_000_000).cast("long")).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(k == 2, F.lit(1_800_000_001).cast("long")).otherwise(F.col("deleted_at")).alias("deleted_at"))


@query("dml_partial_features", "SELECT file_id, CASE WHEN file_id % 5 = 0 THEN true WHEN file_id % 5 = 1 THEN false ELSE has_partial END AS has_partial, CASE WHEN file_id % 5 = 0 THEN NULL WHEN file_id % 5 = 1 THEN 'unsupported' ELSE skip_reason END AS skip_reason FROM fingerprints")
def _(t):
    k = F.col("file_id") % 5
    return t.fingerprints.select("file_id", F.when(k == 0, True).when(k == 1, False).otherwise(F.col("has_partial")).alias("has_partial"), F.when(k == 0, F.lit(None)).when(k == 1, "unsupported").otherwise(F.col("skip_reason")).alias("skip_reason"))


@query("dml_delete_groups", "SELECT group_id, trust FROM groups WHERE NOT (trust = 'VERY_LIKELY' AND non_transitive)")
def _(t):
    return t.groups.where("not (trust = 'VERY_LIKELY' and non_transitive)").select("group_id", "trust")


@query("dml_membership", "SELECT group_id, file_id FROM members WHERE NOT (group_id % 9 = 0 AND file_id % 2 = 1) UNION SELECT group_id, 77777 FROM groups WHERE group_id % 9 = 1 ORDER BY 1, 2")
def _(t):
    gone = t.members.where("group_id % 9 = 0 and file_id % 2 = 1").select("group_id", "file_id")
    new = t.groups.where("group_id % 9 = 1").select("group_id", F.lit(77_777).cast("long").alias("file_id"))
    left = t.members.select("group_id", "file_id").join(gone, ["group_id", "file_id"], "left_anti")
    return ST.insert_absent(left, new, ["group_id", "file_id"]).distinct().orderBy("group_id", "file_id")


@query("dml_exact_member_ids", "SELECT DISTINCT file_id FROM members WHERE trust = 'EXACT'")
def _(t):
    return t.members.where("trust = 'EXACT'").select("file_id").distinct()


@query("dml_canonical_edges", "SELECT group_id, least(file_b, file_a) AS file_a, greatest(file_a, file_b) AS file_b, clip_start_ms IS NOT NULL AS has_span FROM edges")
def _(t):
    return t.edges.select("group_id", F.least("file_b", "file_a").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"), F.col("clip_start_ms").isNotNull().alias("has_span"))


@query("dml_journal_reads", "SELECT o_custkey AS batch_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS files FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def _(t):
    o = t.raw("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return o.select("batch_id", F.array_join(F.col("l").cast("array<string>"), ",").alias("files"))


@query("dml_scene_rows", "SELECT file_id, scene_index, ts_ms, phash FROM scenes ORDER BY file_id, ts_ms")
def _(t):
    return t.scenes.orderBy("file_id", "ts_ms")


@query("dml_enum_ranks", "SELECT group_id, CASE trust WHEN 'EXACT' THEN 3 WHEN 'VERY_LIKELY' THEN 2 ELSE 1 END AS rank FROM groups")
def _(t):
    return t.groups.select("group_id", G.trust_rank(F.col("trust")).alias("rank"))


@query("reb_exact", "SELECT min(id) OVER (PARTITION BY content_hash) AS group_id, id AS file_id FROM active QUALIFY count(*) OVER (PARTITION BY content_hash) > 1")
def _(t):
    return D.exact_members(t.active)


@query("reb_near_replaces_own_rows", """SELECT group_id, trust FROM groups WHERE trust <> 'VERY_LIKELY' OR non_transitive""")
def _(t):
    # a detector's rebuild replaces its own groups only
    return t.groups.where("trust <> 'VERY_LIKELY' or non_transitive").select("group_id", "trust")


def _near_edges(t):
    own = t.active.select(F.col("id").alias("file_id"))
    return D.hamming_join(t.phashes.join(own, "file_id", "left_semi"), NEAR)


@query("dup_near_groups")
def _(t):
    return G.near_groups(D.hamming_join(t.phashes, NEAR))


@query("reb_near")
def _(t):
    return G.rebuilt_near(t.groups, t.members, _near_edges(t))


@query("reb_near_edges")
def _(t):
    e = D.near_scores(_near_edges(t))
    low = G.near_groups(e).select("low", F.col("file_id").alias("a"))
    return e.join(low, "a").select("low", "a", "b", "score_x1000")


@query("reb_whole")
def _(t):
    own = t.active.select(F.col("id").alias("file_id"))
    scenes, sequences = t.scenes.join(own, "file_id", "left_semi"), t.sequences.join(own, "file_id", "left_semi")
    return G.rebuilt_whole(t.groups, t.members, D.whole_matches(scenes, sequences, D.AlignParams(), passing=True))
