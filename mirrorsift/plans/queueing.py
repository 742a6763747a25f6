"""Queries of the task queue and of pages and tops."""

from pyspark.sql import functions as F

from mirrorsift.operators import queueing as Q
from mirrorsift.plans.catalog import query

NOW = 820_000_000
_DUE = f"state = 'PENDING' AND enqueued_at <= {NOW}"


@query("tq_claim_order", f"SELECT id, priority, enqueued_at FROM tasks WHERE {_DUE} ORDER BY priority DESC, enqueued_at, id LIMIT 50")
def _(t):
    return Q.claim_order(t.tasks, NOW).select("id", "priority", "enqueued_at").limit(50)


@query("tq_claim_above_priority", f"SELECT id FROM tasks WHERE {_DUE} AND kind = 'index' AND priority >= -100 ORDER BY priority DESC, enqueued_at, id LIMIT 1")
def _(t):
    return Q.claim_order(t.tasks, NOW, kind="index", least_priority=-100).select("id").limit(1)


@query("tq_claim_update", f"SELECT t.id, CASE WHEN c.id IS NOT NULL THEN 'RUNNING' ELSE state END AS state, attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS attempts FROM tasks t LEFT JOIN (SELECT id FROM tasks WHERE {_DUE} ORDER BY priority DESC, enqueued_at, id LIMIT 8) c USING (id)")
def _(t):
    return Q.claim(t.tasks, 8, NOW).select("id", "state", "attempts")


@query("tq_recover", f"SELECT id, CASE WHEN state = 'RUNNING' THEN 'PENDING' ELSE state END AS state, CASE WHEN state IN ('RUNNING', 'PENDING') THEN least(enqueued_at, {NOW}) ELSE enqueued_at END AS enqueued_at FROM tasks")
def _(t):
    return Q.recover(t.tasks, NOW).select("id", "state", "enqueued_at")


@query("tq_backoff", "SELECT id, enqueued_at + CASE last_error WHEN 'database is locked' THEN 2 ELSE 30 END AS due FROM tasks WHERE state = 'FAILED'")
def _(t):
    reason = F.when(F.col("last_error") == "database is locked", "write-contention").otherwise(F.col("last_error"))
    return t.tasks.where("state = 'FAILED'").select("id", (F.col("enqueued_at") + Q.busy_seconds(reason)).alias("due"))


@query("tq_latest_state", "SELECT user_id AS id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def _(t):
    return Q.latest_states(t.raw("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@query("tq_payloads_after", "SELECT id, path, state FROM tasks WHERE kind = 'index' AND id > 5000 AND state <> 'FAILED' ORDER BY id")
def _(t):
    return t.tasks.where("kind = 'index' and id > 5000 and state <> 'FAILED'").select("id", "path", "state").orderBy("id")


@query("tq_active_payloads", "SELECT path, list_sort(list(id))[1] AS first_id, count(*) AS n FROM tasks WHERE state IN ('PENDING', 'RUNNING') AND path IS NOT NULL GROUP BY path")
def _(t):
    return t.tasks.where("state in ('PENDING', 'RUNNING') and path is not null").groupBy("path").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query("tq_regroup_set", "SELECT o_custkey AS file_id, max(epoch(o_orderdate)::BIGINT) AS enqueued_at FROM orders GROUP BY o_custkey")
def _(t):
    return t.raw("orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.max(F.unix_timestamp("o_orderdate")).alias("enqueued_at"))


@query("tq_rate_limit")
def _(t):
    e = t.raw("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series"), (F.unix_timestamp("ts") * 1000).alias("ts_ms"))
    return Q.token_bucket(e, rate=1 / 7200, burst=3)


@query("top_failed_tasks", """SELECT path, max(id) AS id, sum(greatest(attempts, 0))::BIGINT AS attempts, arg_max(coalesce(last_error, 'task failed'), id) AS reason FROM tasks
 WHERE state = 'FAILED' AND priority >= 0 AND path IS NOT NULL AND path NOT IN (SELECT '/f/' || id::VARCHAR FROM active WHERE content_hash IS NOT NULL) GROUP BY path ORDER BY id DESC LIMIT 25""")
def _(t):
    hashed = t.active.where("content_hash is not null").select(F.concat(F.lit("/f/"), F.col("id").cast("string")).alias("path"))
    return Q.failed_tasks(t.tasks, hashed, 25)


@query("top_group_page", "SELECT group_id, trust FROM groups WHERE trust = 'VERY_LIKELY' ORDER BY group_id LIMIT 30 OFFSET 20")
def _(t):
    return t.groups.where("trust = 'VERY_LIKELY'").select("group_id", "trust").orderBy("group_id").offset(20).limit(30)


@query("top_empty_page", "SELECT group_id, trust FROM groups ORDER BY group_id LIMIT 30 OFFSET 100000000")
def _(t):
    return t.groups.select("group_id", "trust").orderBy("group_id").offset(100_000_000).limit(30)


@query("top_latest_done", "SELECT id FROM tasks WHERE state = 'DONE' ORDER BY id DESC LIMIT 1")
def _(t):
    return t.tasks.where("state = 'DONE'").select("id").orderBy(F.desc("id")).limit(1)


@query("top_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def _(t):
    return t.raw("events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(200)


@query("top_timeline_cap", "SELECT source, clip, coverage FROM (SELECT file_a % 20 AS source, file_b AS clip, (matched_scenes * 1000 // clip_scenes)::BIGINT AS coverage, row_number() OVER (PARTITION BY file_a % 20 ORDER BY matched_scenes * 1000 // clip_scenes DESC, file_b) AS rn FROM edges WHERE trust = 'POSSIBLE') WHERE rn <= 3")
def _(t):
    e = t.edges.where("trust = 'POSSIBLE'").selectExpr("file_a % 20 as source", "file_b as clip", "matched_scenes * 1000 div clip_scenes as coverage")
    return e.selectExpr("*", "row_number() over (partition by source order by coverage desc, clip) as rn").where("rn <= 3").drop("rn")


@query("set_changed_union", "SELECT id FROM files WHERE id % 7 = 1 UNION SELECT file_id FROM members WHERE trust = 'EXACT'")
def _(t):
    return t.files.where("id % 7 = 1").select("id").union(t.members.where("trust = 'EXACT'").select("file_id")).distinct()


@query("set_removed_folders", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM previous EXCEPT SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') FROM listing")
def _(t):
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return t.previous.select(folder).distinct().join(t.listing.select(folder).distinct(), "folder", "left_anti")


@query("set_intro_outro_split", "SELECT group_id, file_b, NOT intro_outro AS visible FROM edges WHERE trust = 'POSSIBLE'")
def _(t):
    return t.edges.where("trust = 'POSSIBLE'").select("group_id", "file_b", (~F.col("intro_outro")).alias("visible"))


@query("set_clusters_equal", "SELECT count(*) = 0 AS equal FROM ((SELECT group_id, file_id FROM members EXCEPT SELECT group_id, file_id FROM members WHERE file_id % 1000 <> 5) UNION ALL (SELECT group_id, file_id FROM members WHERE file_id % 1000 <> 5 EXCEPT SELECT group_id, file_id FROM members))")
def _(t):
    a = t.members.select("group_id", "file_id")
    b = a.where("file_id % 1000 <> 5")
    diff = a.exceptAll(b).unionByName(b.exceptAll(a))
    return diff.agg((F.count("*") == 0).alias("equal"))
