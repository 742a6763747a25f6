"""Queries of aggregates and formats."""

from pyspark.sql import functions as F

from mirrorsift.functions import text as X
from mirrorsift.operators import summaries as A
from mirrorsift.plans.catalog import query


@query("agg_member_counts", "SELECT group_id, count(*) AS n FROM members GROUP BY group_id")
def _(t):
    return t.members.groupBy("group_id").agg(F.count("*").alias("n"))


@query("agg_all_edges_tagged", "SELECT group_id, count(*) AS edges, sum(intro_outro::INT)::BIGINT AS tagged, count(*) = sum(intro_outro::INT) AS all_tagged FROM edges GROUP BY group_id")
def _(t):
    return A.tagged_groups(t.edges)


@query("agg_skip_histogram", "SELECT skip_reason, count(*) AS n FROM fingerprints WHERE skip_reason IS NOT NULL GROUP BY skip_reason ORDER BY n DESC, skip_reason")
def _(t):
    return t.fingerprints.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skip_reason")


@query("agg_distinct_payloads", "SELECT count(DISTINCT path) + count(*) FILTER (WHERE path IS NULL) AS n, count(DISTINCT path) AS paths, count(*) FILTER (WHERE path IS NULL) AS without FROM tasks WHERE state = 'PENDING' AND priority >= -100")
def _(t):
    p = t.tasks.where("state = 'PENDING' and priority >= -100")
    g = p.agg(F.countDistinct("path").alias("paths"), F.sum(F.when(F.col("path").isNull(), 1).otherwise(0)).alias("without"))
    return g.select((F.col("paths") + F.coalesce("without", F.lit(0))).alias("n"), "paths", F.coalesce("without", F.lit(0)).cast("long").alias("without"))


@query("agg_queue_scalars", """SELECT coalesce(sum(size_bytes) FILTER (WHERE state IN ('PENDING', 'RUNNING')), 0)::BIGINT AS outstanding_bytes, coalesce(max(id), 0) AS max_id, min(enqueued_at) FILTER (WHERE state = 'PENDING') AS next_due,
 (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM active) AS active_bytes FROM tasks""")
def _(t):
    q = t.tasks.agg(F.coalesce(F.sum(F.when(F.col("state").isin("PENDING", "RUNNING"), F.col("size_bytes"))), F.lit(0)).alias("outstanding_bytes"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
                    F.min(F.when(F.col("state") == "PENDING", F.col("enqueued_at"))).alias("next_due"))
    a = t.active.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("active_bytes"))
    return q.join(F.broadcast(a))  # one row each


@query("agg_tasks_by_state", "SELECT state, kind, priority, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM tasks GROUP BY ALL")
def _(t):
    return t.tasks.groupBy("state", "kind", "priority").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("agg_failed_by_payload", "SELECT path, kind, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM tasks WHERE state = 'FAILED' GROUP BY path, kind")
def _(t):
    return t.tasks.where("state = 'FAILED'").groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


_ROLL = """roll AS (SELECT m.group_id, count(*) AS members, sum(size_bytes)::BIGINT AS total_bytes,
 (sum(size_bytes) - coalesce(max(size_bytes) FILTER (WHERE file_id = best_file_id), max(size_bytes)))::BIGINT AS reclaimable_bytes FROM members m JOIN groups g USING (group_id) JOIN files ON id = file_id GROUP BY m.group_id)"""


@query("agg_reclaimable_by_group", "SELECT * FROM roll", _ROLL)
def _(t):
    return A.group_rollup(t.groups, t.members, t.files)


@query("agg_reclaimable_total", "SELECT count(*) AS groups, sum(members)::BIGINT AS members, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes, max(members) AS largest FROM roll", _ROLL)
def _(t):
    return A.group_rollup(t.groups, t.members, t.files).agg(F.count("*").alias("groups"), F.sum("members").alias("members"), F.sum("reclaimable_bytes").alias("reclaimable_bytes"), F.max("members").alias("largest"))


@query("agg_frame_means", "SELECT id, bitrate_bps::DOUBLE / (width_px::DOUBLE * height_px::DOUBLE * (fps_x1000::DOUBLE / 1000.0::DOUBLE)) AS bpp FROM files WHERE width_px IS NOT NULL")
def _(t):
    return t.files.where("width_px is not null").select("id", A.bits_per_pixel(F.col("bitrate_bps"), F.col("width_px"), F.col("height_px"), F.col("fps_x1000")).alias("bpp"))


@query("agg_gop_signature", "SELECT file_id, count(*) AS keyframes, (sum(len) // count(*))::BIGINT AS mean_ms, max(len) AS max_ms FROM (SELECT file_id, 2500 + phash % 1000 AS len FROM scenes) GROUP BY file_id")
def _(t):
    return t.scenes.select("file_id", (F.lit(2500) + F.col("phash") % 1000).alias("len")).groupBy("file_id").agg(*A.gop_signature(F.col("len")))


@query("agg_nearest_rank", "SELECT lang AS key, list_sort(list(n_chars))[greatest(ceil(0.95 * count(*)), 1)::INT] AS value FROM documents GROUP BY lang")
def _(t):
    return A.nearest_rank(t.raw("documents").select(F.col("lang").alias("key"), "n_chars"), "n_chars", 0.95, "key")


@query("agg_gate_report", """SELECT coalesce(min(d) FILTER (WHERE p), 0.0)::DOUBLE AS passing_min, coalesce(max(d) FILTER (WHERE p), 0.0)::DOUBLE AS passing_max, coalesce(min(d) FILTER (WHERE NOT p AND e), 0.0)::DOUBLE AS failing_min,
 coalesce(max(d) FILTER (WHERE NOT p AND e), 0.0)::DOUBLE AS failing_max FROM (SELECT score_x1000 / 1000.0::DOUBLE AS d, score_x1000 >= 950 AS p, file_b % 3 = 0 AS e FROM edges)""")
def _(t):
    return A.gate_report(t.edges.select((F.col("score_x1000") / F.lit(1000.0)).alias("density"), (F.col("score_x1000") >= 950).alias("passes"), (F.col("file_b") % 3 == 0).alias("near_equal")))


@query("agg_progress_snapshot", """SELECT (SELECT count(*) FROM active) AS files, (SELECT count(*) FROM fingerprints) AS fingerprinted, (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM tasks WHERE state = 'PENDING') AS pending,
 (SELECT count(*) FROM tasks WHERE state = 'RUNNING') AS running, (SELECT count(*) FROM tasks WHERE state = 'FAILED') AS failed,
 greatest((SELECT count(*) FROM active JOIN fingerprints ON id = file_id) - (SELECT count(*) FROM active WHERE id IN (SELECT o_custkey FROM orders JOIN tasks ON id = o_orderkey WHERE state = 'RUNNING')), 0) AS done""")
def _(t):
    states = t.tasks.agg(*[F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s.lower()) for s in ("PENDING", "RUNNING", "FAILED")])
    busy = t.raw("orders").join(t.tasks.where("state = 'RUNNING'").select(F.col("id").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("id"))
    one = [t.active.agg(F.count("*").alias("files")), t.fingerprints.agg(F.count("*").alias("fingerprinted")), t.groups.agg(F.count("*").alias("groups")), states,
           t.fingerprints.join(t.active.select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.count("*").alias("indexed")), t.active.join(busy, "id", "left_semi").agg(F.count("*").alias("inflight"))]
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out.withColumn("done", F.greatest(F.col("indexed") - F.col("inflight"), F.lit(0))).drop("indexed", "inflight")


@query("fmt_labels", """SELECT id, CASE WHEN size_bytes <= 0 THEN '0 B' WHEN size_bytes < 1024 THEN size_bytes::VARCHAR || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', floor(size_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10)
  WHEN size_bytes < 1073741824 THEN printf('%.1f MB', floor(size_bytes / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(size_bytes / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size,
 CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration,
 CASE WHEN width_px IS NULL OR height_px IS NULL THEN NULL WHEN greatest(width_px, height_px) >= 3840 THEN '4K' WHEN greatest(width_px, height_px) >= 2560 THEN '1440p' WHEN least(width_px, height_px) >= 1080 THEN '1080p'
  WHEN least(width_px, height_px) >= 720 THEN '720p' WHEN least(width_px, height_px) >= 480 THEN '480p' ELSE least(width_px, height_px)::VARCHAR || 'p' END AS resolution,
 CASE WHEN bitrate_bps > 0 THEN printf('%.1f Mbps', floor(bitrate_bps / 1000000.0::DOUBLE * 10 + 0.5) / 10) ELSE '—' END AS bitrate FROM (SELECT *, greatest((duration_ms + 500) // 1000, 0) AS s FROM files)""")
def _(t):
    return t.files.select("id", X.size_label(F.col("size_bytes")).alias("size"), X.duration_label(F.col("duration_ms")).alias("duration"), X.resolution_label(F.col("width_px"), F.col("height_px")).alias("resolution"), X.bitrate_label(F.col("bitrate_bps")).alias("bitrate"))


@query("fmt_trust_labels", """SELECT group_id, CASE trust WHEN 'EXACT' THEN 'exact' WHEN 'VERY_LIKELY' THEN 'very-likely' ELSE 'possible' END AS class, CASE trust WHEN 'EXACT' THEN '완전 동일' WHEN 'VERY_LIKELY' THEN '유사 (재인코딩)' ELSE '유사 (추정)' END AS label,
 CASE trust WHEN 'EXACT' THEN '완전 동일' WHEN 'VERY_LIKELY' THEN '재인코딩' ELSE '추정' END AS short_label FROM groups""")
def _(t):
    x = F.col("trust")
    return t.groups.select("group_id", X.named(x, X.TRUST_CLASS).alias("class"), X.named(x, X.TRUST_LABEL).alias("label"), X.named(x, X.TRUST_SHORT_LABEL).alias("short_label"))


@query("fmt_relative_activity", """SELECT series, ts_ms, CASE WHEN s < 5 THEN '방금' WHEN s < 60 THEN s::VARCHAR || '초 전' WHEN s < 3600 THEN (s // 60)::VARCHAR || '분 전' WHEN s < 86400 THEN (s // 3600)::VARCHAR || '시간 전' ELSE (s // 86400)::VARCHAR || '일 전' END AS label
 FROM (SELECT series, ts_ms, done % 7 * 40000 // 1000 AS s FROM samples)""")
def _(t):
    now = F.col("ts_ms") + F.col("done") % 7 * 40_000
    return t.samples.select("series", "ts_ms", X.relative_activity(F.col("ts_ms"), now).alias("label"))


@query("fmt_progress_ratios", """SELECT series, ts_ms, pending + running + done + failed AS total, CASE WHEN pending + running + done + failed = 0 THEN 0.0 ELSE (done + failed) / (pending + running + done + failed) END::DOUBLE AS fraction, pending + running AS remaining FROM samples""")
def _(t):
    total = F.col("pending") + F.col("running") + F.col("done") + F.col("failed")
    return t.samples.select("series", "ts_ms", total.alias("total"), F.coalesce(F.try_divide(F.col("done") + F.col("failed"), total), F.lit(0.0)).alias("fraction"), (F.col("pending") + F.col("running")).alias("remaining"))


@query("fmt_paths", """SELECT id, replace(replace(path, '/', chr(92)), chr(92), '/') AS path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS parent, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext,
 substr(sha256('salt' || path), 1, 16) || '.' || CASE WHEN container IN ('mp4', 'mkv', 'avi', 'webm') THEN container ELSE 'bin' END AS redacted FROM files""")
def _(t):
    back = F.replace("path", F.lit("/"), F.lit("\\"))
    return t.files.select("id", X.normal_path(back).alias("path"), X.base_name(F.col("path")).alias("name"), X.parent_dir(F.col("path")).alias("parent"), X.extension(F.col("path")).alias("ext"), X.redacted(F.col("path"), "salt").alias("redacted"))


@query("fmt_backoff", "SELECT id, least(2000 * (2 ** attempts), 30000)::BIGINT AS wait_ms FROM tasks")
def _(t):
    return t.tasks.select("id", X.backoff(F.col("attempts"), 2_000, 30_000).alias("wait_ms"))


@query("fmt_skip_breakdown", "SELECT string_agg(skip_reason || '=' || n::VARCHAR, ', ' ORDER BY n DESC, skip_reason) AS breakdown FROM (SELECT skip_reason, count(*) AS n FROM fingerprints WHERE skip_reason IS NOT NULL GROUP BY skip_reason)")
def _(t):
    g = t.fingerprints.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "skip_reason")))
    return g.agg(F.array_join(F.transform(rows, lambda r: F.concat(r["skip_reason"], F.lit("="), (-r["m"]).cast("string"))), ", ").alias("breakdown"))


@query("fmt_sparkline", "SELECT series, ts_ms, CASE WHEN hi = lo THEN 0.5 ELSE (done - lo) / (hi - lo) END::DOUBLE AS height FROM (SELECT *, min(done) OVER (PARTITION BY series) AS lo, max(done) OVER (PARTITION BY series) AS hi FROM samples)")
def _(t):
    e = t.samples.groupBy("series").agg(F.min("done").alias("lo"), F.max("done").alias("hi"))
    return t.samples.join(e, "series").select("series", "ts_ms", F.coalesce(F.try_divide(F.col("done") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)).alias("height"))
