"""Queries of scans, filters and joins."""

from pyspark.sql import functions as F

from mirrorsift.operators import selection as S
from mirrorsift.plans.catalog import query

_IN = ", ".join(f"'{e}'" for e in S.VIDEO_EXTENSIONS)
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_FAST = "(codec IS NULL OR codec IN ('h264', 'hevc', 'h265'))"


@query("src_extension_filter", f"SELECT id, path, {_EXT} AS ext FROM files WHERE {_EXT} IN ({_IN})")
def _(t):
    return t.files.where(S.accepts_extension(F.col("path"))).select("id", "path", S.extension(F.col("path")).alias("ext"))


@query("src_excluded_dirs", """SELECT id, path2 FROM (SELECT id, replace(replace(path, '/src1/', '/Found.000/'), '/src2/', '/Recovery/') AS path2 FROM files)
 WHERE len(list_filter(string_split(regexp_replace(path2, '/[^/]*$', ''), '/'), lambda p: lower(p) IN ('$recycle.bin', 'system volume information', 'recovery', 'node_modules') OR starts_with(lower(p), 'found.'))) = 0""")
def _(t):
    f = t.files.select("id", F.replace(F.replace("path", F.lit("/src1/"), F.lit("/Found.000/")), F.lit("/src2/"), F.lit("/Recovery/")).alias("path2"))
    return f.where(~S.under_excluded_dir(F.col("path2")))


@query("src_resumable_scan", "SELECT path FROM files WHERE path > (SELECT path FROM files WHERE id = 42)")
def _(t):
    sentinel = t.files.where("id = 42").select("path").first()
    return S.resume_after(t.files, sentinel["path"] if sentinel else "").select("path")


@query("src_resume_unknown_sentinel", "SELECT path FROM files WHERE path > '/nowhere' AND EXISTS (SELECT 1 FROM files WHERE path = '/nowhere')")
def _(t):
    return S.resume_after(t.files, "/nowhere").select("path")


@query("src_scan_progress", "SELECT path, count(*) OVER w AS files_seen, (sum(size_bytes) OVER w)::BIGINT AS bytes_seen FROM files WINDOW w AS (ORDER BY path)")
def _(t):
    return S.scan_progress(t.files.select("path", "size_bytes"))


@query("src_derived_metadata", """SELECT id, ((duration_ms * 90 * 1000 + 45000) // 90000)::BIGINT AS ms, (size_bytes * 8 * 1000 // duration_ms)::BIGINT AS bitrate,
 round(frames * 1000.0 / duration_ms * 1000)::BIGINT AS fps FROM (SELECT *, duration_ms * 24 // 1000 AS frames FROM files) WHERE duration_ms > 0""")
def _(t):
    f = t.files.where("duration_ms > 0").withColumn("frames", F.expr("duration_ms * 24 div 1000"))
    return f.select("id", S.rescale_to_ms(F.col("duration_ms") * 90, F.lit(90_000)).alias("ms"), F.expr("size_bytes * 8 * 1000 div duration_ms").alias("bitrate"),
                    F.round(F.col("frames") * 1000.0 / F.col("duration_ms") * 1000).cast("long").alias("fps"))


_RUNS = """runs AS (SELECT id AS file_id, k AS run, id % 5 + k + 1 AS n, 1000 + k * 500 AS delta FROM files, (VALUES (0), (1), (2)) v(k)),
ticks AS (SELECT file_id, (first + k.k + 1)::BIGINT AS sample, (base + k.k * delta)::BIGINT AS ticks FROM (
 SELECT *, sum(n) OVER w - n AS first, sum(n * delta) OVER w - n * delta AS base, unnest(range(0, n)) AS k FROM runs WINDOW w AS (PARTITION BY file_id ORDER BY run)) k)"""


def _runs(t):
    return t.files.select(F.col("id").alias("file_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run")).select(
        "file_id", "run", (F.col("file_id") % 5 + F.col("run") + 1).alias("n"), (F.lit(1000) + F.col("run") * 500).cast("long").alias("delta"))


@query("src_sample_decode_times", "SELECT * FROM ticks", _RUNS)
def _(t):
    return S.decode_times(_runs(t))


@query("src_gop_index", """SELECT file_id, sample AS index, ticks AS at, coalesce(lead(sample) OVER w, last + 1) - sample AS gop_size, coalesce(lead(ticks) OVER w, total) - ticks AS gop_length
 FROM (SELECT t.*, max(sample) OVER (PARTITION BY file_id) AS last, max(ticks) OVER (PARTITION BY file_id) + 2000 AS total FROM ticks t) WHERE sample % 3 = 1 WINDOW w AS (PARTITION BY file_id ORDER BY sample)""", _RUNS)
def _(t):
    s = S.decode_times(_runs(t))
    ends = _runs(t).groupBy("file_id").agg((F.sum("n") + 1).alias("end_index"), F.sum(F.col("n") * F.col("delta")).alias("total"))
    keys = s.where("sample % 3 = 1").select("file_id", F.col("sample").alias("index"), F.col("ticks").alias("at"))
    return S.gops(keys.join(ends, "file_id"), "total")


@query("src_cue_gops", "SELECT file_id, scene_index AS index, ts_ms AS at, coalesce(lead(scene_index) OVER w, n) - scene_index AS gop_size, coalesce(lead(ts_ms) OVER w, n * 2500) - ts_ms AS gop_length FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM scenes) WHERE scene_index % 2 = 0 WINDOW w AS (PARTITION BY file_id ORDER BY scene_index)")
def _(t):
    n = t.scenes.groupBy("file_id").agg(F.count("*").alias("end_index"))
    cues = t.scenes.where("scene_index % 2 = 0").select("file_id", F.col("scene_index").alias("index"), F.col("ts_ms").alias("at")).join(n, "file_id")
    return S.gops(cues.withColumn("end", F.col("end_index") * 2500), "end")


@query("src_content_hash", "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def _(t):
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))


@query("src_hash_cache", "SELECT f.id, coalesce(c.content_hash, f.content_hash) AS content_hash, c.id IS NOT NULL AS cached FROM files f LEFT JOIN (SELECT id, size_bytes + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS size_bytes, mtime_ns, 'cached:' || id::VARCHAR AS content_hash FROM files WHERE id % 2 = 0) c USING (id, size_bytes, mtime_ns)")
def _(t):
    c = t.files.where("id % 2 = 0").select("id", (F.col("size_bytes") + F.when(F.col("id") % 6 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns", F.concat(F.lit("cached:"), F.col("id").cast("string")).alias("c"))
    return t.files.join(c, ["id", "size_bytes", "mtime_ns"], "left").select("id", F.coalesce("c", "content_hash").alias("content_hash"), F.col("c").isNotNull().alias("cached"))


@query("fil_active_files", "SELECT id, path, size_bytes FROM active")
def _(t):
    return S.active(t.files).select("id", "path", "size_bytes")


@query("fil_active_count", "SELECT count(*) AS n FROM active")
def _(t):
    return S.active(t.files).agg(F.count("*").alias("n"))


@query("fil_hashed_active", "SELECT id, content_hash FROM active WHERE content_hash IS NOT NULL ORDER BY id")
def _(t):
    return S.hashed_active(t.files).select("id", "content_hash").orderBy("id")


@query("fil_subtree", "SELECT id, path FROM active WHERE path = '/src3/en' OR starts_with(path, '/src3/en/')")
def _(t):
    return t.active.where(S.in_subtree(F.col("path"), "/src3/en/")).select("id", "path")


@query("fil_id_list", "SELECT id, path FROM files WHERE id IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.files.join(t.raw("orders").select(F.col("o_custkey").alias("id")), "id", "left_semi").select("id", "path")


@query("fil_active_twin", """SELECT f.id, min(g.id) AS twin_id FROM files f JOIN active g ON f.content_hash = g.content_hash AND f.path <> g.path
 WHERE g.id IN (SELECT file_id FROM fingerprints) GROUP BY f.id""")
def _(t):
    return S.twins_with_features(t.files, t.fingerprints)


@query("fil_by_hash", "SELECT id, path FROM files WHERE content_hash = (SELECT content_hash FROM files WHERE id = 7)")
def _(t):
    h = t.files.where("id = 7").select("content_hash")
    return t.files.join(F.broadcast(h.limit(1)), "content_hash", "left_semi").select("id", "path")


@query("fil_fingerprint_variants", """SELECT file_id, true AS tier1, has_tier2 AS tier2, has_partial AS partial, has_partial OR skip_reason IS NOT NULL AS partial_or_skipped,
 coalesce(skip_reason <> 'timeout', true) AS not_timeout FROM fingerprints JOIN active ON file_id = id""")
def _(t):
    return S.with_active_file(t.fingerprints, t.files).select(
        "file_id", F.lit(True).alias("tier1"), F.col("has_tier2").alias("tier2"), F.col("has_partial").alias("partial"), (F.col("has_partial") | F.col("skip_reason").isNotNull()).alias("partial_or_skipped"),
        F.coalesce(F.col("skip_reason") != "timeout", F.lit(True)).alias("not_timeout"))


@query("fil_codec_routing", f"SELECT id, CASE WHEN {_FAST} THEN 'fast' ELSE 'other' END AS route FROM active JOIN fingerprints ON id = file_id")
def _(t):
    return S.with_active_file(t.fingerprints, t.files, "codec").select(F.col("file_id").alias("id"), F.when(S.fast_path(F.col("codec")), "fast").otherwise("other").alias("route"))


@query("fil_fallback_rate", "SELECT container, count(*) FILTER (WHERE NOT coalesce(codec IN ('h264', 'hevc', 'h265'), false)) AS fallback, count(*) AS total, coalesce(count(*) FILTER (WHERE NOT coalesce(codec IN ('h264', 'hevc', 'h265'), false)) / count(*), 0.0)::DOUBLE AS rate FROM files GROUP BY container")
def _(t):
    slow = ~F.coalesce(F.col("codec").isin(*S.FAST_CODECS), F.lit(False))
    g = t.files.groupBy("container").agg(F.sum(slow.cast("long")).alias("fallback"), F.count("*").alias("total"))
    return g.withColumn("rate", F.coalesce(F.try_divide(F.col("fallback"), F.col("total")), F.lit(0.0)))


@query("fil_skip_markers", "SELECT file_id, skip_reason, skip_reason = 'exact-full-dup' OR (skip_size = size_bytes AND skip_mtime = mtime_ns) AS holds FROM fingerprints JOIN files ON id = file_id WHERE skip_reason IS NOT NULL")
def _(t):
    return S.valid_markers(t.fingerprints, t.files)


@query("fil_failure_class", """SELECT id, CASE WHEN contains(last_error, 'timed out after') OR contains(last_error, 'decode gate at capacity (concurrent') OR contains(last_error, 'sequential-read gate at capacity (concurrent full-file reads in flight)')
 OR contains(last_error, 'resource busy or locked') OR contains(last_error, 'is locked') OR attempts < 1 THEN 'transient' ELSE 'permanent' END AS class FROM tasks WHERE last_error IS NOT NULL""")
def _(t):
    return t.tasks.where("last_error is not null").select("id", S.failure_class(F.col("last_error"), F.col("attempts")).alias("class"))


@query("fil_delete_staleness", "SELECT p.path, CASE WHEN l.path IS NULL THEN 'absent' WHEN l.size_bytes <> p.size_bytes OR l.mtime_ns <> p.mtime_ns THEN 'stale' ELSE 'fresh' END AS verdict FROM previous p LEFT JOIN listing l USING (path)")
def _(t):
    return S.staleness(t.previous, t.listing)


@query("fil_point_lookup", "SELECT id, path, size_bytes FROM files WHERE id = 42")
def _(t):
    return t.files.where("id = 42").select("id", "path", "size_bytes")


@query("join_group_member_deleted_gone", "SELECT group_id, file_id FROM groups JOIN members USING (group_id) LEFT JOIN files ON id = file_id WHERE deleted_at IS NULL")
def _(t):
    return S.groups_without_deleted(t.groups, t.members, t.files).select("group_id", "file_id")


@query("join_group_active_members", "SELECT g.group_id, m.file_id FROM groups g LEFT JOIN (SELECT group_id, file_id FROM members JOIN active ON id = file_id) m USING (group_id)")
def _(t):
    return S.groups_with_active(t.groups, t.members, t.files).select("group_id", "file_id")


@query("join_member_sizes", "SELECT group_id, file_id, size_bytes FROM members JOIN files ON id = file_id")
def _(t):
    return t.members.join(t.files.select(F.col("id").alias("file_id"), "size_bytes"), "file_id").select("group_id", "file_id", "size_bytes")


@query("join_groups_of_file", "SELECT m.file_id, m.group_id, g.trust FROM members m JOIN groups g USING (group_id) WHERE m.file_id BETWEEN 10 AND 60")
def _(t):
    return t.members.where("file_id between 10 and 60").select("group_id", "file_id").join(t.groups.select("group_id", "trust"), "group_id")


@query("join_edges_by_trust", "SELECT e.group_id, e.file_a, e.file_b, e.score_x1000 FROM edges e JOIN groups g USING (group_id) WHERE g.trust = 'VERY_LIKELY'")
def _(t):
    g = t.groups.where("trust = 'VERY_LIKELY'").select("group_id")
    return t.edges.join(g, "group_id", "left_semi").select("group_id", "file_a", "file_b", "score_x1000")


@query("join_backfill_set", "SELECT id FROM active WHERE id NOT IN (SELECT file_id FROM fingerprints WHERE has_partial OR (skip_reason IS NOT NULL AND skip_reason <> 'exact-full-dup')) AND id NOT IN (SELECT file_id FROM members WHERE trust = 'EXACT')")
def _(t):
    return S.backfill(t.files, t.fingerprints, t.members.where("trust = 'EXACT'")).select("id")


@query("join_inflight_indexed", "SELECT id, path FROM active WHERE content_hash IS NOT NULL AND id IN (SELECT o_custkey FROM orders JOIN tasks ON id = o_orderkey WHERE state IN ('RUNNING', 'FAILED'))")
def _(t):
    busy = t.tasks.where("state in ('RUNNING', 'FAILED')").select(F.col("id").alias("k"))
    keys = t.raw("orders").join(busy, F.col("o_orderkey") == F.col("k"), "left_semi").select(F.col("o_custkey").alias("id"))
    return S.hashed_active(t.files).join(keys, "id", "left_semi").select("id", "path")
