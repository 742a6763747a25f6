"""Queries of changes and series."""

from pyspark.sql import functions as F

from mirrorsift.operators import changes as C
from mirrorsift.operators import selection as S
from mirrorsift.plans.catalog import query

_DIFF = """df AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
 WHEN o.size_bytes = n.size_bytes AND o.mtime_ns = n.mtime_ns AND (o.inode IS NULL OR n.inode IS NULL OR o.inode = n.inode) THEN 'unchanged' ELSE 'modified' END AS change FROM previous o FULL JOIN listing n ON o.path = n.path)"""
_IN = ", ".join(f"'{e}'" for e in S.VIDEO_EXTENSIONS)
_EV = f"""ev AS (SELECT event_id, ts, path, 'Upsert' AS change FROM changes WHERE kind IN ('create', 'modify', 'rename_to')
 UNION ALL SELECT event_id, ts, path, 'Remove' FROM changes WHERE kind IN ('remove', 'rename_from', 'rename_both') UNION ALL SELECT event_id, ts, new_path, 'Upsert' FROM changes WHERE kind = 'rename_both'),
ec AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM ev WHERE path IS NOT NULL),
cv AS (SELECT event_id, ts, path, change FROM ec WHERE x IN ({_IN}) OR (change = 'Remove' AND x = ''))"""


@query("cdc_snapshot_diff", "SELECT * FROM df", _DIFF)
def _(t):
    return C.snapshot_diff(t.previous, t.listing)


@query("cdc_diff_counts", "SELECT change, count(*) AS n FROM df GROUP BY change", _DIFF)
def _(t):
    return C.snapshot_diff(t.previous, t.listing).groupBy("change").agg(F.count("*").alias("n"))


@query("cdc_classify_events", "SELECT event_id, path, change FROM cv", _EV)
def _(t):
    return C.classify_events(t.changes).select("event_id", "path", "change")


@query("cdc_debounce", """SELECT path, min(ts) AS released_from, max(ts) AS last_ts, arg_max(change, [epoch_us(ts), event_id]) AS change, count(*) AS n FROM (
 SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS island FROM (
  SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS prev FROM cv)) GROUP BY path, island""", _EV)
def _(t):
    return C.debounce(C.classify_events(t.changes), "6 hours")


@query("cdc_enqueue_reconcile", """SELECT i.path, i.change, CASE WHEN coalesce(list_contains(kinds, i.change), false) OR (i.change = 'Upsert' AND (coalesce(list_contains(kinds, 'Upsert'), false) OR coalesce(list_contains(kinds, 'ForceUpsert'), false)))
  OR (i.change = 'Upsert' AND f.path IS NOT NULL) THEN 'skip' WHEN i.change = 'ForceUpsert' AND coalesce(list_contains(kinds, 'Upsert'), false) THEN 'replace' ELSE 'insert' END AS outcome,
 CASE WHEN NOT coalesce(list_contains(kinds, 'ForceUpsert'), false) AND i.change = 'ForceUpsert' THEN up END AS replaces
 FROM (SELECT '/f/' || c_custkey::VARCHAR AS path, CASE c_custkey % 3 WHEN 0 THEN 'Upsert' WHEN 1 THEN 'ForceUpsert' ELSE 'Remove' END AS change, c_custkey * 100 AS size_bytes FROM customer) i
 LEFT JOIN (SELECT path, list(DISTINCT change) AS kinds, max(id) FILTER (WHERE change = 'Upsert') AS up FROM tasks WHERE state IN ('PENDING', 'RUNNING') GROUP BY path) a USING (path)
 LEFT JOIN (SELECT DISTINCT path, size_bytes FROM tasks WHERE state = 'FAILED') f ON f.path = i.path AND f.size_bytes = i.size_bytes""")
def _(t):
    key = F.col("c_custkey")
    i = t.raw("customer").select(F.concat(F.lit("/f/"), key.cast("string")).alias("path"), F.when(key % 3 == 0, "Upsert").when(key % 3 == 1, "ForceUpsert").otherwise("Remove").alias("change"), (key * 100).alias("size_bytes"))
    return C.reconcile_enqueue(i, t.tasks)


@query("cdc_initial_scan", "SELECT path, change FROM df WHERE change IN ('added', 'modified')", _DIFF)
def _(t):
    return C.initial_scan(t.previous, t.listing)


@query("cdc_missing_paths", "SELECT path FROM active WHERE (starts_with(path, '/src1/') OR starts_with(path, '/src2/')) AND id % 3 = 0")
def _(t):
    return C.missing_paths(t.active.select("path"), t.files.where("id % 3 <> 0"), ["/src1", "/src2"])


@query("cdc_force_rescan", "SELECT group_id, file_id FROM (SELECT group_id, file_id, count(*) OVER (PARTITION BY group_id) AS n FROM members WHERE file_id NOT IN (SELECT id FROM files WHERE starts_with(path, '/src4/'))) WHERE n >= 2")
def _(t):
    from mirrorsift.operators.graph import without_members

    return without_members(t.members, t.files.where(S.in_subtree(F.col("path"), "/src4")).select(F.col("id").alias("file_id"))).select("group_id", "file_id")


@query("cdc_twin_features", "SELECT id, 'ft' || min(id) OVER (PARTITION BY content_hash)::VARCHAR AS feature, id = min(id) OVER (PARTITION BY content_hash) AS computed FROM files")
def _(t):
    feats = t.files.select(F.col("id").alias("file_id"), F.concat(F.lit("ft"), F.col("id").cast("string")).alias("feature"))
    return C.copy_features_to_twins(feats, t.files)


@query("cdc_partial_propagation", "SELECT f.id FROM active f WHERE f.content_hash IN (SELECT content_hash FROM files JOIN fingerprints ON id = file_id WHERE has_partial)")
def _(t):
    h = t.files.join(t.fingerprints.where("has_partial").select(F.col("file_id").alias("id")), "id", "left_semi").select("content_hash")
    return t.active.join(h, "content_hash", "left_semi").select("id")


@query("cdc_purge_subtree", "SELECT id, CASE WHEN starts_with(path, '/src5/') THEN coalesce(deleted_at, 1700000999) ELSE deleted_at END AS deleted_at FROM files")
def _(t):
    return t.files.select("id", F.when(S.in_subtree(F.col("path"), "/src5"), F.coalesce("deleted_at", F.lit(1_700_000_999).cast("long"))).otherwise(F.col("deleted_at")).alias("deleted_at"))


@query("cdc_hidden_folders", "SELECT id FROM tasks WHERE NOT (state = 'PENDING' AND (path = '/f/1' OR starts_with(path, '/f/1/'))) OR path IS NULL")
def _(t):
    gone = t.tasks.where((F.col("state") == "PENDING") & S.in_subtree(F.col("path"), "/f/1")).select("id")
    return t.tasks.join(gone, "id", "left_anti").select("id")


@query("cdc_codec_migration", "SELECT id, CASE WHEN codec IS NULL OR codec IN ('h264', 'hevc', 'h265') THEN 'requeue' WHEN has_partial THEN 'clear' ELSE 'mark' END AS action FROM active JOIN fingerprints ON id = file_id")
def _(t):
    f = S.with_active_file(t.fingerprints, t.files, "codec")
    return f.select(F.col("file_id").alias("id"), F.when(S.fast_path(F.col("codec")), "requeue").when(F.col("has_partial"), "clear").otherwise("mark").alias("action"))


@query("cdc_removed_roots", "SELECT id FROM tasks WHERE path IS NULL OR NOT (path = '/f/7' OR starts_with(path, '/f/7/') OR path = '/f/9' OR starts_with(path, '/f/9/'))")
def _(t):
    gone = t.tasks.where(S.in_subtree(F.col("path"), "/f/7") | S.in_subtree(F.col("path"), "/f/9")).select("id")
    return t.tasks.join(gone, "id", "left_anti").select("id")


_W = "WINDOW w AS (PARTITION BY series ORDER BY ts_ms)"


@query("win_throughput", f"SELECT series, ts_ms, CASE WHEN ts_ms > t0 AND r0 > r THEN (r0 - r) / ((ts_ms - t0) / 1000.0::DOUBLE) ELSE 0.0 END::DOUBLE AS rate FROM (SELECT series, ts_ms, pending + running AS r, lag(pending + running) OVER w AS r0, lag(ts_ms) OVER w AS t0 FROM samples {_W}) WHERE t0 IS NOT NULL")
def _(t):
    return C.throughput(t.samples)


@query("win_drain_rate", """SELECT series, ts_ms, CASE WHEN ts_ms > t0 AND b0 > pending_bytes THEN (b0 - pending_bytes) / ((ts_ms - t0) / 1000.0::DOUBLE) ELSE 0.0 END::DOUBLE AS rate FROM (
 SELECT *, first_value(pending_bytes) OVER w AS b0, first_value(ts_ms) OVER w AS t0, row_number() OVER (PARTITION BY series ORDER BY ts_ms) AS k FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts_ms ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) WHERE k > 1""")
def _(t):
    return C.drain_rate(t.samples)


@query("win_eta", """SELECT series, CASE WHEN rb > 0 AND tb > ta AND ra > rb THEN floor(rb / ((ra - rb) / ((tb - ta) / 1000.0::DOUBLE)) + 0.5)::BIGINT END AS eta_seconds FROM (
 SELECT series, arg_min(pending + running, ts_ms) AS ra, arg_max(pending + running, ts_ms) AS rb, min(ts_ms) AS ta, max(ts_ms) AS tb FROM samples WHERE ts_ms < 1706000000000 GROUP BY series)""")
def _(t):
    return C.eta(t.samples.where("ts_ms < 1706000000000"))


@query("win_stalled", "SELECT series, ts_ms, min(pending_bytes) OVER w = max(pending_bytes) OVER w AND count(*) OVER w = 7 AND running > 0 AS stalled FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts_ms ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def _(t):
    return C.stalled(t.samples)


@query("win_last_activity", f"SELECT series, ts_ms, last_value(g IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts_ms) AS active_ms FROM (SELECT series, ts_ms, CASE WHEN coalesce(done > lag(done) OVER w, true) THEN ts_ms END AS g FROM samples {_W})")
def _(t):
    return C.last_activity(t.samples)


@query("win_smoothed_eta")
def _(t):
    return C.smoothed_eta(t.samples)


@query("win_lanes")
def _(t):
    e = t.edges.where("trust = 'POSSIBLE'")
    seg = e.select((F.col("file_a") % 20).alias("source"), F.col("file_b").alias("clip"), (F.col("source_start_ms") / 30000.0).alias("start"), (F.col("source_end_ms") / 30000.0).alias("end"), (F.col("matched_scenes") / F.col("clip_scenes")).alias("coverage"))
    return C.lanes(seg)
