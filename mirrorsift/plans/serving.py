"""Queries of the serving surface and of safe deletion."""

from pyspark.sql import functions as F

from mirrorsift.operators import serving as V
from mirrorsift.plans.catalog import query


@query("api_list_groups", """SELECT p.group_id, p.trust, p.best_file_id, (SELECT count(*) FROM members m WHERE m.group_id = p.group_id) AS members,
 coalesce((SELECT count(*) > 0 AND count(*) = sum(intro_outro::INT) FROM edges e WHERE e.group_id = p.group_id), false) AS all_tagged FROM (SELECT * FROM groups WHERE trust = 'POSSIBLE' ORDER BY group_id LIMIT 40 OFFSET 10) p""")
def _(t):
    return V.list_groups(t.groups, t.members, t.edges, "POSSIBLE", 10, 40)


@query("api_group_detail", """SELECT m.group_id, m.file_id, path, size_bytes, CASE WHEN codec IN ('hevc', 'h265') THEN 'h265' WHEN codec IN ('mpeg2video', 'mpeg2') THEN 'mpeg2' ELSE codec END AS codec, width_px, height_px, coalesce(m.file_id = best_file_id, false) AS is_best
 FROM members m JOIN groups g USING (group_id) JOIN active ON id = m.file_id""")
def _(t):
    return V.file_details(t.members, t.groups, t.files)


@query("api_group_stats", "SELECT trust, count(*) AS groups, count(*) FILTER (WHERE non_transitive) AS non_transitive, count(best_file_id) AS with_best FROM groups GROUP BY trust")
def _(t):
    return t.groups.groupBy("trust").agg(F.count("*").alias("groups"), F.sum(F.col("non_transitive").cast("long")).alias("non_transitive"), F.count("best_file_id").alias("with_best"))


@query("api_partial_overlaps", """SELECT group_id, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN file_a ELSE file_b END AS clip, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN file_b ELSE file_a END AS source,
 clip_start_ms, clip_end_ms, source_start_ms, source_end_ms, matched_scenes, clip_scenes, clip_start_ms IS NULL AS search_again FROM edges LEFT JOIN nn a ON a.file_id = file_a LEFT JOIN nn b ON b.file_id = file_b""",
       "nn AS (SELECT file_id, count(*) AS n FROM scenes GROUP BY file_id)")
def _(t):
    return V.overlaps(t.edges, t.scenes.groupBy("file_id").agg(F.count("*").alias("n")))


@query("api_conflicts", "SELECT file_id, count(*) AS groups, sum(coalesce(file_id = best_file_id, false)::INT)::BIGINT AS best_in FROM members JOIN groups USING (group_id) GROUP BY file_id HAVING count(*) >= 2 AND sum(coalesce(file_id = best_file_id, false)::INT) BETWEEN 1 AND count(*) - 1")
def _(t):
    return V.conflicts(t.members, t.groups)


@query("api_file_details", "SELECT id, path, size_bytes, duration_ms, codec FROM files WHERE deleted_at IS NULL AND width_px IS NULL")
def _(t):
    return t.active.where("width_px is null").select("id", "path", "size_bytes", "duration_ms", "codec")


@query("del_plan_verdict", """SELECT g.group_id, CASE WHEN chosen = 0 THEN 'NONE_SELECTED' WHEN unknown > 0 THEN 'UNKNOWN_MEMBER' WHEN chosen >= members THEN 'DELETE_ALL' WHEN best > 0 AND g.group_id % 2 <> 0 THEN 'BEST_UNCONFIRMED' ELSE 'OK' END AS verdict
 FROM (SELECT coalesce(m.group_id, s.group_id) AS group_id, count(m.file_id) AS members, count(s.file_id) AS chosen, count(*) FILTER (WHERE m.file_id IS NULL) AS unknown, count(*) FILTER (WHERE s.file_id = g.best_file_id) AS best
  FROM (SELECT DISTINCT group_id, file_id FROM members) m FULL JOIN (SELECT DISTINCT group_id, CASE WHEN group_id % 13 = 0 THEN -file_id ELSE file_id END AS file_id FROM members WHERE group_id % 3 = 0 OR (group_id % 3 = 1 AND file_id % 2 = 0)) s ON m.group_id = s.group_id AND m.file_id = s.file_id
  JOIN groups g ON g.group_id = coalesce(m.group_id, s.group_id) GROUP BY 1) g""")
def _(t):
    s = t.members.where("group_id % 3 = 0 or (group_id % 3 = 1 and file_id % 2 = 0)").select("group_id", F.when(F.col("group_id") % 13 == 0, -F.col("file_id")).otherwise(F.col("file_id")).alias("file_id"))
    return V.deletion_verdict(t.members, t.groups, s, F.col("group_id") % 2 == 0)


_JR = """jl AS (SELECT o_custkey AS batch_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'PENDING' ELSE 'COMMITTED' END AS status FROM orders),
js AS (SELECT batch_id, arg_max(status, seq) AS status FROM jl GROUP BY batch_id),
bf AS (SELECT o_custkey AS batch_id, o_orderkey AS file_id, CASE WHEN o_orderkey % 4 = 0 THEN 'SURVIVOR' ELSE 'DELETED' END AS role FROM orders),
xf AS (SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey % 5 < 2)"""


def _journal(t):
    o, k = t.raw("orders"), F.col("o_orderkey")
    log = o.select(F.col("o_custkey").alias("batch_id"), k.alias("seq"), F.when(k % 3 == 0, "PENDING").otherwise("COMMITTED").alias("status"))
    files = o.select(F.col("o_custkey").alias("batch_id"), k.alias("file_id"), F.when(k % 4 == 0, "SURVIVOR").otherwise("DELETED").alias("role"))
    return V.journal_state(log), files, o.where("o_orderkey % 5 < 2").select(k.alias("file_id"))


@query("del_journal_state", "SELECT * FROM js", _JR)
def _(t):
    return _journal(t)[0]


@query("del_undo_last", "SELECT b.file_id, CASE WHEN role = 'SURVIVOR' THEN 're-add' WHEN x.file_id IS NOT NULL THEN 'restore' ELSE 'lost' END AS action FROM bf b LEFT JOIN xf x USING (file_id) WHERE batch_id = (SELECT max(batch_id) FROM js WHERE status = 'COMMITTED')", _JR)
def _(t):
    return V.undo_last(*_journal(t))


@query("del_reconcile_pending", "SELECT batch_id, CASE WHEN count(*) FILTER (WHERE x.file_id IS NULL) > 0 THEN 'commit' ELSE 'drop' END AS action, count(*) FILTER (WHERE x.file_id IS NULL) AS gone FROM bf b JOIN js USING (batch_id) LEFT JOIN xf x USING (file_id) WHERE status = 'PENDING' AND role = 'DELETED' GROUP BY batch_id", _JR)
def _(t):
    return V.reconcile_pending(*_journal(t))


@query("del_default_selection", """SELECT group_id, CASE WHEN safe THEN others ELSE 0 END AS selected, CASE WHEN safe THEN bytes ELSE 0 END AS reclaimed_bytes, safe FROM (
 SELECT m.group_id, sum((NOT b)::INT)::BIGINT AS others, bool_or(b) AS safe, sum(CASE WHEN b THEN 0 ELSE size_bytes END)::BIGINT AS bytes FROM (SELECT m.group_id, size_bytes, coalesce(m.file_id = best_file_id, false) AS b FROM members m JOIN groups g USING (group_id) JOIN active ON id = m.file_id) m GROUP BY m.group_id)""")
def _(t):
    return V.default_selection(t.members, t.groups, t.files)


@query("del_kept_elsewhere", "SELECT m.file_id, count(*) AS kept_in FROM members m JOIN groups g USING (group_id) WHERE m.file_id = g.best_file_id AND m.file_id IN (SELECT m2.file_id FROM members m2 JOIN groups g2 USING (group_id) WHERE coalesce(m2.file_id <> g2.best_file_id, true)) GROUP BY m.file_id")
def _(t):
    c = V.conflicts(t.members, t.groups)
    return c.select("file_id", F.col("best_in").alias("kept_in"))


@query("tl_overlap_fractions", """SELECT group_id, file_b, CASE WHEN d > 0 THEN greatest(0.0, least(1.0, source_start_ms / d)) ELSE 0.0 END::DOUBLE AS start, CASE WHEN d > 0 THEN greatest(greatest(0.0, least(1.0, source_start_ms / d)), greatest(0.0, least(1.0, source_end_ms / d))) ELSE 0.0 END::DOUBLE AS "end",
 CASE WHEN clip_scenes <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, matched_scenes / clip_scenes)) END::DOUBLE AS coverage
 FROM (SELECT e.*, a.duration_ms AS d FROM edges e JOIN files a ON a.id = file_a WHERE trust = 'POSSIBLE')""")
def _(t):
    e = t.edges.where("trust = 'POSSIBLE'").join(t.files.select(F.col("id").alias("file_a"), F.col("duration_ms").alias("d")), "file_a")
    a, b = V.overlap_fractions(F.col("source_start_ms"), F.col("source_end_ms"), F.col("d"))
    cov = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("matched_scenes"), F.col("clip_scenes")), F.lit(0.0))))
    return e.select("group_id", "file_b", a.alias("start"), b.alias("end"), cov.alias("coverage"))


@query("tl_mode", """SELECT group_id, file_b, CASE WHEN trust <> 'POSSIBLE' THEN 'hidden' WHEN matched_scenes >= 3 THEN 'partial' WHEN coalesce(least(c, d) / nullif(greatest(c, d), 0), 0) >= 0.9 THEN 'full-span:whole-file-est' ELSE 'full-span:missing-overlap' END AS mode
 FROM (SELECT e.*, a.duration_ms AS d, b.duration_ms AS c FROM edges e JOIN files a ON a.id = file_a JOIN files b ON b.id = file_b)""")
def _(t):
    dur = lambda k, n: t.files.select(F.col("id").alias(f"file_{k}"), F.col("duration_ms").alias(n))
    e = t.edges.join(dur("a", "d"), "file_a").join(dur("b", "c"), "file_b")
    return e.select("group_id", "file_b", V.timeline_mode(F.col("trust"), F.col("matched_scenes") >= 3, F.least("c", "d"), F.greatest("c", "d")).alias("mode"))
