"""Queries of components and clusters."""

from pyspark.sql import functions as F

from mirrorsift.operators import graph as G
from mirrorsift.plans.catalog import query

_TOP = ",\n".join([
    "tm AS (SELECT m.group_id, m.file_id, CASE m.trust WHEN 'EXACT' THEN 3 ELSE 2 END AS rank FROM members m JOIN groups g USING (group_id) WHERE m.trust <> 'POSSIBLE' AND NOT non_transitive)",
    "te AS (SELECT DISTINCT x.file_id AS a, y.file_id AS b FROM tm x JOIN tm y USING (group_id))",
    "reach(n, r) AS (SELECT DISTINCT file_id, file_id FROM tm UNION SELECT te.b, r FROM reach JOIN te ON te.a = n)",
    "cc AS (SELECT n AS file_id, min(r) AS root FROM reach GROUP BY n)",
])
_CL = _TOP + """,
hd AS (SELECT root, min(group_id) AS cluster_id, max(rank) AS top FROM tm JOIN cc USING (file_id) GROUP BY root),
mg AS (SELECT cluster_id, file_id, max(rank) AS rank, any_value(top) AS top FROM tm JOIN cc USING (file_id) JOIN hd USING (root) GROUP BY cluster_id, file_id),
pp AS (SELECT group_id, count(DISTINCT root) AS roots, min(root) AS root, list_sort(list(DISTINCT m.file_id) FILTER (WHERE root IS NULL)) AS ends FROM members m LEFT JOIN cc USING (file_id) WHERE trust = 'POSSIBLE' GROUP BY group_id),
pk AS (SELECT group_id, CASE WHEN roots = 1 AND ends IS NULL THEN 'gone' WHEN roots = 1 THEN 'card' ELSE 'own' END AS kind, root, ends FROM pp),
ids AS (SELECT group_id, min(group_id) OVER (PARTITION BY ends, root) AS cluster_id FROM pk WHERE kind = 'card' UNION ALL SELECT group_id, group_id FROM pk WHERE kind = 'own' UNION ALL SELECT group_id, group_id FROM groups WHERE non_transitive),
ot AS (SELECT DISTINCT cluster_id, file_id, CASE trust WHEN 'EXACT' THEN 3 WHEN 'VERY_LIKELY' THEN 2 ELSE 1 END AS rank FROM members JOIN ids USING (group_id)),
al AS (SELECT cluster_id, file_id, rank, top FROM mg UNION ALL SELECT cluster_id, file_id, rank, rank FROM ot),
cl AS (SELECT cluster_id, file_id, CASE rank WHEN 3 THEN 'EXACT' WHEN 2 THEN 'VERY_LIKELY' ELSE 'POSSIBLE' END AS trust, CASE top WHEN 3 THEN 'EXACT' WHEN 2 THEN 'VERY_LIKELY' ELSE 'POSSIBLE' END AS representative, min(file_id) OVER (PARTITION BY cluster_id) AS first_member FROM al)"""
_BEST = _CL + """,
gi AS (SELECT DISTINCT cluster_id, group_id FROM tm JOIN cc USING (file_id) JOIN hd USING (root) UNION SELECT cluster_id, group_id FROM ids),
bs AS (SELECT cluster_id, arg_min(best_file_id, group_id) AS best FROM gi JOIN groups USING (group_id) JOIN (SELECT DISTINCT cluster_id, representative FROM cl) USING (cluster_id) WHERE trust = representative AND best_file_id IS NOT NULL GROUP BY cluster_id)"""


def _best(t):
    c, of_groups = G.clusters(t.groups, t.members), G.cluster_groups(t.groups, t.members)
    return c, G.cluster_best(c, of_groups, t.groups)


@query("gr_transitive_components", "SELECT file_id, root FROM cc", _TOP)
def _(t):
    return G.transitive_members(t.groups, t.members).select("file_id", "root").distinct()


@query("gr_clusters", "SELECT * FROM cl", _CL)
def _(t):
    return G.clusters(t.groups, t.members)


@query("gr_cluster_best", "SELECT cluster_id, best AS best_file_id FROM bs", _BEST)
def _(t):
    return _best(t)[1]


@query("gr_cluster_stats", """SELECT cluster_id, representative, count(*) AS members, sum(size_bytes)::BIGINT AS total_bytes,
 greatest(sum(size_bytes) - coalesce(max(size_bytes) FILTER (WHERE file_id = best), max(size_bytes)), 0)::BIGINT AS reclaimable_bytes FROM cl JOIN files ON id = file_id LEFT JOIN bs USING (cluster_id) GROUP BY cluster_id, representative""", _BEST)
def _(t):
    c, best = _best(t)
    return G.cluster_summary(c, best, t.files)


@query("gr_cluster_report", """SELECT count(*) AS clusters, count(*) FILTER (WHERE representative = 'EXACT') AS exact, count(*) FILTER (WHERE representative = 'VERY_LIKELY') AS very_likely, count(*) FILTER (WHERE representative = 'POSSIBLE') AS possible,
 coalesce(max(n), 0) AS largest, count(*) FILTER (WHERE levels > 1) AS cross_trust, coalesce(sum(n), 0)::BIGINT AS members_total, count(*) FILTER (WHERE k > 1) AS multi_group
 FROM (SELECT cluster_id, representative, count(*) AS n, count(DISTINCT trust) AS levels FROM cl GROUP BY ALL) LEFT JOIN (SELECT cluster_id, count(*) AS k FROM gi GROUP BY cluster_id) USING (cluster_id)""", _BEST)
def _(t):
    return G.cluster_report(G.clusters(t.groups, t.members), G.cluster_groups(t.groups, t.members))


@query("gr_cluster_page", "SELECT DISTINCT cluster_id, representative, first_member FROM cl WHERE representative <> 'POSSIBLE' ORDER BY first_member, cluster_id LIMIT 20 OFFSET 10", _CL)
def _(t):
    c = G.clusters(t.groups, t.members).where("representative <> 'POSSIBLE'").select("cluster_id", "representative", "first_member").distinct()
    return c.orderBy("first_member", "cluster_id").offset(10).limit(20)


@query("gr_cluster_prewarm", """SELECT cluster_id, file_id, place FROM (SELECT cluster_id, file_id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(file_id = best, false) DESC, coalesce(width_px::BIGINT * height_px, 0) DESC, size_bytes DESC, file_id) AS place
 FROM cl JOIN active ON id = file_id LEFT JOIN bs USING (cluster_id) WHERE content_hash IS NOT NULL) WHERE place <= 4""", _BEST)
def _(t):
    c, best = _best(t)
    return G.prewarm(c, best, t.active)


@query("gr_remove_members", """SELECT group_id, file_id FROM (SELECT group_id, file_id, count(*) OVER (PARTITION BY group_id) AS n FROM members WHERE file_id NOT IN (SELECT id FROM files WHERE id % 5 = 2)) WHERE n >= 2""")
def _(t):
    return G.without_members(t.members, t.files.where("id % 5 = 2").select(F.col("id").alias("file_id"))).select("group_id", "file_id")
