"""Queries of features."""

from pyspark.sql import functions as F

from mirrorsift.functions.bits import hamming
from mirrorsift.operators import features as X
from mirrorsift.plans.catalog import query

_SEQ = "sq AS (SELECT file_id, list({'t': ts_ms, 'p': phash} ORDER BY ts_ms) AS s, count(*) AS n FROM scenes GROUP BY file_id)"
_BC = "bit_count(xor({a}, {b}))"


def _frames(t):
    """Pages as gray frames, 40 pixels wide."""
    p = t.raw("pages").where(F.octet_length("html") >= 120)
    return p.select((F.col("page_id") % 50).alias("file_id"), F.col("page_id").alias("ts_ms"), F.lit(40).alias("w"), F.floor(F.octet_length("html") / 40).cast("int").alias("h"), F.col("html").cast("binary").alias("pixels"))


@query("fea_phash", "SELECT file_id, phash FROM phashes")
def _(t):
    return t.phashes


@query("fea_hamming", "SELECT a.file_id AS a, b.file_id AS b, bit_count(xor(a.phash::BIGINT, b.phash::BIGINT))::INT AS distance FROM phashes a JOIN phashes b ON b.file_id = a.file_id + 1")
def _(t):
    b = t.phashes.select((F.col("file_id") - 1).alias("a"), F.col("file_id").alias("b"), F.col("phash").alias("q"))
    return t.phashes.select(F.col("file_id").alias("a"), F.col("phash").alias("p")).join(b, "a").select("a", "b", hamming(F.col("p"), F.col("q")).alias("distance"))


@query("fea_temporal_flow", "SELECT file_id, ts_ms, bit_count(xor(phash, prev))::INT AS flow FROM (SELECT *, lag(phash) OVER (PARTITION BY file_id ORDER BY ts_ms) AS prev FROM scenes) WHERE prev IS NOT NULL")
def _(t):
    f = X.temporal_flow(t.sequences)
    return f.select("file_id", F.posexplode("flow").alias("k", "flow")).select("file_id", ((F.col("k") + 1) * 2500).cast("long").alias("ts_ms"), "flow")


@query("fea_kept_scenes", """SELECT file_id, s[k].t AS ts_ms FROM (SELECT file_id, s, k FROM walk WHERE kept = k)""", _SEQ + """,
walk AS (SELECT file_id, s, n, 1::BIGINT AS k, 1::BIGINT AS kept FROM sq UNION ALL SELECT file_id, s, n, k + 1, CASE WHEN bit_count(xor(s[k + 1].p, s[kept].p)) > 4 THEN k + 1 ELSE kept END FROM walk WHERE k < n)""")
def _(t):
    return X.kept_scenes(t.sequences).select("file_id", F.explode("scenes").alias("s")).select("file_id", F.col("s.ts_ms").alias("ts_ms"))


@query("fea_sequence_similarity", """SELECT a, b, round(CASE WHEN least(na, nb) = 0 THEN 0 ELSE acc / least(na, nb) * (least(na, nb) / greatest(na, nb)) END, 9)::DOUBLE AS similarity FROM (
 SELECT x.file_id AS a, y.file_id AS b, x.n AS na, y.n AS nb, list_sum(list_transform(range(1, least(x.n, y.n) + 1), lambda i: (64 - bit_count(xor(x.s[i].p, y.s[i].p))) / 64.0::DOUBLE)) AS acc FROM sq x JOIN sq y ON y.file_id = x.file_id + 1)""", _SEQ)
def _(t):
    b = t.sequences.select((F.col("file_id") - 1).alias("a"), F.col("file_id").alias("b"), F.col("scenes").alias("sb"))
    j = t.sequences.select(F.col("file_id").alias("a"), F.col("scenes").alias("sa")).join(b, "a")
    return j.select("a", "b", F.round(X.sequence_similarity(F.col("sa"), F.col("sb")), 9).alias("similarity"))


@query("fea_sparse_plan", """SELECT file_id, ts_ms FROM (SELECT file_id, ts_ms, row_number() OVER (PARTITION BY file_id ORDER BY ts_ms) AS k FROM scenes WHERE scene_index % 2 = 0) WHERE k <= 5""")
def _(t):
    times = t.sequences.select("file_id", F.transform("scenes", lambda s: s["ts_ms"]).alias("times"))
    return X.sparse_plan(times, budget=5, step_ms=4_000).select("file_id", F.explode("steps").alias("ts_ms"))


@query("fea_fallback_grid", "SELECT id, unnest(range(0, n)) * st * 2500 AS ts_ms FROM (SELECT id, st, least(16, ceil(duration_ms / (st * 2500.0))::BIGINT) AS n FROM (SELECT *, CASE WHEN ceil(duration_ms / 2500.0) <= 16 THEN 1 ELSE ceil(ceil(duration_ms / 2500.0) / 16.0)::BIGINT END AS st FROM files WHERE duration_ms > 0))")
def _(t):
    return t.files.where("duration_ms > 0").select("id", F.explode(X.fallback_grid(F.col("duration_ms"), 16)).alias("ts_ms"))


@query("fea_decode_health", "SELECT id, CASE WHEN id % 40 > 0 THEN duration_ms // (id % 40) ELSE 0 END AS ms_per_frame, id % 40 > 0 AND duration_ms // greatest(id % 40, 1) > 1000 AS slow, id % 7 > 0 AND id % 40 > id % 7 * 4 AS over_decode FROM files")
def _(t):
    return t.files.select("id", *X.decode_health(F.col("id") % 40, F.col("id") % 7, F.col("duration_ms")))


@query("fea_fit_within", "SELECT id, CASE WHEN greatest(width_px, height_px) <= 320 THEN width_px ELSE greatest(floor(width_px * 320.0::DOUBLE / greatest(width_px, height_px) + 0.5), 1) END::BIGINT AS w, CASE WHEN greatest(width_px, height_px) <= 320 THEN height_px ELSE greatest(floor(height_px * 320.0::DOUBLE / greatest(width_px, height_px) + 0.5), 1) END::BIGINT AS h FROM files WHERE width_px IS NOT NULL")
def _(t):
    w, h = X.fit_within(F.col("width_px"), F.col("height_px"))
    return t.files.where("width_px is not null").select("id", w.alias("w"), h.alias("h"))


@query("fea_frame_features")
def _(t):
    return X.frame_features(_frames(t)).drop("grid")


@query("fea_trimmed_frames")
def _(t):
    return X.frame_features(_frames(t), trim=True).select("file_id", "ts_ms", "phash", "w2", "h2")


@query("fea_file_features")
def _(t):
    return X.file_features(X.frame_features(_frames(t)))
