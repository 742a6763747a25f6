"""Queries of duplicate detection and ranking."""

from pyspark.sql import functions as F

from mirrorsift.functions.bits import BITS, floor_bucket
from mirrorsift.operators import detection as D
from mirrorsift.operators import ranking as R
from mirrorsift.plans.catalog import query

#: The test vectors are far apart, and the test scenes' hashes are of lines of text: distances and bands for them.
#: CLIPS and WHOLE, with four bands that miss some near scenes, serve the queries whose SQL has these bands;
#: the production parameters (eight bands, which find all) serve those without SQL.
NEAR = D.BandParams(bands=8, distance=20)
CLIPS = D.AlignParams(bands=4, distance=6, coverage_x1000=1000, min_matched=3)
WHOLE = D.AlignParams(bands=4, distance=6)

_EXACT = "ex AS (SELECT content_hash, min(id) AS first_id, count(*) AS n, list_sort(list(id)) AS members FROM active WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1)"


def _shares(a: str, b: str, bands: int) -> str:
    w = BITS // bands
    return "(" + " OR ".join(f"((({a} >> {k * w}) & {(1 << w) - 1}) = (({b} >> {k * w}) & {(1 << w) - 1}))" for k in range(bands)) + ")"


def _unsigned(x: str) -> str:
    return f"({x}::HUGEINT & 18446744073709551615::HUGEINT)"


_NEAR = f"""hs AS (SELECT file_id, {_unsigned("phash")}::UBIGINT AS h FROM phashes WHERE phash <> 0),
near AS (SELECT x.file_id AS a, y.file_id AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM hs x JOIN hs y ON x.file_id < y.file_id WHERE {_shares("x.h", "y.h", 8)} AND bit_count(xor(x.h, y.h)) <= 20)"""


@query("dup_exact_groups", "SELECT content_hash, first_id, n, array_to_string(members, ',') AS members FROM ex", _EXACT)
def _(t):
    return D.exact_groups(t.active).select("content_hash", "first_id", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("dup_exact_reclaimable", """SELECT content_hash, count(*) AS n, sum(size_bytes)::BIGINT AS total_bytes, arg_max(id, [size_bytes, -id]) AS best_id, (sum(size_bytes) - max(size_bytes))::BIGINT AS reclaimable_bytes
 FROM active GROUP BY content_hash HAVING count(*) > 1""")
def _(t):
    return flagship(t)


def flagship(t):
    """Exact duplicates with their best copy and the bytes that deleting the others frees."""
    g = t.active.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("total_bytes"), F.max(F.struct("size_bytes", (-F.col("id")).alias("neg"))).alias("top"))
    return g.where("n > 1").select("content_hash", "n", "total_bytes", (-F.col("top.neg")).alias("best_id"), (F.col("total_bytes") - F.col("top.size_bytes")).alias("reclaimable_bytes"))


_OLD = """old AS (SELECT first_id + 5 AS group_id, unnest(members) AS file_id FROM ex WHERE first_id % 3 = 0
 UNION ALL SELECT first_id + 5, members[1] FROM ex WHERE first_id % 3 = 1 UNION ALL SELECT first_id + 5, 999999999 FROM ex WHERE first_id % 6 = 3),
met AS (SELECT e.first_id AS bucket_id, u.file_id, o.group_id AS target FROM (SELECT first_id, unnest(members) AS file_id FROM ex) e2(first_id, file_id) JOIN ex e USING (first_id) JOIN (SELECT first_id, unnest(members) AS file_id FROM ex) u ON u.first_id = e.first_id AND u.file_id = e2.file_id LEFT JOIN old o ON o.file_id = u.file_id),
per AS (SELECT bucket_id, count(DISTINCT target) AS targets, min(target) AS target_id, count(DISTINCT file_id) FILTER (WHERE target IS NULL) AS fresh, count(DISTINCT file_id) AS size, count(DISTINCT file_id) FILTER (WHERE target IS NOT NULL) AS mapped FROM met GROUP BY bucket_id),
res AS (SELECT p.*, CASE WHEN targets = 0 THEN 'create' WHEN targets > 1 OR held > mapped THEN 'ambiguous' WHEN fresh > 0 THEN 'extend' ELSE 'unchanged' END AS outcome FROM per p LEFT JOIN (SELECT group_id, count(DISTINCT file_id) AS held FROM old GROUP BY group_id) h ON h.group_id = target_id)"""


@query("dup_exact_reconcile", "SELECT bucket_id, outcome, CASE WHEN targets = 1 THEN target_id END AS target_id, CASE outcome WHEN 'create' THEN size WHEN 'extend' THEN fresh ELSE 0 END AS new_members FROM res", _EXACT + ",\n" + _OLD)
def _(t):
    m = D.exact_members(t.active)
    first = m.where("file_id = group_id")
    foreign = first.where("group_id % 6 = 3").select("group_id", F.lit(999_999_999).cast("long").alias("file_id"))
    old = m.where("group_id % 3 = 0").unionByName(first.where("group_id % 3 = 1")).unionByName(foreign).select((F.col("group_id") + 5).alias("group_id"), "file_id")
    return D.reconcile_exact(m, old)


@query("dup_near_edges", "SELECT * FROM near", _NEAR)
def _(t):
    return D.hamming_join(t.phashes, NEAR)


@query("dup_near_scores", "SELECT a, b, ((64 - least(distance, 64)) * 1000 // 64)::BIGINT AS score_x1000 FROM near", _NEAR)
def _(t):
    return D.near_scores(D.hamming_join(t.phashes, NEAR)).select("a", "b", "score_x1000")


@query("dup_near_point_query", f"SELECT file_id, bit_count(xor(h, q))::BIGINT AS distance FROM hs, (SELECT h AS q FROM hs WHERE file_id = 7) WHERE {_shares('h', 'q', 8)} AND bit_count(xor(h, q)) <= 24 ORDER BY distance, file_id", _NEAR)
def _(t):
    p = t.phashes.where("file_id = 7").select("phash").first()
    return D.hamming_query(t.phashes, p["phash"] if p else 0, D.BandParams(8, 24))


@query("dup_near_incremental", "SELECT * FROM near", _NEAR)
def _(t):
    changed = t.phashes.where("file_id % 10 = 3").select("file_id")
    stale = t.phashes.withColumn("phash", F.when(F.col("file_id") % 10 == 3, F.col("phash").bitwiseXOR(F.lit(0x0F0F))).otherwise(F.col("phash")))
    return D.near_incremental(t.phashes, D.hamming_join(stale, NEAR), changed, NEAR)


@query("join_hamming_multi_index", "SELECT x.file_id AS a, y.file_id AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM ls x JOIN ls y ON x.file_id < y.file_id WHERE bit_count(xor(x.h, y.h)) <= 6",
       f"ls AS (SELECT file_id, {_unsigned('min(phash)')}::UBIGINT AS h FROM (SELECT file_id, phash FROM scenes WHERE scene_index = 0 AND phash <> 0) GROUP BY file_id)")
def _(t):
    return D.mih_join(t.scenes.where("scene_index = 0 and phash <> 0").select("file_id", "phash"))


@query("join_hamming_multi_index_scenes", """SELECT x.file_id AS a, y.file_id AS b, min(d)::BIGINT AS distance, count(*) AS pairs FROM sh x JOIN nh ON nh.p = x.h JOIN sh y ON nh.q = y.h AND x.file_id < y.file_id GROUP BY ALL""",
       f"""sh AS (SELECT file_id, {_unsigned("phash")}::UBIGINT AS h FROM scenes WHERE phash <> 0), dh AS (SELECT DISTINCT h FROM sh),
nh AS (SELECT x.h AS p, y.h AS q, bit_count(xor(x.h, y.h)) AS d FROM dh x JOIN dh y ON bit_count(xor(x.h, y.h)) <= 6)""")
def _(t):
    return D.near_files(t.scenes)


_SC = f"""sc AS (SELECT file_id, scene_index, ts_ms, phash AS h FROM scenes WHERE phash <> 0),
bn AS (SELECT *, b.k AS band, (h >> (b.k * 16)) & 65535 AS v FROM sc, (VALUES (0), (1), (2), (3)) b(k)),
sp AS (SELECT DISTINCT x.file_id AS x, x.scene_index AS xi, x.ts_ms AS xt, y.file_id AS y, y.scene_index AS yi, y.ts_ms AS yt FROM bn x JOIN bn y ON x.band = y.band AND x.v = y.v AND x.file_id <> y.file_id),
vt AS (SELECT x AS clip, y AS source, bucket, count(*) AS votes FROM (SELECT x, y, unnest(range(o - 2, o + 3)) AS bucket FROM (SELECT x, y, floor((yt - xt) / 2500.0)::BIGINT AS o FROM sp)) GROUP BY ALL),
nn AS (SELECT file_id, count(*) AS n FROM scenes GROUP BY file_id)"""


@query("join_offset_votes", "SELECT * FROM vt WHERE votes >= 2", _SC)
def _(t):
    return D.offset_votes(t.scenes, CLIPS)


@query("dup_clip_candidates", "SELECT clip, source, bucket, votes FROM vt JOIN nn a ON a.file_id = clip JOIN nn b ON b.file_id = source WHERE votes >= 2 AND a.n >= 3 AND b.n > a.n", _SC)
def _(t):
    return D.clip_candidates(t.scenes, CLIPS)


@query("join_offset_votes_eight_bands")
def _(t):
    return D.offset_votes(t.scenes, D.PARTIAL_CLIPS)


@query("dup_clip_candidates_eight_bands")
def _(t):
    return D.clip_candidates(t.scenes, D.PARTIAL_CLIPS)


@query("ver_offset_buckets", "SELECT file_id, scene_index, unnest(range(o - 2, o + 3)) AS bucket FROM (SELECT file_id, scene_index, floor((ts_ms - 7777) / 2500.0)::BIGINT AS o FROM scenes)")
def _(t):
    own = floor_bucket(F.col("ts_ms") - 7777, 2500)
    return t.scenes.select("file_id", "scene_index", F.explode(F.sequence(own - 2, own + 2)).alias("bucket"))


@query("dup_partial_clips")
def _(t):
    return D.partial_clips(t.scenes, t.sequences, D.PARTIAL_CLIPS)


@query("dup_partial_counters")
def _(t):
    return D.partial_counters(t.scenes, t.sequences, D.PARTIAL_CLIPS)


@query("dup_partial_incremental")
def _(t):
    ids = t.raw("documents").where("doc_id % 7 = 3").select(F.col("doc_id").alias("file_id"))
    return D.partial_incremental(t.scenes, t.sequences, D.partial_clips(t.scenes, t.sequences, D.PARTIAL_CLIPS), ids, D.PARTIAL_CLIPS)


@query("dup_partial_postings", "SELECT DISTINCT file_id FROM (SELECT file_id, (phash >> (k * 16)) & 65535 AS v, k FROM scenes, (VALUES (0), (1), (2), (3)) b(k) WHERE phash <> 0) WHERE (k, v) IN (SELECT k, (phash >> (k * 16)) & 65535 FROM scenes, (VALUES (0), (1), (2), (3)) b(k) WHERE phash <> 0 AND file_id = 11)")
def _(t):
    p = D.mih_postings(t.scenes)
    probe = p.where("file_id = 11").select("chunk", "slice_value").distinct()
    return p.join(probe, ["chunk", "slice_value"], "left_semi").select("file_id").distinct()


@query("dup_stored_matches", "SELECT CASE WHEN a.n <= b.n THEN file_a ELSE file_b END AS clip, CASE WHEN a.n <= b.n THEN file_b ELSE file_a END AS source, 0::BIGINT AS source_offset, score_x1000 FROM edges JOIN nn a ON a.file_id = file_a JOIN nn b ON b.file_id = file_b WHERE trust = 'POSSIBLE'",
       "nn AS (SELECT file_id, count(*) AS n FROM scenes GROUP BY file_id)")
def _(t):
    return D.oriented_matches(t.edges.where("trust = 'POSSIBLE'"), t.scenes.groupBy("file_id").agg(F.count("*").alias("n")))


@query("dup_intro_outro", """SELECT group_id, file_a, file_b, coalesce(clip_scenes > 0 AND a.duration_ms > 0 AND b.duration_ms > 0
 AND (clip_end_ms - clip_start_ms) * 1000 // a.duration_ms <= 370 AND (source_end_ms - source_start_ms) * 1000 // b.duration_ms <= 370
 AND (clip_start_ms + (clip_end_ms - clip_start_ms) // 2 <= a.duration_ms // 3 OR clip_start_ms + (clip_end_ms - clip_start_ms) // 2 >= a.duration_ms - a.duration_ms // 3)
 AND (source_start_ms + (source_end_ms - source_start_ms) // 2 <= b.duration_ms // 3 OR source_start_ms + (source_end_ms - source_start_ms) // 2 >= b.duration_ms - b.duration_ms // 3), false) AS tag
 FROM edges JOIN files a ON a.id = file_a JOIN files b ON b.id = file_b WHERE trust = 'POSSIBLE'""")
def _(t):
    dur = lambda k: t.files.select(F.col("id").alias(f"file_{k}"), F.col("duration_ms").alias(f"d{k}"))
    e = t.edges.where("trust = 'POSSIBLE'").join(dur("a"), "file_a").join(dur("b"), "file_b")
    c = F.col
    return e.select("group_id", "file_a", "file_b", D.intro_outro(c("clip_start_ms"), c("clip_end_ms"), c("source_start_ms"), c("source_end_ms"), c("da"), c("db"), c("clip_scenes")).alias("tag"))


@query("dup_whole_candidates", """SELECT p.a, p.b, p.total, ab.o * 2500 AS offset_ab_ms, ab.top / p.total AS consistency_ab, ba.o * 2500 AS offset_ba_ms, ba.top / p.total AS consistency_ba FROM tt p JOIN ab USING (a, b) JOIN ba USING (a, b)""",
       _SC + """,
tt AS (SELECT x AS a, y AS b, count(*) AS total FROM sp WHERE x < y GROUP BY ALL HAVING count(*) >= 2),
v2 AS (SELECT clip, source, bucket, votes, max(votes) OVER (PARTITION BY clip, source) AS top FROM vt),
md AS (SELECT clip, source, list_sort(list(bucket))[count(*)::INT // 2 + 1] AS o, max(top) AS top FROM v2 WHERE votes = top GROUP BY clip, source),
ab AS (SELECT clip AS a, source AS b, o, top FROM md WHERE clip < source), ba AS (SELECT source AS a, clip AS b, o, top FROM md WHERE clip > source)""")
def _(t):
    return D.whole_candidates(t.scenes, WHOLE)


@query("dup_whole_candidates_eight_bands")
def _(t):
    return D.whole_candidates(t.scenes, D.AlignParams())


@query("dup_whole_matches")
def _(t):
    return D.whole_matches(t.scenes, t.sequences, D.AlignParams())


_EFF = "CASE codec WHEN 'av1' THEN 350 WHEN 'hevc' THEN 300 WHEN 'h265' THEN 300 WHEN 'vp9' THEN 260 WHEN 'h264' THEN 200 ELSE 100 END"
_AGAIN = "coalesce(" + " OR ".join(f"contains(lower(encoder_tags), '{m}')" for m in R.ENCODER_MARKS) + ", false)"


def _score_sql(mode: str) -> str:
    enc = {"max_quality": "1", "max_resolution": "1", "compatible": "CASE WHEN codec = 'h264' THEN 5 ELSE 0 END + CASE WHEN contains(lower(container), 'mp4') THEN 5 ELSE 0 END"}.get(mode, f"CASE WHEN {_AGAIN} THEN 0 ELSE 1 END")
    eff = _EFF if mode in ("space_saving", "max_quality") else "100"
    if mode == "min_size":
        return "0 AS pixels, 0 AS enc, 0 AS lap, 0 AS en, 0 AS bp, 0 AS rate, 18446744073709551615::HUGEINT - size_bytes AS sz"
    return f"coalesce(width_px::BIGINT * height_px, 0) AS pixels, {enc} AS enc, floor(laplacian_variance * 1000)::BIGINT AS lap, floor(dct_energy * 1000)::BIGINT AS en, floor(bpp * 1000000.0::DOUBLE)::BIGINT AS bp, bitrate_bps * ({eff}) AS rate, size_bytes::HUGEINT AS sz"


for _mode in R.MODES:

    @query(f"rank_best_{_mode}", "SELECT group_id, file_id AS best_id FROM s QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pixels DESC, enc DESC, lap DESC, en DESC, bp DESC, rate DESC, sz DESC, file_id) = 1",
           f"s AS (SELECT group_id, file_id, {_score_sql(_mode)} FROM members JOIN active ON id = file_id)")
    def _(t, mode=_mode):
        return R.best_copies(t.members, t.files, mode)


@query("rank_assign_best", "SELECT g.group_id, best_id, CASE WHEN best_id IS NULL THEN 'empty' WHEN best_id = best_file_id THEN 'unchanged' ELSE 'updated' END AS outcome FROM groups g LEFT JOIN (SELECT group_id, file_id AS best_id FROM s QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pixels DESC, enc DESC, lap DESC, en DESC, bp DESC, rate DESC, sz DESC, file_id) = 1) USING (group_id)",
       f"s AS (SELECT group_id, file_id, {_score_sql('archival')} FROM members JOIN active ON id = file_id)")
def _(t):
    return R.assign_best(t.groups, t.members, t.files, "archival")


@query("rank_codec_efficiency", f"SELECT id, {_EFF} AS efficiency FROM files")
def _(t):
    return t.files.select("id", R.codec_efficiency(F.col("codec"), "max_quality").alias("efficiency"))


@query("rank_scalar_score", "SELECT id, (pixels::HUGEINT * 10000000 + enc * 1000000 + lap * 100 + en * 10 + bp // 1000 + rate // 1000 + sz // 1000000)::VARCHAR AS score FROM s", f"s AS (SELECT id, {_score_sql('space_saving')} FROM files)")
def _(t):
    return t.files.select("id", *R.quality("space_saving")).select("id", R.scalar_score().cast("string").alias("score"))


@query("rank_client_order", f"SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(width_px::BIGINT * height_px, 0) DESC, bitrate_bps * ((CASE WHEN contains(codec, 'av1') THEN 350 WHEN codec IN ('hevc', 'h265') THEN 300 WHEN contains(codec, 'vp9') THEN 260 WHEN contains(codec, 'h264') THEN 200 ELSE 100 END)::DOUBLE / 100) DESC, size_bytes DESC, file_id) AS place FROM members JOIN files ON id = file_id")
def _(t):
    return R.members_by_quality(t.members, t.files, "space_saving")
