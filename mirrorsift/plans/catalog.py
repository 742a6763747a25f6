"""Registered queries: a name, a function of the entity tables, and SQL over the same entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorsift.sources.adapters import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}

# The entity tables of sources.adapters, as DuckDB sees them.
PRELUDE = """
files AS (
 SELECT d.doc_id AS id,
  '/' || d.source || '/' || d.lang || '/' || d.doc_id::VARCHAR || '.' || ext AS path, d.n_chars::BIGINT AS size_bytes,
  1700000000000000000 + d.doc_id * 1000003 AS mtime_ns, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id * 13 END AS inode, sha256(d.text) AS content_hash,
  CASE d.doc_id % 6 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'vp9' WHEN 4 THEN 'mpeg2video' END AS codec, ext AS container,
  (d.n_chars * 40)::BIGINT AS duration_ms, (CASE d.doc_id % 4 WHEN 0 THEN 24000 WHEN 1 THEN 25000 WHEN 2 THEN 30000 ELSE 60000 END)::INT AS fps_x1000,
  (d.doc_id % 97) * 10000 + 500000 AS bitrate_bps,
  (CASE d.doc_id % 4 WHEN 0 THEN 3840 WHEN 1 THEN 1920 WHEN 2 THEN 1280 END)::INT AS width_px, (CASE d.doc_id % 4 WHEN 0 THEN 2160 WHEN 1 THEN 1080 WHEN 2 THEN 720 END)::INT AS height_px,
  1700000000 + d.doc_id AS first_seen_at, 1700086400 + d.doc_id AS last_seen_at, CASE WHEN l.toxic = 1 THEN 1700500000 END::BIGINT AS deleted_at,
  (d.doc_id % 1000) / 8.0::DOUBLE AS laplacian_variance, (d.doc_id % 503) * 1.5::DOUBLE AS dct_energy, (d.doc_id % 29) / 64.0::DOUBLE AS bpp,
  CASE d.doc_id % 3 WHEN 0 THEN 'x264 preset=slow' WHEN 1 THEN 'NVENC fast' END AS encoder_tags
 FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' WHEN 2 THEN 'avi' WHEN 3 THEN 'webm' ELSE 'txt' END AS ext FROM documents) d
 LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l USING (doc_id)),
active AS (SELECT * FROM files WHERE deleted_at IS NULL),
fingerprints AS (
 SELECT id AS file_id, id % 3 <> 0 AS has_tier2, id % 4 = 0 AS has_partial, r AS skip_reason,
  CASE WHEN r IS NOT NULL THEN size_bytes + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END END AS skip_size, CASE WHEN r IS NOT NULL THEN mtime_ns END AS skip_mtime
 FROM (SELECT *, CASE id % 12 WHEN 0 THEN 'exact-full-dup' WHEN 1 THEN 'timeout' WHEN 2 THEN 'no-keyframes' END AS r FROM files WHERE id % 10 <> 9)),
phashes AS (
 SELECT vec_id AS file_id, CASE WHEN len(list_filter(e[2:], lambda x: abs(x) >= 1e-6)) = 0 THEN 0 ELSE
   (list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i > 1 AND e[i] > m THEN (1::BIGINT << (64 - i)::INT)::HUGEINT ELSE 0::HUGEINT END))
   - CASE WHEN e[1] > m THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT END AS phash
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (list_sort(embedding::DOUBLE[])[32] + list_sort(embedding::DOUBLE[])[33]) / 2 AS m FROM embeddings)),
scenes AS (
 SELECT file_id, (i - 1)::BIGINT AS scene_index, ((i - 1) * 2500)::BIGINT AS ts_ms,
  CASE WHEN trim(l[i], ' ') = '' THEN 0 ELSE ('0x' || substr(md5(l[i]), 1, 15))::BIGINT END AS phash
 FROM (SELECT doc_id AS file_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
members AS (
 SELECT min(doc_id) OVER (PARTITION BY sha256(text)) AS group_id, 'EXACT' AS trust, doc_id AS file_id FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1
 UNION ALL SELECT 1000000000 + min(doc_id) OVER (PARTITION BY lang, n_chars), 'VERY_LIKELY', doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY lang, n_chars) > 1
 UNION ALL SELECT 2000000000 + doc_id, 'POSSIBLE', doc_id + k FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 10 = 0),
groups AS (
 SELECT group_id, trust, trust = 'VERY_LIKELY' AND group_id % 5 = 0 AS non_transitive,
  CASE group_id % 3 WHEN 0 THEN min(file_id) WHEN 1 THEN max(file_id) END AS best_file_id FROM members GROUP BY group_id, trust),
edges AS (
 SELECT group_id, trust, file_a, file_id AS file_b, 1000 - file_id % 100 AS score_x1000,
  CASE WHEN trust = 'POSSIBLE' THEN file_id % 7 * 1000 END AS clip_start_ms, CASE WHEN trust = 'POSSIBLE' THEN file_id % 7 * 1000 + 9000 END AS clip_end_ms,
  CASE WHEN trust = 'POSSIBLE' THEN file_id % 11 * 2000 END AS source_start_ms, CASE WHEN trust = 'POSSIBLE' THEN file_id % 11 * 2000 + 9000 END AS source_end_ms,
  CASE WHEN trust = 'POSSIBLE' THEN file_id % 5 + 1 END AS matched_scenes, CASE WHEN trust = 'POSSIBLE' THEN file_id % 5 + 3 END AS clip_scenes, file_id % 4 = 0 AS intro_outro
 FROM (SELECT *, min(file_id) OVER (PARTITION BY group_id) AS file_a FROM members) WHERE file_id <> file_a),
tasks AS (
 SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'densify' ELSE 'partial' END AS kind,
  CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'DONE' END AS state,
  (CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 0 WHEN substr(o_orderpriority, 1, 1) = '3' THEN -100 ELSE -200 END)::BIGINT AS priority,
  CASE WHEN o_orderkey % 17 <> 0 THEN '/f/' || o_custkey::VARCHAR END AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Remove' WHEN o_orderkey % 5 = 1 THEN 'ForceUpsert' ELSE 'Upsert' END AS change, o_orderkey % 4 AS attempts,
  epoch(o_orderdate)::BIGINT AS enqueued_at, floor(o_totalprice)::BIGINT AS size_bytes,
  CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'database is locked' WHEN o_orderkey % 3 = 0 THEN 'No such file or directory' ELSE 'unsupported codec' END END AS last_error
 FROM orders),
samples AS (
 SELECT series, (day * 86400000)::BIGINT AS ts_ms, (total - upto)::BIGINT AS pending, (p % 3)::BIGINT AS running, upto::BIGINT AS done, (p % 2)::BIGINT AS failed, ((total - upto) * 1000)::BIGINT AS pending_bytes
 FROM (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY day) AS upto, sum(n) OVER (PARTITION BY series) AS total FROM (
  SELECT 's' || (user_id % 5)::VARCHAR AS series, floor(epoch(ts) / 86400)::BIGINT AS day, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p FROM events GROUP BY ALL))),
changes AS (
 SELECT event_id, ts, k AS kind, '/u/' || (user_id % 150)::VARCHAR || ext AS path, CASE WHEN k = 'rename_both' THEN '/u/' || ((user_id + 4) % 150)::VARCHAR || ext END AS new_path
 FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'remove' WHEN 3 THEN 'rename_to' WHEN 4 THEN 'rename_from' ELSE 'rename_both' END AS k,
  CASE user_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.txt' ELSE '' END AS ext FROM events)),
listing AS (
 SELECT url || '/' || page_id::VARCHAR || '.mp4' AS path, length(html)::BIGINT AS size_bytes, page_id * 1000 + CASE WHEN page_id % 13 = 0 THEN 7 ELSE 0 END AS mtime_ns,
  CASE WHEN page_id % 3 <> 0 THEN page_id + CASE WHEN page_id % 17 = 0 THEN 1 ELSE 0 END END AS inode FROM pages WHERE page_id % 9 <> 4),
previous AS (
 SELECT url || '/' || page_id::VARCHAR || '.mp4' AS path, (length(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS size_bytes, page_id * 1000 AS mtime_ns,
  CASE WHEN page_id % 4 <> 0 THEN page_id END AS inode FROM pages WHERE page_id % 8 <> 3)
"""


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of the entity tables; sql is the SELECT over the entities, ctes go before it."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = "WITH RECURSIVE " + PRELUDE.strip() + (",\n" + ctes.strip() if ctes else "") + "\n" + sql.strip()
        return f

    return register


def _load() -> None:
    from mirrorsift.plans import changes, detection, features, graph, queueing, selection, serving, storage, summaries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda s, d, f=f: f(Tables(s, d))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
