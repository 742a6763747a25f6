"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import embedding_links
from .licenses import scan_licenses
from .line_dedup import line_report
from .mixing import mix_report
from .ngram_join import ngram_jaccard_components
from .packing import pack_documents
from .pii import find_personal_data
from .quality_rules import quality_rules
from .sharding import shard_documents
from .toxicity import toxicity_scores


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=4096, end_id=1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), percent=80)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), repetition_limit=2.0, block_tokens=1_000_000)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), shingle=5, percent=80).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_packing": op2_packing,
        "op3_pii": op3_pii,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_dedup": op6_line_dedup,
        "op7_source_mixing": op7_source_mixing,
        "op8_license_scan": op8_license_scan,
        "op9_sharding": op9_sharding,
        "op10_ngram_join": op10_ngram_join,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP1 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT * FROM v WHERE n > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.n = e.vec_id"""

_OP6 = f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, regexp_extract_all(x[i], {_WORDS}) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS c FROM l WHERE len(w) >= 1),
f AS (SELECT c, any_value(w) AS w, min([doc_id, line_no]) AS spot FROM k GROUP BY c),
s AS (SELECT DISTINCT c, spot, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT c, spot, w, unnest(range(1, len(w) - 3)) AS i FROM f WHERE len(w) >= 5)),
n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
q AS (SELECT a.c AS a, b.c AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND b.spot < a.spot GROUP BY a.c, b.c),
g AS (SELECT DISTINCT a AS c FROM q JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
d AS (SELECT k.doc_id, k.line_no FROM k JOIN f USING (c) LEFT JOIN g USING (c) WHERE g.c IS NOT NULL OR f.spot <> [k.doc_id, k.line_no])
SELECT o.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed FROM documents o
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM d GROUP BY doc_id) r USING (doc_id)"""

_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS (SELECT a, b FROM q JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
c AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT o.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents o JOIN c ON c.d = o.doc_id LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force."""
    return {"op1_embedding_dedup": _OP1, "op6_line_dedup": _OP6, "op10_ngram_join": _OP10}
