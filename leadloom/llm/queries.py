"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, collocations, conversations, mixing, near_dups, neighbours, quality, secrets, segmentation, substring_dedup, topk, urls, warc
from .common import table
from .new_sql import OP11, OP12, OP13


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), (85, 100))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = segmentation.sample_segmentations(table(spark, sf_dir, "documents"), packed=True)
    return got.select("doc_id", "sample", "n_pieces", "log_prob", "key", "inclusion", "round_trip", F.sha2("ids", 256).alias("ids_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archived_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_secret_scans, op3_near_dups, op4_quality, op5_exact_top_k, op6_mixing, op7_segmentation, op8_warc, op9_neighbours, op10_suffix_dedup, op11_conversations, op12_collocations, op13_embedding_dups)}


_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
             AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

_OP6 = r"""
WITH d AS (
  SELECT source IS NULL AS mn, coalesce(source, '') AS ms, doc_id, coalesce(doc_id, -9223372036854775808) AS did,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':20'), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT mn, ms, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY mn, ms) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w,
         source_size * 3::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, mn, ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (ORDER BY cap / w, mn, ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM s1),
s3 AS (SELECT *, (total - cap_before) * w >= cap * w_from AS is_full FROM s2),
s4 AS (SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS free_words,
         sum(CASE WHEN NOT is_full THEN w END) OVER () AS free_w FROM s3),
s AS (SELECT mn, ms, source_size, CASE WHEN is_full THEN cap ELSE least(cap, w * free_words / free_w) END AS target FROM s4),
c0 AS (SELECT mn, ms, length(bin(size)) // 2 AS k, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
c1 AS (SELECT *, (1::BIGINT << k::INTEGER)::BIGINT AS m FROM c0 JOIN s USING (mn, ms)),
c2 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY mn, ms ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
         (sum(m * words) OVER (PARTITION BY mn, ms ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS mw_from FROM c1),
c3 AS (SELECT *, (target - 3::DOUBLE * above) * m >= 3::DOUBLE * mw_from AS is_full FROM c2),
c4 AS (SELECT *, target - 3::DOUBLE * coalesce(sum(CASE WHEN is_full THEN words END) OVER (PARTITION BY mn, ms), 0)::DOUBLE AS over_words,
         (sum(CASE WHEN NOT is_full THEN m * words END) OVER (PARTITION BY mn, ms))::DOUBLE AS free_mw FROM c3),
c5 AS (SELECT *, CASE WHEN is_full THEN 3::DOUBLE ELSE least(3::DOUBLE, over_words * m / free_mw) END AS copies FROM c4),
c6 AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM c5),
c AS (SELECT mn, ms, k, whole, p, target - (sum(whole * words) OVER (PARTITION BY mn, ms))::DOUBLE AS rest FROM c6),
r AS (SELECT d.*, c.whole, c.p, c.rest, CASE WHEN p > 0 AND p < 1 THEN (u / (1::DOUBLE - u)) / (p / (1::DOUBLE - p)) END AS q
      FROM d LEFT JOIN c ON d.mn = c.mn AND d.ms = c.ms AND d.size > 0 AND length(bin(d.size)) // 2 = c.k),
v AS (SELECT *, q / (1::DOUBLE + q) AS v FROM r),
g AS (SELECT mn, ms, v, did, sum(size)::DOUBLE AS n, any_value(rest) AS rest FROM v WHERE v IS NOT NULL GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY mn, ms ORDER BY v, did ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up_to FROM g),
f AS (SELECT mn, ms, v AS fv, did AS fd, row_number() OVER (PARTITION BY mn, ms ORDER BY v, did) AS place FROM o WHERE up_to + n / 2::DOUBLE > rest)
SELECT doc_id, size, source_size, target,
       (size * coalesce(whole + CASE WHEN v IS NOT NULL AND (fv IS NULL OR v < fv OR (v = fv AND did < fd)) THEN 1 ELSE 0 END, 1))::BIGINT AS taken
FROM v JOIN s USING (mn, ms) LEFT JOIN (SELECT * FROM f WHERE place = 1) USING (mn, ms)
"""

_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS top FROM d GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4)))::BIGINT & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM d JOIN m USING (hex)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": _OP5, "op6_mixing": _OP6, "op8_warc": _OP8, "op11_conversations": OP11, "op12_collocations": OP12, "op13_embedding_dups": OP13}
