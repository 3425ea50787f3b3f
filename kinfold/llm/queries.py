"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, debruijn, mcd_quality, mixing, parity_join, pii_crf, token_planes, trigram_secrets, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.read_shards(token_planes.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(_table(spark, sf_dir, "documents"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.self_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigram_secrets.report(trigram_secrets.scan(_table(spark, sf_dir, "documents")))


def op5_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sizes(_table(spark, sf_dir, "documents"))
    return mixing.draw(rows, F.col("row")).select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.report(winnow.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = mcd_quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


QUERIES = {
    q.__name__: q
    for q in (op1_bit_planes, op2_skip_chain_crf, op3_parity_join, op4_trigram_index, op5_debruijn, op6_systematic_mix, op7_byte_cnn, op8_winnowing, op9_mcd, op10_warc)
}

SQL: dict[str, str] = {}

SQL["op6_systematic_mix"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
    (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total FROM s
), r AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), l AS (
  SELECT arg_min(level, cap / weight) AS level FROM r WHERE level * weight <= cap
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l) * weight), cap) AS target FROM w
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    ('0x' || substr(sha1('17:' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, sha1('17:' || coalesce(d.doc_id::VARCHAR, ''))) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(n * each + start) - floor((n - 1) * each + start)))::BIGINT AS taken FROM x
"""

SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, url, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM k
"""

SQL["op8_winnowing"] = """
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents, letters),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark, letters),
ig AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM dw, (SELECT DISTINCT k FROM ig))),
hits AS (SELECT doc_id, dg.k, i, item FROM dg JOIN ig USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op3_parity_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), r AS (
  SELECT doc_id, doc_id AS top FROM n UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.top, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(top) AS top FROM r GROUP BY doc_id) c USING (doc_id)
"""

SQL["op5_debruijn"] = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM w)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
