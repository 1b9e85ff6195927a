"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, gru_lm, hnsw, html_text, id_files, jaccard, line_dedup, quality, ranked_search, sharding, warc
from .storage import table

SHARDS = 16
END_ID = 2


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    """The byte-level BPE file of the tokenizer package installed beside Spark."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.scan_documents(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("hit_spans")


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS).withColumn("law", F.lit("key"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, manifest = id_files.write_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return id_files.read_files(spark, root, manifest)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_warc": op2_warc,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_html_text": op5_html_text,
        "op6_hnsw": op6_hnsw,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_decontamination": op8_decontamination,
        "op9_gru_lm": op9_gru_lm,
        "op10_sharding": op10_sharding,
        "op11_id_files": op11_id_files,
        "op12_divergence": op12_divergence,
        "op13_ranked_search": op13_ranked_search,
    }


_OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP2_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT page_id, n, d, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

_OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dwin.n AS n, item_id FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.n = bwin.n),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits ON dw.doc_id = hits.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""

# CRC-32 by its table (polynomial 3988292384, reflected); 2862933555777941757 is the multiplier of jump consistent hashing; arithmetic is modulo 2^64.
_OP10_SQL = """
WITH RECURSIVE step AS (
  SELECT doc_id, CAST(doc_id AS HUGEINT) AS k, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 0 AS i FROM documents
  UNION ALL
  SELECT doc_id, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE)) AS BIGINT), i + 1
  FROM (SELECT doc_id, j, i, CAST((CAST(k AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS HUGEINT) AS k2 FROM step WHERE j < 17)),
placed AS (
  SELECT doc_id, max(CASE WHEN b < 16 THEN b END) AS shard, max(CASE WHEN b < 17 THEN b END) AS grown_shard FROM step GROUP BY doc_id),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)),
  lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda a, b: xor(a // 256, tab[CAST(xor(a, b) % 256 AS BIGINT) + 1]))) AS text_crc32 FROM documents, crc)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, CAST(p.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id) - 1 AS slot, CAST(p.grown_shard AS INTEGER) AS grown_shard
FROM sized s JOIN placed p ON s.doc_id = p.doc_id
"""

_OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
cnt AS (SELECT t.lang, source, t.term, count(*) AS c FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, source, t.term),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM grp g LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // CAST(n + v AS HUGEINT) AS p
  FROM n JOIN kept k ON k.lang = n.lang JOIN size ON size.lang = n.lang
  LEFT JOIN cnt ON cnt.lang = n.lang AND cnt.source = n.source AND cnt.term = k.term),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 1)) // CAST(max(n) + max(v) AS HUGEINT) AS q
  FROM cnt JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) JOIN size USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (
  SELECT p.lang, p.source, p.term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM words)
WHERE part = 'pair' OR rank <= 200
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w) AS t FROM d) GROUP BY id, t),
h AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY t, nn),
b AS (SELECT row_number() OVER () AS b, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT b, item_id, t, count(*) AS times FROM (
  SELECT b, item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM b) GROUP BY b, item_id, t),
m AS (SELECT id, doc_id, 75 + (25 * len(w) * nn) // ll AS m FROM d, s WHERE len(w) > 0),
r AS (
  SELECT b, item_id, doc_id, m.id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p ON p.t = q.t JOIN h ON h.t = q.t JOIN m ON m.id = p.id GROUP BY b, item_id, doc_id, m.id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict:
    return {"op1_line_dedup": _OP1_SQL, "op2_warc": _OP2_SQL, "op8_decontamination": _OP8_SQL, "op10_sharding": _OP10_SQL, "op12_divergence": _OP12_SQL, "op13_ranked_search": _OP13_SQL}
