"""The registered queries of this subpackage and their SQL.

Each query reads the whole of its table below ``sf_dir`` and returns the
operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, divergence, embedding_dedup, fingerprints, infill, langid, ngram_join, packing, quality, suffix_dedup, token_counts, token_files, warc
from siftline.llm.vocab import public


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public("byte_bpe_multi_50k.tiktoken"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, public("piece_bpe_32k.model"))
    return counted.selectExpr("doc_id", "ifnull(octet_length(text), 0L) AS n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(documents, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


#: Rows of this remainder are held out from training.
HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents, public("byte_bpe_multi_50k.tiktoken"), learn=f"NOT {HELD_OUT.replace('doc_id', 'id')}")
    predicted = langid.predict(documents.select("doc_id", "text"), model)
    return predicted.selectExpr("doc_id", f"ifnull({HELD_OUT}, false) AS held_out", "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_source_audit": op13_source_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM w),
e AS (SELECT doc_id, unnest(grams) AS g FROM s),
n AS (SELECT doc_id, len(grams) AS n FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS top FROM n UNION SELECT l.y, r.top FROM r JOIN l ON l.x = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.top) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_warc": """
WITH s AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, 1 + (i // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest FROM s),
k AS (SELECT x, payload_bytes, max(page_id) AS keeper FROM d GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN d.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> keeper THEN keeper END AS refers_to
FROM d JOIN k ON k.x = d.x AND k.payload_bytes = d.payload_bytes""",
    # lines are cut at their ends and counted; a cut is a number of characters from the front
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS s FROM d),
u AS (SELECT *, CASE WHEN s[len(s)] = '' THEN len(s) - 1 ELSE len(s) END AS n FROM l),
c AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM u),
k AS (SELECT *, list_sum([0] || list_transform(s[1:least(c1, c2)], lambda x: length(x) + 1))::BIGINT AS x, list_sum([0] || list_transform(s[1:greatest(c1, c2)], lambda x: length(x) + 1))::BIGINT AS y,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, n, form, t, least(x, length(t)) AS x, least(y, length(t)) AS y FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || substr(t, 1, x) || '<S>' || substr(t, y + 1) || '<M>' || substr(t, x + 1, y - x)
    WHEN 'spm' THEN '<S>' || substr(t, y + 1) || '<P>' || substr(t, 1, x) || '<M>' || substr(t, x + 1, y - x) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS able FROM embeddings),
u AS (SELECT vec_id, label, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda e: e * e)))) AS x FROM v WHERE able),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS top FROM u UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), t AS (SELECT node, min(top) AS top FROM r GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(t.top, v.vec_id) AS component_id, coalesce(v.vec_id = coalesce(t.top, v.vec_id), true) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN t ON t.node = v.vec_id""",
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
s AS (SELECT lang, count(*) AS v FROM v GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON v.lang = w.lang AND v.term = w.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(t.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * s.v) AS p
  FROM g JOIN s ON s.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
q AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 5)) // (y.total + 5 * s.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) x
  JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) y ON y.lang = x.lang JOIN s ON s.lang = x.lang),
p AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
m AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
UNION ALL SELECT f.lang, f.source, 'term', f.term, (f.p - q.q)::BIGINT FROM f JOIN q ON q.lang = f.lang AND q.term = f.term WHERE f.n > 0 AND f.p > q.q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM m)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50""",
}
