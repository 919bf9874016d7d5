"""Catalog queries of the SQL surface and of documents read by their byte offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import sql
from siftline.plans.catalog import BUDGET, SQL, query, table
from siftline.plans.catalog_text import MARKDOWN_UNITS, markdown
from siftline.sources import offsets
from siftline.sources.shared import shared_folder

COMPRESS = """
WITH pairs AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS body
  FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
cut AS (SELECT conv_id, turn, array_distinct(sift_tokens(query)) AS words, sift_sentences(body) AS units FROM pairs),
scored AS (SELECT conv_id, turn, units, sift_scores(words, sift_tokens_each(units)) AS scores FROM cut),
chosen AS (SELECT conv_id, turn, units, sift_kept(scores, 0.2D) AS kept FROM scored)
SELECT conv_id, turn, array_join(transform(kept, i -> CAST(i AS STRING)), ',') AS kept_ids, sift_render(units, kept) AS snippet, round(sift_ratio(units, kept), 9) AS ratio
FROM chosen"""


@query(SQL["compress_flagship"])
def compress_sql(spark, sf):
    """The flagship as one SQL text over the registered functions."""
    return sql.register(spark).sql(COMPRESS, conversations=table(spark, sf, "conversations"))


@query(MARKDOWN_UNITS + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS unit_id, units[i] AS unit FROM (SELECT doc_id, units, unnest(range(1, len(units) + 1)) AS i FROM u)")
def segment_sql(spark, sf):
    """The units of Markdown texts as rows, by the table function."""
    return sql.register(spark).sql("SELECT m.doc_id, s.unit_id, s.unit FROM {markdown} m, LATERAL sift_segment(m.body) s", markdown=markdown(spark, sf))


TAKEN = """
WITH listed AS (SELECT doc_id, sift_sentences(text) AS units FROM {documents}),
cut AS (SELECT doc_id, posexplode(units) AS (unit_id, unit) FROM listed),
priced AS (SELECT doc_id, unit_id, CAST(length(unit) AS BIGINT) AS cost, CAST(conv(substring(sha1(concat_ws('-', doc_id, unit_id)), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D AS score FROM cut),
worth AS (SELECT * FROM priced WHERE score >= 0.1D)
SELECT doc_id, unit_id FROM sift_budget(TABLE (worth) PARTITION BY (doc_id) ORDER BY (score DESC, unit_id), 800L)"""


@query(BUDGET + " SELECT doc_id, unnest(x) AS unit_id FROM (SELECT doc_id, arg_max(ids, r) AS x FROM go GROUP BY doc_id)")
def budget_sql(spark, sf):
    """The units that a budget of 800 characters pays for, by score, as rows: a table function over partitions."""
    return sql.register(spark).sql(TAKEN, documents=table(spark, sf, "documents"))


@query(r"""WITH l AS (SELECT doc_id, 'D' || doc_id AS docid, 'u/' || coalesce(source, '') AS url, coalesce(lang, '') AS title, replace(replace(coalesce(text, ''), chr(9), ' '), chr(10), ' ') AS body FROM documents WHERE doc_id % 50 = 0)
SELECT docid, url, title, CAST(length(body) AS INTEGER) AS n_chars, sha1(body) AS digest, CAST(strlen(docid) + strlen(url) + strlen(title) + strlen(body) + 4 AS BIGINT) AS n_bytes FROM l""")
def fetch_by_offset(spark, sf):
    """documents as tab-separated lines: all indexed by byte offset, every fiftieth id read from its place."""
    docs = table(spark, sf, "documents")
    lines = docs.select(F.concat(F.lit("D"), "doc_id").alias("docid"), F.concat(F.lit("u/"), F.coalesce("source", F.lit(""))).alias("url"), F.col("lang").alias("title"), F.col("text").alias("body"))
    index = offsets.build_index(spark, offsets.written_tsv(lines), shared_folder(spark, "offsets"))
    found = offsets.fetch(index, docs.filter("doc_id % 50 = 0").select(F.concat(F.lit("D"), "doc_id").alias("docid")))
    return found.select("docid", "url", "title", F.length("body").alias("n_chars"), F.sha1("body").alias("digest"), "n_bytes")
