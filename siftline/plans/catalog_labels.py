"""Catalog queries of labels: what providers highlight, and how two labelers agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text
from siftline.plans import evaluation, highlights
from siftline.plans.catalog import ARMS, DOC_UNITS, PLAIN, arms, query, table, tokens_sql
from siftline.plans.catalog_stages import as_text

WORDLESS, TINY = "these seven plain words stand in no text", "etc."

#: A document's highlight: its first unit, two from its third on, half of the middle one, and two that match nothing.
HIGHLIGHT = f"""array_join(array(coalesce(get(units, 0), ''), concat(coalesce(get(units, n div 3), ''), ' ', coalesce(get(units, n div 3 + 1), '')),
substring(coalesce(get(units, n div 2), ''), 1, length(coalesce(get(units, n div 2), '')) div 2), '{WORDLESS}', '{TINY}'), ' [...] ')"""
GRAMS = "CASE WHEN len({0}) >= 5 THEN list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i : i + 4], ' '))) WHEN len({0}) > 0 THEN [array_to_string({0}, ' ')] ELSE [] END"

ALIGNED = rf"""WITH RECURSIVE {DOC_UNITS}, dn AS (SELECT doc_id, units, len(units) AS n FROM du WHERE len(units) > 0),
hl AS (SELECT doc_id, units, n, CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string([units[1], units[n // 3 + 1] || ' ' || coalesce(units[n // 3 + 2], ''), substr(units[n // 2 + 1], 1, length(units[n // 2 + 1]) // 2), '{WORDLESS}', '{TINY}'], ' [...] ') END AS h FROM dn WHERE n <= 300),
fl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(h, '\[\s*\.\.\.\s*\]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 8) AS fs FROM hl),
fr AS (SELECT doc_id, k, {PLAIN.format("fs[k]")} AS p, {tokens_sql("fs[k]")} AS t FROM (SELECT doc_id, fs, unnest(range(1, len(fs) + 1)) AS k FROM fl)),
fg AS (SELECT doc_id, k, p, {GRAMS.format("t")} AS g FROM fr WHERE len(t) >= 6),
ut AS (SELECT doc_id, i - 1 AS unit_id, {PLAIN.format("units[i]")} AS p, {tokens_sql("units[i]")} AS t FROM (SELECT doc_id, units, unnest(range(1, n + 1)) AS i FROM hl)),
ug AS (SELECT doc_id, unit_id, p, {GRAMS.format("t")} AS s FROM ut),
hits AS (SELECT f.doc_id, f.k, len(f.g) AS size, unit_id, list_intersect(f.g, u.s) AS c, len(u.s) AS of FROM fg f JOIN ug u ON u.doc_id = f.doc_id WHERE len(list_intersect(f.g, u.s)) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY len(c) DESC, unit_id) AS r FROM hits),
go AS (SELECT doc_id, k, size, r, c AS got, [unit_id] AS ids FROM rk WHERE r = 1
UNION ALL SELECT x.doc_id, x.k, x.size, x.r, CASE WHEN len(got) >= 0.5 * x.size THEN got ELSE list_distinct(list_concat(got, x.c)) END,
CASE WHEN len(got) >= 0.5 * x.size OR len(list_intersect(got, x.c)) = len(x.c) THEN ids ELSE list_append(ids, x.unit_id) END FROM go JOIN rk x ON x.doc_id = go.doc_id AND x.k = go.k AND x.r = go.r + 1),
cov AS (SELECT doc_id, k, unnest(ids) AS unit_id FROM (SELECT doc_id, k, arg_max(ids, r) AS ids, arg_max(len(got), r) AS n, any_value(size) AS size FROM go GROUP BY ALL) WHERE n >= 0.5 * size),
alone AS (SELECT f.doc_id, f.k, min(u.unit_id) AS unit_id FROM fg f JOIN ug u ON u.doc_id = f.doc_id AND contains(u.p, substr(f.p, 1, 80)) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = f.doc_id AND h.k = f.k) GROUP BY ALL),
al AS (SELECT doc_id, k, unit_id FROM hits WHERE len(c) >= 0.5 * of UNION SELECT * FROM cov UNION SELECT * FROM alone),
ag AS (SELECT doc_id, list_sort(list_distinct(list(unit_id))) AS ids, count(DISTINCT k) AS n_matched FROM al GROUP BY doc_id)"""


@query(ALIGNED + r""" SELECT d.doc_id, coalesce(o.source, '') AS query_id, CASE WHEN d.n > 300 THEN 'skipped:long(' || d.n || ')' WHEN ids IS NULL THEN 'skipped:empty_align' ELSE 'ok' END AS status, CAST(CASE WHEN d.n > 300 THEN 0 ELSE d.n END AS INTEGER) AS n_units,
CAST(coalesce(len(fs), 0) AS INTEGER) AS n_fragments, CAST(coalesce(n_matched, 0) AS INTEGER) AS n_fragments_matched, coalesce(array_to_string(ids, ','), '') AS kept_ids
FROM dn d JOIN documents o ON o.doc_id = d.doc_id LEFT JOIN fl ON fl.doc_id = d.doc_id LEFT JOIN ag ON ag.doc_id = d.doc_id""")
def label_highlights(spark, sf):
    """Every document as a result of a query of its source's name, labeled by a highlight made of its units; each eleventh highlight scores too little."""
    docs = table(spark, sf, "documents").withColumns({"query_id": F.coalesce("source", F.lit("")), "units": text.sentences(F.col("text"))}).withColumn("n", F.size("units"))
    results = docs.select("query_id", F.col("doc_id").cast("string").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("published_date"), "text",
        F.array(F.expr(HIGHLIGHT)).alias("highlights"), F.array(F.when(F.col("doc_id") % 11 == 0, 0.1).otherwise(0.9)).alias("highlight_scores"), F.lit(1.0).alias("score"))
    queries = docs.select("query_id").distinct().select("query_id", F.concat(F.lit("about "), "query_id").alias("query"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("intent"))
    rows = highlights.label_highlights(queries, results, least=0.2, cut=text.sentences)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "query_id", "status", "n_units", "n_fragments", "n_fragments_matched", as_text(F.col("relevant_unit_ids")).alias("kept_ids"))


def both_labeled(spark, sf):
    """Two labelers' rows over documents: b's is gold, a's the prediction, each with failures, missing rows and its own model."""
    rows = arms(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("query_id"), F.col("doc_id").alias("ord"), "a", "b", F.expr("10 + doc_id % 1000").alias("tokens_in"), F.lit(7).alias("tokens_out"))
    side = lambda c, fails, gone, model: rows.filter(f"doc_id % {gone} != 0").withColumns({"relevant_unit_ids": F.when(F.col("doc_id") % 13 != c, F.col("ab"[c])), "status": F.expr(f"CASE WHEN doc_id % {fails} = 0 THEN 'error:x' ELSE 'ok' END"), "labeler_model": F.lit(model)})
    return side(1, 7, 10, "large"), side(0, 6, 9, "small")


RATES = ("precision", "recall", "f1", "jaccard")


@query(f"""WITH {ARMS}, e AS (SELECT doc_id, 10 + doc_id % 1000 AS t, CASE WHEN doc_id % 13 = 0 THEN [] ELSE a END AS p, CASE WHEN doc_id % 13 = 1 THEN [] ELSE b END AS g, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AS in_g, doc_id % 9 <> 0 AND doc_id % 6 <> 0 AS in_p FROM am),
i AS (SELECT *, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS x FROM e WHERE in_g AND in_p),
r AS (SELECT *, CASE WHEN np = 0 THEN 1.0::DOUBLE ELSE x / np::DOUBLE END AS precision, CASE WHEN ng = 0 THEN 1.0::DOUBLE ELSE x / ng::DOUBLE END AS recall, CASE WHEN np + ng = 0 THEN 1.0::DOUBLE ELSE x / (np + ng - x)::DOUBLE END AS jaccard FROM i),
s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r),
m AS (SELECT count(*) AS n_shared, count(*) FILTER (x = np AND x = ng) AS exact, count(*) FILTER (np + ng = 0) AS both_empty, count(*) FILTER (np = 0 AND ng > 0) AS missed, count(*) FILTER (ng = 0 AND np > 0) AS extra,
{", ".join(f"round(avg({c}), 9) AS mean_{c}, round(quantile_cont({c}, 0.5), 9) AS median_{c}" for c in RATES)},
{", ".join(f"round(avg({c}), 9) AS mean_size_{s}, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median_size_{s}, CAST(max({c}) AS INTEGER) AS max_size_{s}" for c, s in (("ng", "gold"), ("np", "pred")))},
{" || ',' || ".join(f"count(*) FILTER (f1 >= {a} AND f1 < {b})" for a, b in ((0, 0.001), (0.001, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 0.999), (0.999, 2)))} AS f1_buckets FROM s),
c AS (SELECT {", ".join(f"count(*) FILTER ({f}) AS n_rows_{s}, CAST(coalesce(sum(t) FILTER ({f}), 0) AS BIGINT) AS tokens_in_{s}, CAST(7 * count(*) FILTER ({f}) AS BIGINT) AS tokens_out_{s}" for f, s in (("in_g", "gold"), ("in_p", "pred")))} FROM e),
u AS (SELECT *, round((tokens_in_gold * 3.0::DOUBLE + tokens_out_gold * 15.0::DOUBLE) / 1e6, 9) AS usd_gold, round((tokens_in_pred * 1.0::DOUBLE + tokens_out_pred * 5.0::DOUBLE) / 1e6, 9) AS usd_pred FROM c)
SELECT m.*, u.*, CASE WHEN usd_pred > 0 THEN round(usd_gold / usd_pred, 9) END AS usd_ratio FROM m, u""")
def agreement_report(spark, sf):
    """Two labelers over all documents, in one row."""
    prices = spark.createDataFrame([("large", 3.0, 15.0), ("small", 1.0, 5.0)], "model string, price_in double, price_out double")
    return evaluation.agreement_report(*both_labeled(spark, sf), prices).withColumn("f1_buckets", as_text(F.col("f1_buckets")))
