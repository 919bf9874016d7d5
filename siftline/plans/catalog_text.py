"""Catalog queries of text structure: Markdown blocks, learned sentence ends, alignment, batches, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.segment import segment
from siftline.operators import sentences
from siftline.plans.catalog import query, table
from siftline.sources.shared import shared_folder
from siftline.streaming import requests

#: Twelve words of a document, over and over, as the parts that Markdown is made of here; a part is told by its number modulo 8.
PARTS = (
    "{g}.", "- {g}\n  - inner\n\n    {g}\n- next", "> {g}\nlazy.\n> - last", "| a | {g} |\n|:--|--:|\n| b | [x](y) |\nrow", "<div>\n- {g}\n</div>", "1. {g}\n   ```\n   - code\n\n   ```\n2. last", "{g}\n---", "    {g}\n\n      deeper",
)
#: The units of each part, by the rules of Markdown: what a parser must find.
PART_UNITS = (
    ("{g}.",), ("- {g}\n  - inner\n\n    {g}", "- next"), ("{g} lazy.", "- last"), ("| a | {g} |\n|:--|--:|\n| b | [x](y) |\nrow",), ("<div> - {g} </div>",), ("1. {g}\n   ```\n   - code\n\n   ```", "2. last"), ("{g}\n---",), ("{g}\n\n      deeper",),
)


def sql_text(template: str) -> str:
    """A template as an SQL string expression over g."""
    return " || ".join("g" if x == "{g}" else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in template.replace("{g}", "\0{g}\0").split("\0") if x)


UNITS_SQL = " ".join(f"WHEN {k} THEN [{', '.join(map(sql_text, us))}]" for k, us in enumerate(PART_UNITS))


MARKDOWN_UNITS = rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?:[A-Za-z0-9]+ ?){{1,12}}'), lambda x: replace(trim(x), ' ', ', ')) AS gs FROM c),
u AS (SELECT doc_id, flatten(list_transform(gs, lambda g, i: CASE (i - 1) % 8 {UNITS_SQL} END)) AS units FROM p)"""


def markdown(spark, sf) -> DataFrame:
    """documents written as Markdown of all kinds of blocks: doc_id, body."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    groups = F.transform(F.regexp_extract_all(plain, F.lit("(?:[A-Za-z0-9]+ ?){1,12}"), F.lit(0)), lambda g: F.replace(F.trim(g), F.lit(" "), F.lit(", ")))

    def part(g, i):
        out = None
        for k, template in enumerate(PARTS):
            text = F.concat(*(g if x == "{g}" else F.lit(x) for x in template.replace("{g}", "\0{g}\0").split("\0") if x))
            out = F.when(i % 8 == k, text) if out is None else out.when(i % 8 == k, text)
        return out

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(groups, part), "\n\n").alias("body"))


@query(MARKDOWN_UNITS + " SELECT doc_id, CAST(len(units) AS INTEGER) AS n_units, sha1(array_to_string(units, chr(0))) AS digest FROM u")
def segment_blocks(spark, sf):
    """Markdown cut into units: the SQL has the units by the parts' own rules."""
    rows = markdown(spark, sf).select("doc_id", segment(F.col("body")).alias("units"))
    return rows.select("doc_id", F.size("units").alias("n_units"), F.sha1(F.array_join("units", "\0")).alias("digest"))


CORE_SQL = r"regexp_replace(regexp_replace(regexp_replace(w, '^[\"''(\[{«“”‘’„¿¡]+', ''), '[\"'')\]}»”’“,;:]+$', ''), '^\d+(\.?)$', '#\1')".replace('\\"', '"').replace("«“", "«»“")


def ratio_sql(n: str, total: str, p0: str, p1: str) -> str:
    return f"-2 * ({n} * (ln({p0}) - ln({p1})) + ({total} - {n}) * (ln(1 - {p0}) - ln(1 - {p1})))"


@query(rf"""WITH w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents), c AS (SELECT lang, {CORE_SQL} AS c FROM w),
n AS (SELECT lang, lower(regexp_replace(c, '\.$', '')) AS word, count(*) AS n, count(*) FILTER (c LIKE '%.') AS dotted FROM c WHERE c <> '' GROUP BY ALL),
t AS (SELECT lang, greatest(least(sum(dotted) / sum(n), 0.98), 1e-9) AS p FROM n GROUP BY 1),
r AS (SELECT n.lang, word, n.n, dotted, p, length(regexp_replace(word, '[^.]', '', 'g')) AS inner_dots, greatest(least(dotted / n.n, 1 - 1e-9), 1e-9) AS share FROM n JOIN t ON t.lang IS NOT DISTINCT FROM n.lang WHERE dotted > 0 AND regexp_matches(word, '^(#|[\p{{L}}.]*\p{{L}}[\p{{L}}.]*)$')),
s AS (SELECT *, length(word) - inner_dots AS letters FROM r),
k AS (SELECT lang, word, n, dotted, CASE WHEN word = '#' THEN CASE WHEN dotted / n > p THEN ({ratio_sql('dotted', 'n', 'p', 'share')}) / 100 ELSE 0 END
  ELSE ({ratio_sql('dotted', 'n', 'p', '0.99')}) * exp(-letters) * (inner_dots + 1) * CAST(letters AS DOUBLE) ** (dotted - n) END AS score FROM s)
SELECT lang, word, n, CAST(dotted AS BIGINT) AS dotted, round(score, 5) AS score FROM k WHERE score >= 0.3""")
def learned_abbreviations(spark, sf):
    rows = sentences.abbreviations(table(spark, sf, "documents"), "lang", "text")
    return rows.withColumn("score", F.round("score", 5))


@query()
def learned_sentences(spark, sf):
    """Documents cut into sentences by the abbreviations and first words learned from them all."""
    rows = sentences.learned_sentences(table(spark, sf, "documents").select("doc_id", "lang", "text"), "lang", "text")
    return rows.select("doc_id", F.size("sentences").alias("n_sentences"), F.sha1(F.array_join("sentences", "\0")).alias("digest"))


@query("SELECT user_id % 8 AS lane, event_id, true AS fits FROM events")
def micro_batches(spark, sf):
    """events in micro-batches of at most six rows or 50 ms: every event once, and how batches fit."""
    rows = requests.batched_events(spark, sf, shared_folder(spark, "streams"))
    sizes = rows.groupBy("lane", "batch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"), F.countDistinct("ended").alias("ends"))
    fits = (F.col("n") <= 6) & (F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1) & (F.col("ends") == 1)
    return rows.join(sizes.select("lane", "batch", fits.alias("fits")), ["lane", "batch"]).select("lane", "event_id", "fits")


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS all_n, (SELECT count(*) FROM events WHERE user_id % 2 = 1) AS odd_n FROM events GROUP BY 1")
def drained_events(spark, sf):
    return requests.counted_events(spark, sf, shared_folder(spark, "streams"))
