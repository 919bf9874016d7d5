"""The query catalog: each operator over the driver's tables, with its SQL.

Roles: documents are corpus bodies, conversations give queries (user turns)
and documents (the next assistant turn), benchmark gives gold passages, labels
relevance, pages URLs and markup, events a stream.  Where an operator needs a
model's score a number that follows from the key's digest stands in; that
tests the operator, not a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import ids, text
from siftline.operators import align, assembly, labeling, metrics, scoring, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn after it: conv_id, turn, query, body."""
    turns = table(spark, sf, "conversations")
    after = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    return turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")).join(after, ["conv_id", "turn"])


PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS body FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
UNITS = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda u: trim(u)), lambda u: u <> '')"
DOC_UNITS = f"du AS (SELECT doc_id, {UNITS} AS units FROM documents)"
EXPLODED = DOC_UNITS + ", eu AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS unit_id, units[i] AS unit FROM (SELECT doc_id, units, unnest(range(1, len(units) + 1)) AS i FROM du))"


def fraction_sql(key: str) -> str:
    return f"(CAST('0x' || substr(sha1({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("units"))


def exploded(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("doc_id", F.posexplode("units").alias("unit_id", "unit"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text <> '') WHERE n = 1")
def corpus_merge_first_seen(spark, sf):
    rows = table(spark, sf, "documents")
    return assembly.first_of_text(rows.filter(assembly.truthy(rows, "text")), "text", ["doc_id"], ["doc_id", "source", "n_chars"])


@query("SELECT count(*) AS scanned, count(*) FILTER (text IS NULL OR text = '') AS no_field, count(DISTINCT CASE WHEN text <> '' THEN sha1(text) END) AS written, count(*) - count(*) FILTER (text IS NULL OR text = '') - count(DISTINCT CASE WHEN text <> '' THEN sha1(text) END) AS dup FROM documents")
def merge_counts(spark, sf):
    return assembly.merge_counts(table(spark, sf, "documents").select("text", F.sha1("text").alias("k")), "k", "text")


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def origin_counts(spark, sf):
    return assembly.count_by(table(spark, sf, "documents"), "source")


@query("SELECT 'd' || doc_id AS id, 0 AS file_idx, lang, NULL AS role FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, 1, NULL, role FROM conversations")
def label_aggregate_drop_body(spark, sf):
    a = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", "lang")
    b = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text", "role")
    return assembly.concatenate([a, b]).drop("text")


@query("SELECT page_id, url FROM pages WHERE NOT (" + " OR ".join(f"contains(lower(coalesce(url, '')), '{p}')" for p in ("reddit.com", "facebook.com", "twitter.com", "x.com/", "youtube.com", "tiktok.com", "instagram.com", "linkedin.com")) + ")")
def exclude_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").filter(~text.excluded(F.col("url")))


@query(r"SELECT page_id, sha1(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS stripped FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha1(text.strip_tags(F.col("html"))).alias("stripped"))


@query(rf"SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{text.CHROME_PATTERN}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS stripped FROM documents")
def chrome_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(text.strip_chrome(F.col("text"))).alias("stripped"))


@query(f"WITH {EXPLODED} SELECT doc_id, unit_id, unit FROM eu")
def sentence_units(spark, sf):
    return exploded(spark, sf)


@query(f"WITH {EXPLODED} SELECT doc_id, unit_id, CAST(coalesce(sum(length(unit) + 1) OVER w, 0) AS BIGINT) AS unit_start, CAST(coalesce(sum(length(unit) + 1) OVER w, 0) + length(unit) AS BIGINT) AS unit_end FROM eu WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def unit_spans(spark, sf):
    rows = units(spark, sf).select("doc_id", F.posexplode(windows.spans(F.col("units"))).alias("unit_id", "s"))
    return rows.select("doc_id", "unit_id", F.col("s.start").cast("long").alias("unit_start"), F.col("s.end").cast("long").alias("unit_end"))


PACKED = f"""WITH RECURSIVE {EXPLODED}, lens AS (SELECT doc_id, unit_id, length(unit) AS n FROM eu),
walk AS (SELECT doc_id, unit_id, n AS used, 0 AS w FROM lens WHERE unit_id = 0
UNION ALL SELECT l.doc_id, l.unit_id, CASE WHEN k.used + l.n > 2000 THEN l.n ELSE k.used + l.n END, CASE WHEN k.used + l.n > 2000 THEN k.w + 1 ELSE k.w END
FROM walk k JOIN lens l ON l.doc_id = k.doc_id AND l.unit_id = k.unit_id + 1)"""


@query(PACKED + " SELECT doc_id, CAST(w AS INTEGER) AS window_id, CAST(min(unit_id) AS INTEGER) AS window_start, CAST(max(unit_id) + 1 AS INTEGER) AS window_end FROM walk GROUP BY doc_id, w")
def pack_windows(spark, sf):
    packed = units(spark, sf).select("doc_id", F.posexplode(windows.pack_windows(F.transform("units", lambda u: F.length(u)), 2000)).alias("unit_id", "window_id"))
    return packed.groupBy("doc_id", "window_id").agg(F.min("unit_id").alias("window_start"), (F.max("unit_id") + 1).alias("window_end"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, CASE WHEN len(words) > 250 THEN list_transform(range(0, CAST(ceil(len(words) / 100.0) AS BIGINT)), lambda k: array_to_string(words[k * 100 + 1 : k * 100 + 100], ' ')) ELSE [text] END AS parts FROM w)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_parts, sha1(array_to_string(parts, chr(10))) AS digest FROM p""")
def split_oversized_words(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", windows.split_words(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n_parts"), F.sha1(F.array_join("parts", "\n")).alias("digest"))


BLOCK_LINES = r"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, i, x[i] AS line, len(regexp_extract_all(x[i], '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM b WHERE t <> ''))),
z AS (SELECT doc_id, sum(n) AS total FROM l GROUP BY 1),
w AS (SELECT doc_id, i, n AS used, 0 AS part FROM l WHERE i = 1
UNION ALL SELECT l.doc_id, l.i, CASE WHEN w.used + l.n > 400 THEN l.n ELSE w.used + l.n END, CASE WHEN w.used + l.n > 400 THEN w.part + 1 ELSE w.part END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1),
p AS (SELECT l.doc_id, CASE WHEN z.total > 500 THEN w.part ELSE 0 END AS part, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM l JOIN w ON w.doc_id = l.doc_id AND w.i = l.i JOIN z ON z.doc_id = l.doc_id GROUP BY 1, 2)
SELECT b.doc_id, CAST(count(p.part) AS INTEGER) AS n_parts, sha1(coalesce(string_agg(p.t, chr(0) ORDER BY p.part), '')) AS digest FROM b LEFT JOIN p ON p.doc_id = b.doc_id GROUP BY b.doc_id"""


@query(BLOCK_LINES)
def split_block_lines(spark, sf):
    """Each document as one block, cut at line ends where it is long."""
    from siftline.functions.segment import block_lines

    parts = table(spark, sf, "documents").select("doc_id", block_lines(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n_parts"), F.sha1(F.array_join("parts", "\0")).alias("digest"))


@query(f"WITH {DOC_UNITS} SELECT doc_id, CASE WHEN len(units) > 300 THEN 'skipped:long(' || len(units) || ')' ELSE 'ok' END AS status, CAST(CASE WHEN len(units) > 300 THEN 0 ELSE len(units) END AS INTEGER) AS n_units FROM du")
def long_doc_gate(spark, sf):
    n = F.size("units")
    long_ = n > 300
    return units(spark, sf).select("doc_id", F.when(long_, F.concat(F.lit("skipped:long("), n, F.lit(")"))).otherwise("ok").alias("status"), F.when(long_, 0).otherwise(n).alias("n_units"))


@query(f"WITH {DOC_UNITS}, {PAIRS} SELECT p.conv_id, p.turn, d.doc_id, CAST(len(d.units) AS INTEGER) AS n_units FROM pairs p JOIN du d ON d.doc_id = p.conv_id * 3 AND len(d.units) > 0")
def join_queries_units(spark, sf):
    docs = units(spark, sf).withColumn("ord", F.col("doc_id"))
    asked = pairs(spark, sf).select("conv_id", "turn", (F.col("conv_id") * 3).alias("source_doc_id"))
    return assembly.join_queries_units(asked, docs, "ord").select("conv_id", "turn", "doc_id", F.size("units").alias("n_units"))


@query("SELECT doc_id, source FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def resume_pending(spark, sf):
    return assembly.pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT d.doc_id, d.lang FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) x ON d.doc_id = x.doc_id")
def exclusion_anti(spark, sf):
    return assembly.pending(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").filter("toxic = 1"), ["doc_id"])


@query(f"""WITH r AS (SELECT lang AS query, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {fraction_sql("'r' || doc_id")}, doc_id) AS rank FROM documents)
SELECT query, doc_id, rank FROM (SELECT r.*, row_number() OVER (PARTITION BY query ORDER BY rank, doc_id) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE n = 1""")
def hard_negatives(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query"), "doc_id", text.fraction(F.concat(F.lit("r"), "doc_id")).alias("s"))
    ranked = metrics.ranked_in_groups(docs, "query", ["s", "doc_id"]).drop("s")
    good = table(spark, sf, "labels").filter("quality = 1").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query"), "doc_id")
    return assembly.hard_negatives(ranked, good)


WORD_SPANS = EXPLODED + r""", sp AS (SELECT doc_id, unit_id, unit, CAST(coalesce(sum(length(unit) + 1) OVER w, 0) AS BIGINT) AS a, CAST(coalesce(sum(length(unit) + 1) OVER w, 0) + length(unit) AS BIGINT) AS b FROM eu WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bd AS (SELECT doc_id, string_split(array_to_string(units, ' '), ' ') AS words FROM du),
tk AS (SELECT doc_id, i AS k, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM bd)),
ts AS (SELECT doc_id, k, CAST(coalesce(sum(length(word) + 1) OVER w, 0) AS BIGINT) AS s, CAST(coalesce(sum(length(word) + 1) OVER w, 0) + length(word) AS BIGINT) AS e FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def word_spans(spark, sf) -> DataFrame:
    """Words of the body with their character spans: doc_id, k, start, stop."""
    body = units(spark, sf).select("doc_id", F.split(windows.body(F.col("units")), " ").alias("words"))
    rows = body.select("doc_id", F.posexplode(windows.spans(F.col("words"))).alias("k", "s"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


@query(f"WITH {WORD_SPANS} SELECT t.doc_id, sp.unit_id, count(*) AS n_tokens FROM ts t JOIN sp ON sp.doc_id = t.doc_id AND (t.s + t.e) // 2 >= sp.a AND (t.s + t.e) // 2 < sp.b GROUP BY ALL")
def token_interval_join(spark, sf):
    return scoring.interval_join(word_spans(spark, sf), unit_spans(spark, sf), "doc_id").groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n_tokens"))


POOLED = f"""{EXPLODED}, tw AS (SELECT doc_id, unit_id, i, {fraction_sql("doc_id || '-' || unit_id || '-' || i")} AS p FROM (SELECT doc_id, unit_id, unnest(range(0, length(unit) % 7)) AS i FROM eu)),
po AS (SELECT e.doc_id, e.unit_id, round(coalesce(avg(p), 0), 9) AS mean, round(coalesce(avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 0), 9) AS score, count(p) AS n_tokens FROM eu e LEFT JOIN tw ON tw.doc_id = e.doc_id AND tw.unit_id = e.unit_id GROUP BY ALL)"""


def token_scores(spark, sf) -> DataFrame:
    """Up to six tokens of every unit with a probability: doc_id, unit_id, p."""
    rows = exploded(spark, sf)
    scored = rows.select("doc_id", "unit_id", F.explode(F.expr("CASE WHEN length(unit) % 7 = 0 THEN array() ELSE sequence(0, length(unit) % 7 - 1) END")).alias("i"))
    return scored.select("doc_id", "unit_id", text.fraction(F.concat_ws("-", "doc_id", "unit_id", "i")).alias("p"))


def pooled(spark, sf) -> DataFrame:
    out = scoring.pool(exploded(spark, sf).select("doc_id", "unit_id"), token_scores(spark, sf), ["doc_id", "unit_id"])
    return out.withColumns({"mean": F.round("mean", 9), "score": F.round("score", 9)})


@query(f"WITH {POOLED} SELECT doc_id, unit_id, mean, score, n_tokens, n_tokens > 0 AND score >= 0.5 AS kept FROM po")
def unit_pooling(spark, sf):
    return pooled(spark, sf)


@query(PACKED + ", sc AS (SELECT doc_id, w, list(used ORDER BY unit_id) AS s FROM walk GROUP BY doc_id, w) SELECT doc_id, sha1(array_to_string(flatten(list(s ORDER BY w)), ',')) AS merged FROM sc GROUP BY doc_id")
def window_merge(spark, sf):
    lens = units(spark, sf).withColumn("n", F.transform("units", lambda u: F.length(u)))
    walked = lens.select("doc_id", F.posexplode(F.arrays_zip(windows.pack_windows(F.col("n"), 2000).alias("w"), F.col("n"))).alias("unit_id", "x"))
    used = F.sum("x.n").over(Window.partitionBy("doc_id", "x.w").orderBy("unit_id"))
    by = walked.withColumn("used", used).groupBy("doc_id", F.col("x.w").alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "used"))), lambda x: x["used"].cast("string")).alias("s"))
    return windows.merge_windows(by, "doc_id", "w", "s").select("doc_id", F.sha1(F.array_join("s", ",")).alias("merged"))


BUDGET = f"""WITH RECURSIVE {EXPLODED}, sc AS (SELECT doc_id, unit_id, length(unit) AS c, {fraction_sql("doc_id || '-' || unit_id")} AS s FROM eu),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, unit_id) AS r FROM sc WHERE s >= 0.1),
go AS (SELECT doc_id, 0::BIGINT AS r, 0::BIGINT AS used, []::INTEGER[] AS ids FROM du
UNION ALL SELECT g.doc_id, k.r, CASE WHEN g.used + k.c <= 800 THEN g.used + k.c ELSE g.used END, CASE WHEN g.used + k.c <= 800 THEN list_append(g.ids, k.unit_id) ELSE g.ids END FROM go g JOIN rk k ON k.doc_id = g.doc_id AND k.r = g.r + 1)"""


def budgeted(spark, sf) -> DataFrame:
    rows = units(spark, sf)
    scores = F.transform("units", lambda u, i: text.fraction(F.concat_ws("-", F.col("doc_id"), i)))
    return rows.withColumn("kept", windows.select_under_budget(scores, F.transform("units", lambda u: F.length(u)), 800))


@query(BUDGET + " SELECT doc_id, array_to_string(list_sort(arg_max(ids, r)), ',') AS kept FROM go GROUP BY doc_id")
def budget_select(spark, sf):
    return budgeted(spark, sf).select("doc_id", F.array_join(F.transform("kept", lambda i: i.cast("string")), ",").alias("kept"))


@query(BUDGET + """, k AS (SELECT doc_id, list_sort(arg_max(ids, r)) AS kept FROM go GROUP BY doc_id), z AS (SELECT k.doc_id, kept, units FROM k JOIN du ON du.doc_id = k.doc_id)
SELECT doc_id, sha1(array_to_string(list_transform(range(1, len(kept) + 1), lambda i: CASE WHEN i > 1 AND kept[i - 1] + 1 <> kept[i] THEN '[...] ' ELSE '' END || units[kept[i] + 1]), ' ')) AS snippet,
round(coalesce(list_sum(list_transform(kept, lambda j: length(units[j + 1]))), 0) / greatest(coalesce(list_sum(list_transform(units, lambda u: length(u))), 0), 1)::DOUBLE, 9) AS ratio FROM z""")
def render_snippet(spark, sf):
    return budgeted(spark, sf).select("doc_id", F.sha1(ids.render(F.col("units"), F.col("kept"))).alias("snippet"), F.round(ids.ratio(F.col("units"), F.col("kept")), 9).alias("ratio"))


# Fixed values of the SQL alone: letters with an accent of the tables' languages.  (The library folds by a rule.)
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
PLAIN = f"lower(regexp_replace(translate(coalesce({{}}, ''), '{ACCENTED}', '{UNACCENTED}'), '[^\\x00-\\x7F]', '', 'g'))"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({PLAIN.format(c)}, '[a-z0-9]+')"


@query(f"""WITH {PAIRS}, u AS (SELECT conv_id, turn, query, {UNITS.replace("text", "body")} AS units FROM pairs),
s AS (SELECT conv_id, turn, units, list_transform(units, lambda x: CASE WHEN len({tokens_sql("x")}) = 0 THEN 0::DOUBLE ELSE len(list_filter({tokens_sql("x")}, lambda w: list_contains({tokens_sql("query")}, w))) / len({tokens_sql("x")})::DOUBLE END) AS sc FROM u),
k AS (SELECT conv_id, turn, units, list_filter(range(0, len(units)), lambda i: sc[i + 1] >= 0.2) AS kept FROM s)
SELECT conv_id, turn, array_to_string(list_transform(kept, lambda i: CAST(i AS VARCHAR)), ',') AS kept_ids,
array_to_string(list_transform(range(1, len(kept) + 1), lambda i: CASE WHEN i > 1 AND kept[i - 1] + 1 <> kept[i] THEN '[...] ' ELSE '' END || units[kept[i] + 1]), ' ') AS snippet,
round(coalesce(list_sum(list_transform(kept, lambda j: length(units[j + 1]))), 0) / greatest(coalesce(list_sum(list_transform(units, lambda u: length(u))), 0), 1)::DOUBLE, 9) AS ratio FROM k""")
def compress_flagship(spark, sf):
    rows = pairs(spark, sf).withColumn("units", text.sentences(F.col("body")))
    done = scoring.compress(rows, threshold=0.2)
    return done.select("conv_id", "turn", F.array_join(F.transform("kept_ids", lambda i: i.cast("string")), ",").alias("kept_ids"), "snippet", F.round("compression_ratio", 9).alias("ratio"))


PRF = f"""{PAIRS}, tk AS (SELECT conv_id, turn, {tokens_sql("query")} AS p, {tokens_sql("body")} AS g FROM pairs),
pc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS t FROM tk) GROUP BY ALL),
gc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS t FROM tk) GROUP BY ALL),
ov AS (SELECT conv_id, turn, CAST(sum(least(pc.n, gc.n)) AS BIGINT) AS o FROM pc JOIN gc USING (conv_id, turn, t) GROUP BY ALL),
sz AS (SELECT tk.conv_id, tk.turn, len(p) AS n_pred, len(g) AS n_gold, coalesce(o, 0) AS n_overlap FROM tk LEFT JOIN ov ON ov.conv_id = tk.conv_id AND ov.turn = tk.turn),
pr AS (SELECT *, CASE WHEN n_pred = 0 THEN 1.0::DOUBLE WHEN n_gold = 0 THEN 0 ELSE n_overlap / n_pred::DOUBLE END AS precision, CASE WHEN n_gold = 0 THEN 1.0::DOUBLE WHEN n_pred = 0 THEN 0 ELSE n_overlap / n_gold::DOUBLE END AS recall FROM sz),
prf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def scored_pairs(spark, sf) -> DataFrame:
    return metrics.token_prf(pairs(spark, sf), ["conv_id", "turn"], "query", "body")


@query(f"WITH {PRF} SELECT conv_id, turn, n_pred, n_gold, n_overlap, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM prf")
def token_prf(spark, sf):
    return scored_pairs(spark, sf).select("conv_id", "turn", "n_pred", "n_gold", "n_overlap", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {PRF}, x AS (SELECT *, 'p' || (conv_id % 3) AS provider, CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'howto' ELSE '?' END AS intent, conv_id % 5 <> 0 AS has_body, conv_id % 7 <> 0 AS has_gold FROM prf)
SELECT provider, intent, count(*) AS n_docs, count(*) FILTER (has_gold) AS n_scored, count(*) FILTER (NOT has_body) AS n_no_body, count(*) FILTER (has_body AND NOT has_gold) AS n_no_gold, count(*) FILTER (has_gold AND n_gold = 0) AS n_gold_empty,
{", ".join(f"coalesce(round(avg({c}) FILTER (has_gold), 9), 'nan'::DOUBLE) AS {c}" for c in ("precision", "recall", "f1"))},
quantile_cont(n_pred, 0.5) FILTER (has_gold) AS median_pred, quantile_cont(n_gold, 0.5) FILTER (has_gold) AS median_gold FROM x GROUP BY GROUPING SETS ((provider), (provider, intent))""")
def provider_summary(spark, sf):
    rows = scored_pairs(spark, sf).withColumns({
        "provider": F.concat(F.lit("p"), F.col("conv_id") % 3),
        "intent": F.expr("CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'howto' ELSE CASE turn % 2 WHEN 0 THEN '' END END"),
        "has_body": F.col("conv_id") % 5 != 0,
        "has_gold": F.col("conv_id") % 7 != 0,
    })
    return metrics.summary(rows, "provider", "intent")


@query("""WITH r AS (SELECT page_id AS query_id, url FROM pages), b AS (SELECT url, max(CASE WHEN page_id % 4 = 0 THEN 'empty' ELSE 'ok' END) AS body_status FROM pages WHERE page_id % 3 <> 0 GROUP BY url),
g AS (SELECT page_id AS query_id, url, 'ok' AS gold_status FROM pages WHERE page_id % 2 = 0) SELECT r.query_id, r.url, coalesce(body_status, 'missing') AS body_status, coalesce(gold_status, 'missing') AS gold_status FROM r LEFT JOIN b ON r.url = b.url LEFT JOIN g ON g.query_id = r.query_id AND g.url = r.url""")
def doc_eval_join(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    bodies = pages.filter("page_id % 3 != 0").groupBy("url").agg(F.max(F.expr("CASE WHEN page_id % 4 = 0 THEN 'empty' ELSE 'ok' END")).alias("body_status"))
    gold = pages.filter("page_id % 2 = 0").select(F.col("page_id").alias("query_id"), "url", F.lit("ok").alias("gold_status"), F.array(F.lit(0)).alias("gold_ids"))
    return assembly.doc_eval_join(pages.withColumnRenamed("page_id", "query_id"), bodies, gold).drop("gold_ids")


def arms(spark, sf) -> DataFrame:
    """Two sets of unit ids of every document, from digests."""
    pick = lambda salt: F.filter(F.transform("units", lambda u, i: F.when(text.fraction(F.concat_ws("-", F.lit(salt), F.col("doc_id"), i)) < 0.3, i.cast("int")).otherwise(-1)), lambda i: i >= 0)
    rows = units(spark, sf).withColumns({"a": pick("a"), "b": pick("b")})
    return rows.withColumn("m", ids.set_prf(F.col("a"), F.col("b"))).select("doc_id", "a", "b", F.size("a").cast("long").alias("n_pred"), F.size("b").cast("long").alias("n_gold"), "m.*")


def arm_sql(salt: str) -> str:
    return f"list_filter(range(0, len(units)), lambda i: {fraction_sql(chr(39) + salt + '-' + chr(39) + ' || doc_id || ' + chr(39) + '-' + chr(39) + ' || i')} < 0.3)"


ARMS = f"""{DOC_UNITS}, ar AS (SELECT doc_id, {arm_sql("a")} AS a, {arm_sql("b")} AS b FROM du),
ap AS (SELECT doc_id, a, b, len(a) AS n_pred, len(b) AS n_gold, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END AS precision, CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(b)::DOUBLE END AS recall,
CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END AS jaccard FROM ar),
am AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ap)"""


@query(f"WITH {ARMS} SELECT doc_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(jaccard, 9) AS jaccard FROM am")
def set_prf_jaccard(spark, sf):
    return arms(spark, sf).select("doc_id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")))


@query(f"WITH {ARMS} SELECT CASE WHEN f1 = 0 THEN '0' WHEN f1 < 0.25 THEN '(0,.25)' WHEN f1 < 0.5 THEN '[.25,.5)' WHEN f1 < 0.75 THEN '[.5,.75)' WHEN f1 < 1 THEN '[.75,1)' ELSE '1' END AS bucket, count(*) AS n FROM am GROUP BY 1")
def f1_histogram(spark, sf):
    return metrics.histogram(arms(spark, sf), "f1")


@query(f"WITH {ARMS} SELECT doc_id, n_pred, n_gold, round(f1, 9) AS f1 FROM (SELECT * FROM am ORDER BY f1, abs(n_pred - n_gold) DESC, doc_id LIMIT 10)")
def worst_k(spark, sf):
    return metrics.worst(arms(spark, sf), 10, "doc_id").select("doc_id", "n_pred", "n_gold", F.round("f1", 9).alias("f1"))


@query(f"WITH {ARMS} SELECT count(*) AS n, count(*) FILTER (list_sort(a) = list_sort(b)) AS exact, count(*) FILTER (len(a) = 0 AND len(b) = 0) AS both_empty, round(avg(jaccard), 9) AS jaccard, round(avg(len(a)), 9) AS size_a, round(avg(len(b)), 9) AS size_b, count(*) FILTER (len(list_intersect(a, b)) < len(b)) AS violations FROM am")
def ab_agreement(spark, sf):
    return metrics.agreement(arms(spark, sf))


@query("""WITH p(model, price_in, price_out) AS (VALUES ('src0', 1.5::DOUBLE, 6.0::DOUBLE), ('src1', 0.25::DOUBLE, 1.25::DOUBLE)), s AS (SELECT source AS model, CAST(sum(n_chars) AS BIGINT) AS tokens_in, CAST(sum(n_chars // 10) AS BIGINT) AS tokens_out FROM documents GROUP BY 1)
SELECT s.model, tokens_in, tokens_out, round((tokens_in * coalesce(price_in, 0) + tokens_out * coalesce(price_out, 0)) / 1e6, 9) AS cost FROM s LEFT JOIN p ON p.model = s.model""")
def label_cost(spark, sf):
    prices = spark.createDataFrame([("src0", 1.5, 6.0), ("src1", 0.25, 1.25)], "model string, price_in double, price_out double")
    rows = table(spark, sf, "documents").select(F.col("source").alias("model"), F.col("n_chars").alias("tokens_in"), F.expr("n_chars div 10").alias("tokens_out"))
    return metrics.cost(rows, prices)


@query(f"""WITH {POOLED}, y AS (SELECT po.*, CASE WHEN {fraction_sql("'y' || doc_id || '-' || unit_id")} < 0.3 THEN 1 ELSE 0 END AS label FROM po), t(sentence_threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)),
c AS (SELECT sentence_threshold, count(*) FILTER (n_tokens > 0 AND score >= sentence_threshold AND label = 1) AS tp, count(*) FILTER (n_tokens > 0 AND score >= sentence_threshold AND label = 0) AS fp, count(*) FILTER (NOT (n_tokens > 0 AND score >= sentence_threshold) AND label = 1) AS fn, count(*) AS n FROM y, t GROUP BY 1)
SELECT sentence_threshold, tp, fp, fn, round(tp / greatest(tp + fp, 1)::DOUBLE, 9) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 9) AS recall, round((tp + fp) / n::DOUBLE, 9) AS keep_rate FROM c""")
def threshold_sweep(spark, sf):
    rows = exploded(spark, sf).select("doc_id", "unit_id", (text.fraction(F.concat(F.lit("y"), F.col("doc_id"), F.lit("-"), F.col("unit_id"))) < 0.3).cast("int").alias("label"))
    pairs_ = spark.createDataFrame([(0.5, 0.3), (0.5, 0.5), (0.5, 0.7)], "token_threshold double, sentence_threshold double")
    out = metrics.sweep(rows, token_scores(spark, sf), pairs_, ["doc_id", "unit_id"])
    return out.select("sentence_threshold", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "keep_rate")))


def ranked(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("source", "doc_id", "quality", text.fraction(F.concat(F.lit("q"), "doc_id")).alias("s"))


RANKED = f"rk AS (SELECT d.source, d.doc_id, l.quality, {fraction_sql(chr(39) + 'q' + chr(39) + ' || d.doc_id')} AS s FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


@query(f"WITH {RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, doc_id) AS k FROM rk), a AS (SELECT source, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(CASE WHEN quality = 1 THEN k ELSE 0 END)::DOUBLE AS ranks FROM r GROUP BY 1) SELECT source, round((ranks - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM a WHERE p > 0 AND p < n")
def ranking_auc(spark, sf):
    return metrics.auc(ranked(spark, sf), "source", "s", "quality", "doc_id").select("source", F.round("auc", 9).alias("auc"))


@query(f"WITH {RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS k, sum(quality) OVER (PARTITION BY source) AS p FROM rk) SELECT source, round(sum(CASE WHEN k <= p THEN quality ELSE 0 END) / max(p)::DOUBLE, 9) AS recall FROM r WHERE p > 0 GROUP BY source")
def recall_at_k(spark, sf):
    return metrics.recall_at_relevant(ranked(spark, sf), "source", "s", "quality", "doc_id").select("source", F.round("recall", 9).alias("recall"))


@query(f"WITH {RANKED}, c AS (SELECT s - 0.5 > 0 AS h, CASE WHEN doc_id % 10 = 0 THEN -100 ELSE quality END AS y FROM rk) SELECT count(*) FILTER (h AND y = 1) AS tp, count(*) FILTER (h AND y = 0) AS fp, count(*) FILTER (NOT h AND y = 1) AS fn, count(*) FILTER (NOT h AND y = 0) AS tn, round(avg(CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS pos_frac, round(avg(CASE WHEN h = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM c WHERE y <> -100")
def token_confusion(spark, sf):
    rows = ranked(spark, sf).select((F.col("s") - 0.5).alias("logit"), F.when(F.col("doc_id") % 10 == 0, -100).otherwise(F.col("quality")).alias("y"))
    return metrics.confusion(rows, "logit", "y")


@query("WITH x AS (SELECT doc_id, CAST(CAST('0x' || substr(sha1('42' || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE AS f FROM documents) SELECT doc_id, CASE WHEN f < 0.05 THEN 'test' WHEN f < 0.1 THEN 'val' ELSE 'train' END AS split FROM x")
def assign_split(spark, sf):
    key = F.concat(F.lit("42\0"), F.coalesce("source", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", metrics.assign_split(key).alias("split"))


@query(f"WITH {ARMS} SELECT doc_id, array_to_string(list_sort(list_transform(list_filter(a, lambda r: r >= 3 AND r < 12), lambda r: r - 3)), ',') AS ids FROM am")
def label_reindex(spark, sf):
    out = windows.reindex(F.col("a"), F.lit(3), F.lit(12))
    return arms(spark, sf).select("doc_id", F.array_join(F.transform(out, lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""WITH {EXPLODED}, ft AS (SELECT doc_id, unit_id, {tokens_sql("unit")} AS t FROM eu), g AS (SELECT doc_id, unit_id, CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM ft),
bt AS (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark), bs AS (SELECT item_id, CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM bt),
x AS (SELECT item_id, unnest(s) AS k FROM bs), y AS (SELECT doc_id, unit_id, unnest(s) AS k FROM g) SELECT item_id AS frag_id, doc_id, unit_id, count(*) AS n FROM x JOIN y ON x.k = y.k GROUP BY ALL""")
def shingle_overlap(spark, sf):
    """Hashes of the benchmark's shingles find the units; shingles of equal hash are then compared as strings."""
    words = lambda df, c, *keys: df.select(*keys, text.tokens(F.col(c)).alias("words")).withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
    hashed = lambda df, *keys: df.withColumn("x", F.explode(text.shingle_hashes("hs"))).select(*keys, "words", F.col("x.h").alias("h"), F.col("x.i").alias("i"))
    gram = F.expr("array_join(slice(words, i + 1, 5), ' ')")
    f = hashed(words(table(spark, sf, "benchmark").withColumnRenamed("item_id", "frag_id"), "text", "frag_id"), "frag_id").select("frag_id", "h", gram.alias("f")).distinct()
    u = hashed(words(exploded(spark, sf), "unit", "doc_id", "unit_id"), "doc_id", "unit_id")
    few = f.limit(1_000_001).count() <= 1_000_000  # some 60 bytes each
    both = u.join(F.broadcast(f) if few else f, "h").withColumn("g", gram).filter("f = g")
    return both.groupBy("frag_id", "doc_id", "unit_id").agg(F.count_distinct("g").alias("n"))


@query()
def align_fragments(spark, sf):
    """The fragments of each benchmark text aligned to all units of every document; pairs without a match have no row."""
    quoted = table(spark, sf, "benchmark").select("item_id", F.posexplode(text.fragments(F.col("text"))).alias("frag_id", "fragment"))
    return align.align_across(quoted, exploded(spark, sf), "item_id", "doc_id")


@query(f"""WITH {DOC_UNITS}, j AS (SELECT doc_id, array_to_string(units, ' [...] ') AS h FROM du) SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(h, '\\[\\s*\\.\\.\\.\\s*\\]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 8)) AS INTEGER) AS n_fragments,
CAST(len(list_distinct(list_filter(list_transform(string_split(h, '[...]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''))) AS INTEGER) AS n_chunks FROM j""")
def split_fragments(spark, sf):
    rows = units(spark, sf).select("doc_id", F.array_join("units", " [...] ").alias("h"))
    return rows.select("doc_id", F.size(text.fragments(F.col("h"))).alias("n_fragments"), F.size(text.chunks(F.col("h"))).alias("n_chunks"))


@query(f"""WITH {ARMS}, v AS (SELECT doc_id, list_filter(list_concat(a, [99, -1]), lambda i: i >= 0 AND i < 20) AS v, doc_id % 25 AS anchor, a, b FROM am)
SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(v) > 0 AND anchor < 20 THEN list_append(v, anchor) ELSE v END)), ',') AS merged, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS context FROM v""")
def merge_anchor(spark, sf):
    rows = arms(spark, sf)
    merged = ids.merge_anchor(F.concat("a", F.array(F.lit(99), F.lit(-1))), (F.col("doc_id") % 25).cast("int"), F.lit(20))
    as_text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return rows.select("doc_id", as_text(merged).alias("merged"), as_text(ids.superset(F.col("a"), F.col("b"))).alias("context"))


@query(f"WITH {PAIRS}, u AS (SELECT conv_id, turn, query, {UNITS.replace('text', 'body')} AS units FROM pairs) SELECT conv_id, turn, sha1('QUERY:' || chr(10) || query || chr(10) || chr(10) || 'DOCUMENT UNITS:' || chr(10) || array_to_string(list_transform(range(0, len(units)), lambda i: '[' || i || '] ' || units[i + 1]), chr(10))) AS prompt FROM u")
def build_prompt(spark, sf):
    rows = pairs(spark, sf).withColumn("units", text.sentences(F.col("body")))
    return rows.select("conv_id", "turn", F.sha1(ids.prompt(F.col("query"), F.col("units"))).alias("prompt"))


@query("""WITH k AS (SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k FROM events),
r AS (SELECT event_id, TRY_CAST(k AS INTEGER) AS k, event_id % 5 AS shape, event_id % 7 = 0 AS cut FROM k),
v AS (SELECT event_id, cut, shape, CASE shape WHEN 0 THEN [k, 3, 1] WHEN 1 THEN [k, k] WHEN 2 THEN [] END AS ids FROM r)
SELECT event_id, CASE WHEN NOT cut AND shape < 3 THEN array_to_string(list_sort(list_distinct(list_filter(ids, lambda i: i >= 0 AND i < 50))), ',') END AS ids,
CASE WHEN cut THEN 'error:truncated' WHEN shape < 3 THEN 'ok' WHEN shape = 3 THEN 'error:schema_shape' ELSE 'error:invalid_json' END AS status FROM v""")
def parse_label_json(spark, sf):
    """Answers of every shape around the number in props: objects, bare lists, other JSON, cut JSON; some ended by length."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    shapes = (F.concat(F.lit('{"relevant_unit_ids": ['), k, F.lit(", 3, 1]}")), F.concat(F.lit("["), k, F.lit(", "), k, F.lit("]")), F.lit("[]"), F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit("["), k))
    raw = F.element_at(F.array(*shapes), (F.col("event_id") % len(shapes) + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"), F.when(F.col("event_id") % 7 == 0, "length").otherwise("stop").alias("finish"))
    answer = rows.select("event_id", labeling.parse_answer(F.col("raw"), F.lit(50), F.col("finish")).alias("a"))
    return answer.select("event_id", F.array_join(F.transform("a.ids", lambda i: i.cast("string")), ",").alias("ids"), "a.status")


@query("""WITH t(topic) AS (VALUES ('science'), ('law'), ('travel')), i(intent) AS (VALUES ('lookup'), ('howto'), ('compare')), s AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT source, topic, intent FROM s, t, i WHERE NOT (intent = 'compare' AND doc_id % 2 = 0)""")
def intent_grid(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    grid = rows.withColumn("topic", F.explode(F.array(*map(F.lit, ("science", "law", "travel"))))).withColumn("intent", F.explode(F.array(*map(F.lit, ("lookup", "howto", "compare")))))
    return grid.filter(~((F.col("intent") == "compare") & (F.col("doc_id") % 2 == 0))).select("source", "topic", "intent")


@query("SELECT CAST(floor(log2(greatest(n_chars, 1))) AS INTEGER) AS bucket, count(*) AS n, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY 1")
def length_buckets(spark, sf):
    return windows.length_buckets(table(spark, sf, "documents"), "n_chars", 1 << 16, ["doc_id"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query()
def segment_markdown(spark, sf):
    """Page text through the Markdown segmenter: number of units of each page."""
    from siftline.functions.segment import segment

    return table(spark, sf, "pages").select("page_id", F.size(segment(text.strip_tags(F.col("html")))).alias("n_units"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_resume_dedupe(spark, sf):
    from siftline.streaming.resume import first_of_keys

    return first_of_keys(spark, sf, "events", ["user_id", "event_type"])
