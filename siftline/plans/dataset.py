"""Stages that build a dataset: scrape, segment, synthesize queries, label, prepare for training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.segment import segment
from siftline.functions.text import count_tokens, excluded, strip
from siftline.operators.assembly import first_seen, pending, truthy
from siftline.operators.labeling import Labeler, label_rows
from siftline.operators.metrics import assign_split
from siftline.operators.windows import body, pack_windows, reindex, spans

#: Units above which a document is not labeled, by where it is gated.
MOST_UNITS = {"scrape": 300, "exa": 300, "msmarco": 500}
#: Intents of queries.
INTENTS = ("definitional", "procedural", "comparative", "debugging", "best-practice", "enumeration")


def no_ids() -> Column:
    return F.array().cast("array<int>")


@dataclass(frozen=True)
class Retriever:
    """What a provider's rows are called, where its positions begin, and whether it writes rows of empty bodies."""

    origin: str
    fetcher: str = ""
    version: str = ""
    first_position: int = 0
    write_empty: bool = False
    rpm: int | None = None


#: Providers by name, with the names that their rows carry and their default requests a minute.
RETRIEVERS = {
    "exa": Retriever("exa", rpm=10),
    "firecrawl": Retriever("firecrawl", "firecrawl-v2", "fc_v1", write_empty=True, rpm=6),
    "tavily": Retriever("tavily", "tavily-extract-v1", "tavily_v1", first_position=1, rpm=60),
    "brave": Retriever("brave", rpm=60),
}


def gate_units(units: Column, most: int) -> Column:
    """ok, or skipped:long(n) above ``most`` units."""
    n = F.size(units)
    return F.when(n > most, F.concat(F.lit("skipped:long("), n.cast("string"), F.lit(")"))).otherwise("ok")


def body_by_url(results: DataFrame, extracts: DataFrame) -> DataFrame:
    """Search results with the body that was extracted from their URL; the empty body where there is none."""
    bodies = first_seen(extracts.select("url", "body"), ["url"], ["body"])
    return results.join(bodies, "url", "left").withColumn("body", F.coalesce("body", F.lit("")))


def scrape_row(df: DataFrame, retriever: Retriever, reason: Column) -> DataFrame:
    """Rows of the scrape schema: status is the reason they were skipped for, or ok; nothing is relevant yet."""
    rows = df.withColumns({
        "query_id": F.col("query_id").cast("string"), "doc_id": F.col("url"), "origin": F.lit(retriever.origin), "labeler_provider": F.lit(retriever.origin), "labeler_model": F.lit(retriever.fetcher), "prompt_version": F.lit(retriever.version),
        "status": F.coalesce(reason, F.lit("ok")), "relevant_unit_ids": no_ids(), "n_units": F.size("units"), "n_kept": F.lit(0),
    })
    names = ("query_id", "doc_id", "origin", "labeler_provider", "labeler_model", "prompt_version", "status", "query", "topic", "intent", "url", "title", "description", "body", "units", "relevant_unit_ids", "n_units", "n_kept", "position")
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names))


def scrape(queries: DataFrame, results: DataFrame, retriever: Retriever, *, done: DataFrame | None = None, limit: int = 0, order: str = "ord", most: int = MOST_UNITS["scrape"], cut: Callable[[Column], Column] = segment) -> DataFrame:
    """Scrape rows for the queries (query_id, query) from a table of results (query_id, rank, url, title, body).

    A query with any row in ``done`` is left out as a whole, then the first
    ``limit`` go on (0: all).  Results of excluded hosts go and the rest is
    numbered.  A blank body gives a row, with the empty body, only where the retriever says so; a
    body without units gives none; one of more than ``most`` units gives a row
    with its body, without its units.
    """
    asked = queries if done is None else pending(queries, done, ["query_id"])
    if limit:
        asked = asked.orderBy(order).limit(limit)
    found = results.filter(~excluded(F.col("url")))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1 + retriever.first_position
    rows = asked.join(found.withColumn("position", number), "query_id")
    blank = strip(F.coalesce("body", F.lit(""))) == ""
    rows = rows.withColumns({"__blank": blank, "body": F.when(blank, "").otherwise(F.col("body"))}).withColumn("units", F.when(F.col("__blank"), F.array().cast("array<string>")).otherwise(cut(F.col("body"))))
    rows = rows.filter((F.col("__blank") & F.lit(retriever.write_empty)) | (F.size("units") > 0))
    status = F.when(F.col("__blank"), "skipped:empty_md").otherwise(gate_units(F.col("units"), most))
    rows = rows.withColumn("__status", status).withColumn("units", F.when(F.col("__status").startswith("skipped:long"), F.array().cast("array<string>")).otherwise(F.col("units")))
    return scrape_row(rows, retriever, F.col("__status"))


def segment_documents(df: DataFrame, *, cut: Callable[[Column], Column] = segment) -> DataFrame:
    """Rows with a body, cut into units anew; labels and status are reset."""
    rows = df.filter(truthy(df, "body")).withColumn("units", cut(F.col("body")))
    return rows.withColumns({"n_units": F.size("units"), "relevant_unit_ids": no_ids(), "n_kept": F.lit(0), "status": F.lit("ok")})


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def normal_intent(intent: Column) -> Column:
    """Lower case, white space as it is; null and unknown intents are procedural."""
    low = F.lower(intent)
    return F.when(low.isin(*INTENTS), low).otherwise("procedural")


def allowed_intents(existing: Column) -> Column:
    """All intents but those there are."""
    return F.array_except(F.array(*map(F.lit, INTENTS)), F.coalesce(existing, F.array().cast("array<string>")))


def clean_line(line: Column) -> Column:
    """Without a list mark in front and quotes around."""
    return F.regexp_replace(F.regexp_replace(line, r"^\s*([-*+]|\d+[.)])\s+", ""), r"""^[\s"'`]+|[\s"'`]+$""", "")


def parse_queries(answer: Column, existing: Column, most: int) -> Column:
    """[(intent, query)] of lines ``INTENT ||| query`` of 3 to 20 words: the first of each intent but the existing one, at most so many.

    A list mark in front of a line goes, and quotes around the query.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r]"), strip), lambda x: F.contains(x, F.lit("|||")))
    parts = F.transform(F.transform(lines, lambda x: F.regexp_replace(x, r"^([-*+]|\d+[.)])\s+", "")), lambda x: F.struct(F.lower(strip(F.substring_index(x, "|||", 1))).alias("intent"), strip(F.regexp_replace(x, r"(?s)^.*?\|\|\|", "")).alias("query")))
    rows = F.transform(parts, lambda x: F.struct(x["intent"].alias("intent"), F.regexp_replace(F.regexp_replace(x["query"], '^"+|"+$', ""), "^'+|'+$", "").alias("query")))
    rows = F.filter(rows, lambda x: x["intent"].isin(*INTENTS) & (x["intent"] != existing) & n_words(x["query"]).between(3, 20))
    first = F.filter(rows, lambda x, i: F.array_position(F.transform(rows, lambda y: y["intent"]), x["intent"]) == i + 1)
    return F.slice(first, 1, most)


def make_qid(*parts: Column) -> Column:
    """``syn_pd_`` and twelve digits that follow from the parts: their SHA-1's first sixty bits, modulo 10^12."""
    key = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    number = F.conv(F.substring(F.sha1(key), 1, 15), 16, 10).cast("long") % 10**12
    return F.concat(F.lit("syn_pd_"), F.lpad(number.cast("string"), 12, "0"))


def fresh_queries(df: DataFrame, done: DataFrame | None, order: list[str], words: tuple[int, int] = (3, 20)) -> DataFrame:
    """Queries of so many words, each once whatever its case: none of ``done``, and the first of equal ones."""
    rows = df.filter(n_words(F.col("query")).between(*words)).withColumn("__low", F.lower("query"))
    if done is not None:
        rows = rows.join(done.select(F.lower("query").alias("__low")).distinct(), "__low", "left_anti")
    return first_seen(rows, ["__low"], order).drop("__low")


def synth_prompt(query: Column, intent: Column, text: Column, n: int) -> Column:
    """Own wording: what a generator is asked, with the query there is and the first 6000 characters of the body."""
    allowed = F.array_join(allowed_intents(F.array(intent)), ", ")
    return F.concat(F.lit(f"Write {n} search queries that this document answers, one a line, as INTENT ||| query.\nThere is already: "), query, F.lit(" ("), intent, F.lit(")\nIntents: "), allowed, F.lit("\n\nDOCUMENT:\n"), F.substring(text, 1, 6000))


def synth_queries(df: DataFrame, generate: Callable[[Column], Column], *, n: int = 2, limit: int = 0, done: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Queries for documents (query_id, doc_id, status, query, intent, topic, body): qid, query, topic, persona, intent, source_query_id, source_doc_id.

    ``generate`` is the port: prompt to answer.  Rows with status ok, a body and
    a query are taken, the first in ``order`` of each (query_id, doc_id); those
    whose pair is (source_query_id, source_doc_id) of ``done`` are left out,
    then the first ``limit`` go on (0: all).  Queries of different documents may be
    equal; each stays.
    """
    pair = ["source_query_id", "source_doc_id"]
    rows = df.filter((F.col("status") == "ok") & truthy(df, "body") & truthy(df, "query"))
    rows = rows.withColumns({"source_query_id": F.col("query_id").cast("string"), "source_doc_id": F.col("doc_id").cast("string")})
    rows = first_seen(rows, pair, [order])
    if done is not None:
        rows = rows.join(done.select(*(F.col(c).cast("string") for c in pair)).filter("source_query_id != '' AND source_doc_id != ''").distinct(), pair, "left_anti")
    if limit:
        rows = rows.orderBy(order).limit(limit)
    rows = rows.withColumn("__had", normal_intent(F.col("intent")))
    rows = rows.withColumn("__answer", generate(synth_prompt(F.col("query"), F.col("__had"), F.col("body"), n)))
    rows = rows.withColumn("__x", F.explode(parse_queries(F.col("__answer"), F.col("__had"), n)))
    x = F.col("__x")
    return rows.select(make_qid(*map(F.col, pair), x["intent"], x["query"]).alias("qid"), x["query"].alias("query"), "topic", F.lit("synthesized from doc").alias("persona"), x["intent"].alias("intent"), *pair)


def sample_rows(df: DataFrame, key: Column, n: int, *, seed: int = 42) -> DataFrame:
    """n rows by the order of a hash of seed and key: the same rows on any cluster."""
    return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}\0"), key.cast("string")))).limit(n)


def first_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in file order; 0 stands for all."""
    return df.orderBy(order).limit(limit) if limit else df


def judged_pairs(qrels: DataFrame, queries: DataFrame, *, n: int, oversample: int = 1, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """A sample of qrels (qid, docid) with their query text: the first n in the sample's order.

    ``n * oversample`` rows are drawn by the order of a hash; pairs (qid, docid)
    of ``exclude`` go, and of rows that repeat a pair one stays.  A qid may have
    several docids.  Pairs without a query keep a null one.
    """
    pair = ["qid", "docid"]
    place = F.sha1(F.concat(F.lit(f"{seed}\0"), F.concat_ws("-", *pair)))
    rows = qrels.withColumn("__at", place).orderBy("__at").limit(n * oversample)
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("qid").cast(qrels.schema["qid"].dataType), F.col("docid").cast(qrels.schema["docid"].dataType)).distinct(), pair, "left_anti")
    rows = first_seen(rows, pair, ["__at"]).orderBy("__at", *pair).limit(n)
    return rows.join(queries, "qid", "left").orderBy("__at", *pair).drop("__at")


def label_judged(pairs: DataFrame, documents: DataFrame, labeler: Labeler, provider: str, model: str, version: str, *, most: int = MOST_UNITS["msmarco"], cut: Callable[[Column], Column] = segment) -> DataFrame:
    """The pairs' documents cut into units and labeled; documents without units or of more than ``most`` go."""
    rows = pairs.join(documents.select("docid", "body"), "docid").withColumn("units", cut(F.col("body")))
    rows = rows.filter((F.size("units") > 0) & (F.size("units") <= most)).withColumns({"status": F.lit("ok"), "query_id": F.col("qid").cast("string"), "doc_id": F.col("docid")})
    return label_rows(rows.drop("qid", "docid"), labeler, provider, model, version)


def training_rows(df: DataFrame, *, ok_only: bool = True) -> DataFrame:
    """Every row with the reason it is not taken for (status, units), or null."""
    bad = (F.coalesce("status", F.lit("")) != "ok") if ok_only else F.lit(False)
    return df.withColumn("reason", F.when(bad, "status").when(F.coalesce(F.size("units"), F.lit(0)) <= 0, "units"))


def prepro(df: DataFrame, *, max_length: int = 8192, margin: int = 8, specials: int = 3, val: float = 0.05, test: float = 0.05, seed: int = 42, ok_only: bool = True, cost: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """Training rows: doc_id, source, query, units, relevant_unit_ids, spans, n_tokens, window [start, end), split.

    Rows (doc_id, source, query, units, relevant_unit_ids, status) that may be
    taken; one whose pair of query and body is longer than ``max_length`` is
    cut into windows of its units, with its labels counted from each window's
    start; a window that is longer all the same goes.  The split follows from
    seed, query and body, so windows of a document share it.
    """
    rows = training_rows(df, ok_only=ok_only).filter("reason IS NULL").drop("reason")
    rows = rows.withColumns({"query": F.coalesce("query", F.lit("")), "relevant_unit_ids": F.coalesce("relevant_unit_ids", no_ids()), "lengths": F.transform("units", cost)})
    rows = rows.withColumn("asked", cost(F.col("query"))).withColumn("n_tokens", F.aggregate("lengths", F.lit(0), lambda s, n: s + n) + F.col("asked") + specials)
    rows = rows.withColumn("split", assign_split(F.concat(F.lit(f"{seed}\0"), F.col("query"), F.lit("\0"), body(F.col("units"))), val, test))
    short = rows.filter(F.col("n_tokens") <= max_length).withColumn("window", F.lit(None).cast("array<int>"))
    room = F.greatest(F.lit(64), F.lit(max_length - specials - margin) - F.col("asked"))
    long_ = rows.filter(F.col("n_tokens") > max_length).withColumn("w", pack_windows(F.col("lengths"), room))
    long_ = long_.withColumn("starts", F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 OR w[i] != w[greatest(i - 1, 0)])"))
    long_ = long_.withColumn("x", F.explode(F.expr("arrays_zip(starts, concat(slice(starts, 2, size(starts)), array(size(units))))")))
    long_ = long_.withColumns({"a": F.col("x.starts").cast("int"), "b": F.col("x")["1"].cast("int")})
    own = lambda c: F.slice(c, F.col("a") + 1, F.col("b") - F.col("a"))
    long_ = long_.withColumns({"relevant_unit_ids": reindex(F.col("relevant_unit_ids"), F.col("a"), F.col("b")), "n_tokens": F.aggregate(own("lengths"), F.lit(0), lambda s, n: s + n) + F.col("asked") + specials, "units": own("units"), "window": F.array("a", "b")})
    names = ["doc_id", "source", "query", "units", "relevant_unit_ids", "n_tokens", "window", "split"]
    out = short.select(*names).union(long_.filter(F.col("n_tokens") <= max_length).select(*names))
    return out.withColumn("spans", spans(F.col("units")))


def prepro_counters(df: DataFrame, *, max_length: int = 8192, margin: int = 8, specials: int = 3, ok_only: bool = True, cost: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """By source: raw rows, those skipped by status and for no units, documents that were windowed, window rows, windows dropped, rows kept."""
    marked = training_rows(df, ok_only=ok_only)
    base = marked.groupBy("source").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason") == "status").alias("status_skipped"), F.count_if(F.col("reason") == "units").alias("empty_units"))
    kept = prepro(df, max_length=max_length, margin=margin, specials=specials, ok_only=ok_only, cost=cost).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("window").isNotNull()).alias("window_rows"))
    good = marked.filter("reason IS NULL").withColumns({"lengths": F.transform("units", cost), "asked": cost(F.coalesce("query", F.lit("")))})
    over = good.filter(F.aggregate("lengths", F.lit(0), lambda s, n: s + n) + F.col("asked") + specials > max_length)
    over = over.withColumn("w", pack_windows(F.col("lengths"), F.greatest(F.lit(64), F.lit(max_length - specials - margin) - F.col("asked"))))
    long_ = over.groupBy("source").agg(F.count(F.lit(1)).alias("windowed_docs"), F.sum(F.array_max("w") + 1).alias("windows"))
    out = base.join(kept, "source", "left").join(long_, "source", "left").na.fill(0)
    return out.select("source", "raw", "status_skipped", "empty_units", "windowed_docs", "window_rows", (F.col("windows") - F.col("window_rows")).alias("oversize_dropped"), "kept")
