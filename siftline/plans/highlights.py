"""Labels from the highlights that a search provider marks in its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.segment import segment
from siftline.functions.text import fragments
from siftline.operators.align import align_rows
from siftline.operators.assembly import pending, truthy
from siftline.plans.dataset import MOST_UNITS, RETRIEVERS, gate_units
from siftline.sources.shared import small

#: What such rows name as their labeler and its version.
MODEL, VERSION = "exa-highlights-v1", "exa_v1"


def confident(highlights: Column, scores: Column, least: float | None) -> Column:
    """The highlights that score at least ``least``; all where there are no scores or no least.

    Highlights and scores go in pairs; what has no partner goes where it is filtered.
    """
    if least is None:
        return highlights
    zipped = F.filter(F.zip_with(highlights, scores, lambda h, s: F.struct(h.alias("h"), s.alias("s"))), lambda x: x["h"].isNotNull() & (x["s"] >= least))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, F.transform(zipped, lambda x: x["h"])).otherwise(highlights)


def utc_now() -> Column:
    """The query's time to the second, with the session's offset."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


def label_highlights(queries: DataFrame, results: DataFrame, *, model: str = MODEL, version: str = VERSION, done: DataFrame | None = None, limit: int = 0, least: float | None = None, order: str = "ord", most: int = MOST_UNITS["exa"], cut: Callable[[Column], Column] = segment) -> DataFrame:
    """A row for each result of the queries (query_id, query, topic, intent), labeled by what its first highlight covers.

    results: query_id, url, title, published_date, text, highlights,
    highlight_scores, score.  A query with any row in ``done`` is left out as a
    whole, then the first ``limit`` in ``order`` go on (0: all).  A result
    without text or without units gives no row; one of more than ``most`` units
    is skipped:long(n), without its units; one whose highlight covers no unit
    is skipped:empty_align and keeps them.  Ids compare as strings.  Results and queries may
    repeat: each pair of them has its row.  Queries few enough for a broadcast
    leave the results where they are; their number is counted for that.
    """
    origin = RETRIEVERS["exa"].origin
    asked = queries if done is None else pending(queries, done, ["query_id"])
    if limit:
        asked = asked.orderBy(order).limit(limit)
    asked = asked.select(F.col("query_id").cast("string").alias("query_id"), "query", "topic", "intent")
    rows = results.filter(truthy(results, "text")).withColumn("query_id", F.col("query_id").cast("string")).join(small(asked), "query_id")
    rows = rows.withColumn("units", cut(F.col("text"))).filter(F.size("units") > 0).withColumn("gate", gate_units(F.col("units"), most))
    short = F.col("gate") == "ok"
    none = F.array().cast("array<string>")
    marked = fragments(F.coalesce(F.get(confident(F.col("highlights"), F.col("highlight_scores"), least), F.lit(0)), F.lit("")))
    rows = rows.withColumns({"units": F.when(short, F.col("units")).otherwise(none), "fragments": F.when(short, marked).otherwise(none)})
    rows = align_rows(rows, "fragments", "units")
    status = F.when(~short, F.col("gate")).when(F.size("unit_ids") == 0, "skipped:empty_align").otherwise("ok")
    return rows.select(
        "query_id", F.col("url").alias("doc_id"), F.lit(origin).alias("origin"), F.lit(origin).alias("labeler_provider"), F.lit(model).alias("labeler_model"), F.lit(version).alias("prompt_version"), status.alias("status"),
        "query", "topic", "intent", "url", "title", "published_date", F.col("text").alias("body"), "units", F.col("unit_ids").alias("relevant_unit_ids"), F.size("units").alias("n_units"), F.size("unit_ids").alias("n_kept"),
        "n_fragments", F.col("n_matched").alias("n_fragments_matched"), (F.col("n_fragments") - F.col("n_matched")).alias("n_fragments_dropped"), F.col("score").alias("exa_score"), utc_now().alias("timestamp"),
    )


def highlight_counts(rows: DataFrame) -> DataFrame:
    """How many pairs were written, kept, skipped for their length, and skipped as nothing was aligned."""
    return rows.agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("status") == "ok").alias("kept"), F.count_if(F.col("status").startswith("skipped:long")).alias("skipped_long"), F.count_if(F.col("status") == "skipped:empty_align").alias("skipped_empty"))
