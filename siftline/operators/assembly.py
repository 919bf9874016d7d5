"""Merging, deduplication, resume and the joins that assemble datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(df: DataFrame, name: str) -> Column:
    """Neither null nor empty, zero or false."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return c.isNotNull() & (c != 0)


def first_seen(df: DataFrame, key: list[str], order: list[str], *, last: bool = False) -> DataFrame:
    """One row of each key: the first in the order, or the last.  Null keys are one key.

    An aggregate rather than a window: combined before the shuffle, so a key
    with a third of the rows is no burden to any one task.
    """
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(row.alias("row")).select("row.*")


def first_of_text(df: DataFrame, text: str, order: list[str], keep: list[str]) -> DataFrame:
    """first_seen by a long text: grouped by digest, so that no text is moved."""
    row = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(F.sha1(text).alias("__k"), F.length(text).alias("__n")).agg(row.alias("row")).select("row.*")


def concatenate(frames: list[DataFrame], order: str = "ord") -> DataFrame:
    """All rows of all inputs; missing columns are null; file_idx tells the input."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("file_idx", F.lit(i)) for i, f in enumerate(frames)])


def merge(frames: list[DataFrame], *, key: str, order: str, require: list[str] | None = None, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Rows with all required fields, the first of each key over the inputs, projected (keep goes before drop)."""
    rows = concatenate(frames)
    for name in require or []:
        rows = rows.filter(truthy(rows, name))
    rows = first_seen(rows, [key], ["file_idx", order])
    if keep:
        return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in keep))
    return rows.drop("file_idx", *(drop or []))


def merge_counts(df: DataFrame, key: str, require: str) -> DataFrame:
    """scanned, no_field, written, dup in one pass."""
    good = truthy(df, require)
    counted = df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~good).alias("no_field"), F.count_distinct(F.when(good, F.col(key))).alias("written"))
    return counted.withColumn("dup", F.col("scanned") - F.col("no_field") - F.col("written"))


def count_by(df: DataFrame, name: str, default: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(name), F.lit(default)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't done; ids compare as strings."""
    cast = lambda df: df.select(*(F.col(k).cast("string").alias(f"__{k}") for k in key)).distinct()
    match = reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.col(f"__{k}") for k in key])
    return rows.join(cast(done), match, "left_anti")


def pending_labels(rows: DataFrame, done: DataFrame, provider: str, model: str, version: str) -> DataFrame:
    """Rows not yet labeled by this provider, model and prompt version; rows without provider count as azure's."""
    same = done.filter((F.coalesce("labeler_provider", F.lit("azure")) == provider) & (F.col("labeler_model") == model) & (F.col("prompt_version") == version))
    return pending(rows, same, ["query_id", "doc_id"])


def join_queries_units(queries: DataFrame, documents: DataFrame, order: str) -> DataFrame:
    """Every query with the units of its source document; of documents with one id the last that has units counts."""
    latest = first_seen(documents.filter(F.size("units") > 0), ["doc_id"], [order], last=True).drop(order)
    return queries.join(latest, queries["source_doc_id"] == latest["doc_id"], "inner")


def hard_negatives(ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """The best ranked document of each query that is not among its positives (query, doc_id, rank)."""
    rest = ranked.join(positives, ["query", "doc_id"], "left_anti")
    return rest.groupBy("query").agg(F.min_by(F.struct("doc_id", "rank"), F.struct("rank", "doc_id")).alias("r")).select("query", "r.*")


def doc_eval_join(results: DataFrame, bodies: DataFrame, gold: DataFrame) -> DataFrame:
    """Every surfaced document with its body and gold status; what is absent is missing."""
    joined = results.join(bodies, "url", "left").join(gold, ["query_id", "url"], "left")
    return joined.withColumns({
        "body_status": F.coalesce("body_status", F.lit("missing")),
        "gold_status": F.coalesce("gold_status", F.lit("missing")),
        "gold_ids": F.coalesce("gold_ids", F.array().cast("array<int>")),
    })
