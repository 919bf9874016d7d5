"""Documents above a window: plan windows, score them, put the scores together again.

The scorer is a port, DataFrame to DataFrame: it gets rows with ``query`` and
``units`` and adds ``scores``, an array of one number a unit.  The one that is
shipped counts shared words and stands in for a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.ids import ratio, render
from siftline.functions.text import count_tokens, tokens
from siftline.operators.windows import pack_windows, select_under_budget, window_capacity

UnitScorer = Callable[[DataFrame], DataFrame]


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def lexical_scores(df: DataFrame, query: str = "query", units: str = "units", out: str = "scores") -> DataFrame:
    """Adds the share of a unit's tokens that the query has too; 0 for a unit without tokens."""
    texts = F.coalesce(units, F.array().cast("array<string>"))
    rows = df.withColumns({"__t": F.transform(texts, tokens), "__q": F.array_distinct(tokens(F.col(query)))})
    # the query's tokens are used twice, so that they stay a column and aren't found again for every token
    share = F.transform("__t", lambda t: F.when((F.size(t) == 0) | (F.size("__q") == 0), 0.0).otherwise(F.size(F.filter(t, lambda w: F.array_contains("__q", w))) / F.size(t).cast("double")))
    return rows.withColumn(out, share).drop("__t", "__q")


def plan_windows(df: DataFrame, key: list[str], *, max_length: int = 8192, cost: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """One row for each window of each document: key, query, window_start, window_end, units, est_length.

    Units are packed greedily into what a window holds next to the query; a
    unit above that is a window of its own.  Documents without units have none.
    """
    rows = df.select(*key, F.coalesce("query", F.lit("")).alias("query"), "units").filter(F.size("units") > 0)
    rows = rows.withColumns({"lengths": F.transform("units", cost), "asked": cost(F.col("query"))})
    rows = rows.withColumn("w", pack_windows(F.col("lengths"), window_capacity(max_length, F.col("asked"))))
    starts = F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 OR w[i] != w[greatest(i - 1, 0)])")
    rows = rows.withColumn("starts", starts).withColumn("window_end", F.expr("concat(slice(starts, 2, size(starts)), array(size(units)))"))
    jobs = rows.withColumn("x", F.explode(F.arrays_zip("starts", "window_end"))).drop("window_end").select(*key, "query", F.col("x.starts").alias("window_start"), F.col("x.window_end").alias("window_end"), "units", "lengths", "asked")
    own = lambda c: F.slice(c, F.col("window_start") + 1, F.col("window_end") - F.col("window_start"))
    jobs = jobs.withColumn("est_length", F.aggregate(own("lengths"), F.lit(0), lambda s, n: s + n) + F.col("asked"))
    return jobs.select(*key, "query", "window_start", "window_end", own("units").alias("units"), "est_length")


def assemble(df: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """Every row of ``df`` with unit_scores: its windows' scores one after another; units that weren't scored have 0."""
    joined = scored.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("window_start", "window_end", "scores"))).alias("__parts"))
    whole = F.flatten(F.transform("__parts", lambda p: F.transform(F.sequence(F.lit(0), p["window_end"] - p["window_start"] - 1), lambda i: F.coalesce(F.get(p["scores"], i), F.lit(0.0)))))
    rows = df.join(joined, key, "left").withColumn("__scores", F.coalesce(whole, F.array().cast("array<double>")))
    filled = F.transform(F.coalesce("units", F.array().cast("array<string>")), lambda u, i: F.coalesce(F.get("__scores", i), F.lit(0.0)))
    return rows.withColumn("unit_scores", filled).drop("__parts", "__scores")


def compress_long(df: DataFrame, key: list[str], *, max_length: int = 8192, threshold: float = 0.5, budget: int | Column | None = None, least: float = 0.1, cost: Callable[[Column], Column] = count_tokens, gap: str | None = "[...]", scorer: UnitScorer = lexical_scores) -> DataFrame:
    """Every row (key, query, units) with unit_scores, kept_ids, snippet and compression_ratio.

    ``key`` tells rows apart.  Rows without units keep nothing, at a ratio of
    0; a null query is empty.  Windows are scored on their own, so a document
    of any length goes through a scorer of ``max_length`` tokens.  With a
    budget (a number or a column; null: none) units are taken by score while
    their tokens fit, else those at the threshold or above.
    """
    scored = scorer(plan_windows(df, key, max_length=max_length, cost=cost)).select(*key, "window_start", "window_end", "scores")
    out = assemble(df, scored, key)
    units = F.coalesce("units", F.array().cast("array<string>"))
    over = F.filter(F.transform("unit_scores", lambda s, i: F.when(s >= threshold, i.cast("int")).otherwise(-1)), lambda i: i >= 0)
    if budget is not None:
        room = F.lit(budget) if isinstance(budget, int) else budget
        taken = select_under_budget(F.col("unit_scores"), F.transform(units, cost), F.coalesce(room, F.lit(0)), least)
        over = F.when(room.isNotNull(), taken).otherwise(over)
    out = out.withColumn("kept_ids", over)
    return out.withColumns({"snippet": render(units, F.col("kept_ids"), gap), "compression_ratio": ratio(units, F.col("kept_ids"))})


def validated(df: DataFrame, query: str = "query", units: str = "units") -> tuple[DataFrame, DataFrame]:
    """Requests that can be served, and those rejected: without a query or a document."""
    kind = dict(df.dtypes)[units]
    there = (F.col(units) != "") if kind == "string" else (F.size(units) > 0)
    good = F.coalesce((F.col(query) != "") & there, F.lit(False))
    return df.filter(good), df.filter(~good).withColumn("error", F.lit("query and document are required"))


def token_labels(tokens_: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Tokens (key, k, start, stop) with unit_id and label: 1 in a relevant unit, 0 in another, -1 and -100 outside of all.

    units: key, unit_id, unit_start, unit_end, relevant.  For tokens and units in two
    tables: every token is shuffled once.  ``windows.span_labels`` takes those of one row, where they are.
    """
    from siftline.operators.scoring import interval_join

    spans = units.select(key, "unit_id", "unit_start", "unit_end", F.col("relevant").cast("int").alias("label"))
    out = interval_join(tokens_, spans, key, also=("label",), outside=True)
    return out.withColumns({"unit_id": F.coalesce("unit_id", F.lit(-1)), "label": F.coalesce("label", F.lit(-100))})


def mean_pool(logits: DataFrame, key: list[str], most: int) -> DataFrame:
    """The mean logit of each unit below ``most``; ids below 0 or above are left out, units of ``units`` without any have 0."""
    rows = logits.filter((F.col("unit_id") >= 0) & (F.col("unit_id") < most))
    units = logits.select(*key).distinct().withColumn("unit_id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    means = rows.groupBy(*key, "unit_id").agg(F.avg("logit").alias("logit"))
    return units.join(means, [*key, "unit_id"], "left").withColumn("logit", F.coalesce("logit", F.lit(0.0)))
