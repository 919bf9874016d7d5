"""Token scores to unit decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.ids import ratio, render
from siftline.functions.text import sentences, tokens
from siftline.operators.compression import lexical_scores
from siftline.operators.windows import select_under_budget


#: Characters of a stretch of a document that is joined by itself.
STRETCH = 1 << 16


def interval_join(points: DataFrame, spans: DataFrame, key: str, also: tuple[str, ...] = (), outside: bool = False) -> DataFrame:
    """Points (key, start, stop) with the unit of the same key whose span holds their midpoint.

    Spans are disjoint; points in a gap are dropped, or with ``outside`` kept with a
    null unit, as are those without a key; columns ``also`` of the spans come along.
    Points and starts of spans are put in one order, and the last span begun
    before a point is the only one that can hold it; so a document costs a sort, not a product of
    its tokens and units.  Documents are dealt out in stretches of STRETCH
    characters; a span that goes on into a stretch is begun there again.
    """
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    first, last = F.floor(F.col("unit_start") / STRETCH), F.floor(F.greatest(F.col("unit_end") - 1, F.col("unit_start")) / STRETCH)
    begun = spans.filter("unit_start < unit_end").select(F.col(key).alias("__k"), F.explode(F.sequence(first, last)).alias("__part"), F.struct("unit_id", "unit_end", *also).alias("__span"), F.col("unit_start").alias("__at"))
    rows = points.select(F.col(key).alias("__k"), F.floor(middle / STRETCH).alias("__part"), middle.alias("__at"), F.struct(*points.columns).alias("__row"))
    both = begun.unionByName(rows, allowMissingColumns=True)
    # of a start and a point at one place the start is first
    order = Window.partitionBy("__k", "__part").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__span", F.last("__span", ignorenulls=True).over(order))
    if outside:
        inside = F.col("__k").isNotNull() & (F.col("__at") < F.col("__span.unit_end"))
        held = held.filter("__row IS NOT NULL").withColumn("__span", F.when(inside, F.col("__span")))
    else:
        held = held.filter("__row IS NOT NULL AND __at < __span.unit_end")
    return held.select("__row.*", "__span.unit_id", *(F.col(f"__span.{c}") for c in also))


def pool(units: DataFrame, scored: DataFrame, keys: list[str], token_threshold: float = 0.5, sentence_threshold: float = 0.5) -> DataFrame:
    """For every unit the mean token probability, the share of tokens at the threshold or above, and whether it is kept.

    A unit without tokens scores 0 and is never kept.
    """
    by = scored.groupBy(*keys).agg(F.avg("p").alias("mean"), F.avg((F.col("p") >= token_threshold).cast("double")).alias("score"), F.count(F.lit(1)).alias("n_tokens"))
    out = units.join(by, keys, "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "score": F.coalesce("score", F.lit(0.0)), "n_tokens": F.coalesce("n_tokens", F.lit(0))})
    return out.withColumn("kept", (F.col("n_tokens") > 0) & (F.col("score") >= sentence_threshold))


#: query, unit -> mean probability of the unit; the port of a token scorer.
Scorer = Callable[[Column, Column], Column]


def lexical_scorer(query: Column, unit: Column) -> Column:
    """A stand-in for a model: the share of a unit's tokens that the query has too."""
    words = tokens(unit)
    asked = F.array_distinct(tokens(query))
    hits = F.size(F.filter(words, lambda w: F.array_contains(asked, w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits / F.size(words).cast("double"))


def compress(df: DataFrame, *, query: str = "query", units: str = "units", threshold: float = 0.5, budget: int | None = None, cost: Callable[[Column], Column] | None = None, least: float = 0.1, gap: str | None = "[...]", scorer: Scorer = lexical_scorer) -> DataFrame:
    """Every row with unit scores, kept ids, the snippet and the compression ratio.

    With a budget units are taken by score while they fit; else those at the
    threshold or above.  Rows without a query or units keep nothing.  Where
    ``units`` is a column of strings, its texts are cut into sentences first.
    """
    if dict(df.dtypes)[units] == "string":
        df = df.withColumn(units, sentences(F.col(units)))
    if scorer is lexical_scorer:
        df = lexical_scores(df, query, units, "unit_scores")  # the same, and a row's query is cut into tokens once
    else:
        df = df.withColumn("unit_scores", F.transform(F.coalesce(units, F.array().cast("array<string>")), lambda u: scorer(F.coalesce(F.col(query), F.lit("")), u)))
    if budget is None:
        kept = F.filter(F.transform("unit_scores", lambda s, i: F.when(s >= threshold, i.cast("int")).otherwise(-1)), lambda i: i >= 0)
    else:
        price = cost or (lambda u: F.length(u))
        kept = select_under_budget(F.col("unit_scores"), F.transform(units, price), budget, least)
    df = df.withColumn("kept_ids", kept)
    return df.withColumns({"snippet": render(F.col(units), F.col("kept_ids"), gap), "compression_ratio": ratio(F.col(units), F.col("kept_ids"))})
