"""Precision, recall, agreement and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import tokens
from siftline.operators.numbering import numbered
from siftline.sources.shared import small


def prf(both: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Both sides empty: 1, 1, 1; nothing predicted: 1, 0, 0; no gold: 0, 1, 0."""
    precision = F.when(predicted == 0, 1.0).when(gold == 0, 0.0).otherwise(both / predicted.cast("double"))
    recall = F.when(gold == 0, 1.0).when(predicted == 0, 0.0).otherwise(both / gold.cast("double"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return precision, recall, f1


def token_prf(df: DataFrame, key: list[str], predicted: str, gold: str) -> DataFrame:
    """Multiset precision, recall and F1 of tokens for every row.

    The overlap is the sum over tokens of the lesser count: each side is
    counted by (key, token), the two are joined, and rows without any shared
    token keep an overlap of 0.
    """
    both = df.select(*key, tokens(F.col(predicted)).alias("__p"), tokens(F.col(gold)).alias("__g"))
    sizes = both.select(*key, F.size("__p").cast("long").alias("n_pred"), F.size("__g").cast("long").alias("n_gold"))
    side = both.select(*key, F.explode(F.concat(F.transform("__p", lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"), F.lit(0).alias("g"))), F.transform("__g", lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"), F.lit(1).alias("g"))))).alias("x"))
    counts = side.groupBy(*key, F.col("x.t").alias("t")).agg(F.sum("x.p").alias("p"), F.sum("x.g").alias("g"))
    overlap = counts.groupBy(*key).agg(F.sum(F.least("p", "g")).alias("n_overlap"))
    out = sizes.join(overlap, key, "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)).cast("long"))
    p, r, f1 = prf(F.col("n_overlap"), F.col("n_pred"), F.col("n_gold"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", f1)


def summary(df: DataFrame, provider: str, intent: str) -> DataFrame:
    """Counts, means and exact medians by provider, and by provider and intent, in one grouping-sets aggregate.

    Rows with gold are scored; n_no_gold has a body and no gold, n_gold_empty is
    scored with nothing in its gold.  A null or empty intent is '?'.
    """
    df = df.withColumn(intent, F.coalesce(F.nullif(F.col(intent), F.lit("")), F.lit("?")))
    grouped = df.groupingSets([[provider], [provider, intent]], provider, intent)
    scored = F.col("has_gold")
    return grouped.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(~F.col("has_body")).alias("n_no_body"),
        F.count_if(F.col("has_body") & ~scored).alias("n_no_gold"),
        F.count_if(scored & (F.col("n_gold") == 0)).alias("n_gold_empty"),
        *(F.coalesce(F.round(F.avg(F.when(scored, F.col(c))), 9), F.lit(float("nan"))).alias(c) for c in ("precision", "recall", "f1")),
        F.percentile(F.when(scored, F.col("n_pred")), F.lit(0.5)).alias("median_pred"),
        F.percentile(F.when(scored, F.col("n_gold")), F.lit(0.5)).alias("median_gold"),
    )


def auc(df: DataFrame, group: str, score: str, label: str, tie: str) -> DataFrame:
    """Mann-Whitney AUC of each group with both labels, from ordinal ranks (ties in the order of ``tie``).

    Ranks are dense numbers of all rows by (group, score, tie), less their
    group's first, so no task has a group to itself.
    """
    y = F.col(label).cast("long")
    rows = numbered(df.select(group, F.col(score).alias("__s"), F.col(tie).alias("__t"), y.alias("__y")), [group, "__s", "__t"], "__n")
    by = rows.groupBy(group).agg(F.sum("__y").alias("n_pos"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__y") == 1, F.col("__n")).otherwise(0)).alias("numbers"), F.min("__n").alias("first"))
    ranks = F.col("numbers") - F.col("n_pos") * (F.col("first") - 1)
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return by.filter("n_pos > 0 AND n_pos < n").select(group, ((ranks - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def ranked_in_groups(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Rows with their rank from 1 in the order within their group, by dense numbers of all rows."""
    rows = numbered(df, [group, *order], out)
    firsts = rows.groupBy(F.col(group).alias("__g")).agg(F.min(out).alias("__first"))
    return rows.join(small(firsts), F.col(group).eqNullSafe(F.col("__g"))).withColumn(out, F.col(out) - F.col("__first") + 1).drop("__g", "__first")


def recall_at_relevant(df: DataFrame, group: str, score: str, label: str, tie: str) -> DataFrame:
    """Of each group's relevant rows the share among as many best scored rows."""
    rows = df.select(group, (-F.col(score)).alias("__s"), F.col(tie).alias("__t"), F.col(label).cast("long").alias("__y"))
    rows = ranked_in_groups(rows, group, ["__s", "__t"], "__r")
    wanted = rows.groupBy(F.col(group).alias("__w")).agg(F.sum("__y").alias("__k")).filter("__k > 0")
    hits = rows.join(small(wanted), F.col(group).eqNullSafe(F.col("__w")))
    return hits.groupBy(group).agg((F.sum(F.when(F.col("__r") <= F.col("__k"), F.col("__y")).otherwise(0)) / F.max("__k").cast("double")).alias("recall"))


#: Values of a threshold, token's or sentence's, that a sweep takes; they go along with the tasks.
VALUES = 10_000


def _values(pairs: DataFrame, column: str) -> list[float]:
    found = [r[0] for r in pairs.select(F.col(column).cast("double")).distinct().limit(VALUES + 1).collect()]
    if len(found) > VALUES:
        raise ValueError(f"more than {VALUES} values of {column}")
    return sorted(found)


def _reached(value: Column, ascending: list[float]) -> Column:
    """How many of the numbers are at most the value."""
    numbers = F.array(*map(F.lit, ascending))
    return F.size(F.filter(numbers, lambda t: t <= value))


def sweep(units: DataFrame, scored: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall, F1 and keep rate over units for every pair (token_threshold, sentence_threshold).

    units: keys, label; scored: keys and the probability p of each token.  A
    unit is kept where the share of its tokens at the token threshold or above
    reaches the sentence threshold; one without tokens never is.  Tokens are
    counted by the thresholds they reach, units by those their share reaches,
    and the sums over these two histograms give all pairs: a unit is a row for
    each token threshold, not for each pair.  Pairs with a null, and a sweep
    over no units, give no rows; more than VALUES values of one threshold raise.
    """
    pair = ["token_threshold", "sentence_threshold"]
    pairs = thresholds.select(*(F.col(c).cast("double").alias(c) for c in pair)).dropna().distinct()
    token, sentence = (_values(pairs, c) for c in pair)
    if not token:
        token = sentence = [0.0]  # no pairs: nothing is left of the sums below
    by = scored.filter("p IS NOT NULL").groupBy(*keys, _reached(F.col("p"), token).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    by = by.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.collect_list(F.struct("__b", "__c")).alias("__bs"))
    above = lambda i: F.aggregate(F.filter("__bs", lambda x: x["__b"] > i), F.lit(0).cast("long"), lambda s, x: s + x["__c"])
    shares = F.transform(F.sequence(F.lit(0), F.lit(len(token) - 1)), lambda i: above(i) / F.col("__n").cast("double"))
    rows = units.join(by, keys).select((F.col("label") == 1).alias("y"), F.posexplode(shares).alias("i", "share"))
    reached = rows.groupBy("i", _reached(F.col("share"), sentence).alias("at")).agg(F.count_if("y").alias("tp"), F.count_if(~F.col("y")).alias("fp"))
    asked = pairs.select(*pair, (_reached(F.col("token_threshold"), token) - 1).alias("i"), _reached(F.col("sentence_threshold"), sentence).alias("at"))
    # of one token threshold all units whose share reaches as many sentence thresholds or more
    order = Window.partitionBy("i").orderBy(F.desc("at"))
    summed = asked.unionByName(reached, allowMissingColumns=True)
    summed = summed.withColumns({c: F.coalesce(F.sum(c).over(order), F.lit(0)) for c in ("tp", "fp")}).filter("token_threshold IS NOT NULL")
    whole = units.agg(F.count_if(F.col("label") == 1).alias("relevant"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    by = summed.join(F.broadcast(whole)).select(*pair, "tp", "fp", (F.col("relevant") - F.col("tp")).alias("fn"), "n")  # one row on that side
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double"), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)).cast("double")
    by = by.withColumns({"precision": p, "recall": r, "keep_rate": (F.col("tp") + F.col("fp")) / F.col("n").cast("double")})
    return by.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def confusion(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Token-level counts and rates at logit > 0; labels of -100 are ignored."""
    kept = df.filter(F.col(label) != -100)
    hit, y = F.col(logit) > 0, F.col(label) == 1
    return kept.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"), F.round(F.avg(y.cast("double")), 9).alias("pos_frac"), F.round(F.avg((hit == y).cast("double")), 9).alias("accuracy"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in six buckets: exactly 0, up to .25, .5, .75, below 1, exactly 1."""
    c = F.col(value)
    bucket = F.when(c == 0, "0").when(c < 0.25, "(0,.25)").when(c < 0.5, "[.25,.5)").when(c < 0.75, "[.5,.75)").when(c < 1, "[.75,1)").otherwise("1")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def worst(df: DataFrame, k: int, key: str) -> DataFrame:
    """The k rows of least F1, the greater difference in size first among equals."""
    return df.orderBy("f1", F.desc(F.abs(F.col("n_pred") - F.col("n_gold"))), key).limit(k)


def agreement(df: DataFrame) -> DataFrame:
    """How two arms of id sets a and b agree: counts, mean Jaccard, mean sizes, superset violations."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.array_sort("a") == F.array_sort("b")).alias("exact"),
        F.count_if((F.size("a") == 0) & (F.size("b") == 0)).alias("both_empty"),
        F.round(F.avg("jaccard"), 9).alias("jaccard"),
        F.round(F.avg(F.size("a").cast("double")), 9).alias("size_a"),
        F.round(F.avg(F.size("b").cast("double")), 9).alias("size_b"),
        F.count_if(F.size(F.array_except("b", "a")) > 0).alias("violations"),
    )


def cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model; models without a price cost 0."""
    by = df.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    spent = F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))
    return by.join(prices, "model", "left").select("model", "tokens_in", "tokens_out", F.round(spent / 1e6, 9).alias("cost"))


def assign_split(key: Column, val: float = 0.05, test: float = 0.05) -> Column:
    """train, val or test by the first eight digest bytes of the key as a fraction of 2**64."""
    x = F.conv(F.substring(F.sha1(key), 1, 16), 16, 10).cast("double") / 18446744073709551616.0
    return F.when(x < test, "test").when(x < test + val, "val").otherwise("train")
