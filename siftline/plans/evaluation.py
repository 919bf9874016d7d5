"""Evaluation and comparison: provider snippets against gold, labelers and arms against each other, runs against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.ids import render, set_prf
from siftline.operators import metrics
from siftline.operators.assembly import first_seen, truthy


def surfaced_urls(results: DataFrame) -> DataFrame:
    """The distinct URLs of provider results (docs, ord), with the order in which each came up first."""
    urls = results.select("ord", F.posexplode("docs").alias("k", "d")).select("ord", "k", F.col("d.url").alias("url"))
    return urls.filter(truthy(urls, "url")).groupBy("url").agg(F.min(F.struct("ord", "k")).alias("first"))


def surfaced_pairs(results: DataFrame) -> DataFrame:
    """Distinct (query_id, url), with the query text that came first."""
    rows = results.select("query_id", "query", "ord", F.explode("docs").alias("d")).select("query_id", "query", "ord", F.col("d.url").alias("url"))
    return rows.filter(truthy(rows, "url")).groupBy("query_id", "url").agg(F.min_by("query", "ord").alias("query"))


def join_snippets(snippets: Column) -> Column:
    """The snippets that aren't blank, one a line."""
    return F.array_join(F.filter(snippets, lambda x: F.regexp_replace(x, r"\s", "") != ""), "\n")


def last_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key by ``ord``; without that column the greatest by its other simple columns."""
    order = ["ord"] if "ord" in df.columns else [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return first_seen(df, key, order, last=True)


def doc_eval(results: DataFrame, bodies: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Every surfaced document with its body's and gold's state, its intent, and multiset P/R/F1 of its snippets.

    results: provider, query_id, query, intent, docs; bodies: url, status;
    gold: query_id, url, status, gold_unit_ids, gold_text, units; queries: qid,
    intent, which stands in where a result has none or an empty one.  What is
    absent is missing, empty or ''.  Of rows that repeat a key in bodies, gold or
    queries the last one counts, by column ``ord`` where there is one.
    """
    docs = results.select("provider", F.col("query_id").cast("string").alias("query_id"), "query", "intent", F.explode("docs").alias("d"))
    docs = docs.select("provider", "query_id", "query", F.col("intent").alias("__intent"), F.col("d.url").alias("url"), F.col("d.snippets").alias("snippets"))
    bodies, gold, queries = last_rows(bodies, ["url"]), last_rows(gold.withColumn("query_id", F.col("query_id").cast("string")), ["query_id", "url"]), last_rows(queries.withColumn("qid", F.col("qid").cast("string")), ["qid"])
    own = bodies.select("url", F.col("status").alias("body_status"))
    right = gold.select(F.col("query_id").cast("string").alias("query_id"), "url", F.col("status").alias("gold_status"), "gold_unit_ids", "gold_text", "units")
    asked = queries.select(F.col("qid").cast("string").alias("query_id"), F.col("intent").alias("__other"))
    rows = docs.join(own, "url", "left").join(right, ["query_id", "url"], "left").join(asked, "query_id", "left")
    rows = rows.withColumns({
        "intent": F.coalesce(F.nullif(F.col("__intent"), F.lit("")), "__other"), "body_status": F.coalesce("body_status", F.lit("missing")), "gold_status": F.coalesce("gold_status", F.lit("missing")),
        "gold_unit_ids": F.coalesce("gold_unit_ids", F.array().cast("array<int>")), "units": F.coalesce("units", F.array().cast("array<string>")), "gold_text": F.coalesce("gold_text", F.lit("")),
        "snippets": F.coalesce("snippets", F.array().cast("array<string>")),
    }).drop("__intent", "__other")
    rows = rows.withColumns({"pred_text": join_snippets(F.col("snippets")), "has_body": F.col("body_status") == "ok", "has_gold": F.col("gold_status") == "ok"})
    return with_prf(rows, "pred_text", "gold_text")


def with_prf(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Adds n_pred, n_gold, n_overlap, precision, recall and f1 of the texts' tokens, within each row."""
    from siftline.functions.text import tokens

    rows = df.withColumns({"__p": tokens(F.col(predicted)), "__g": tokens(F.col(gold))})
    # equal tokens are numbered by sorting, so that a set intersection counts them as often as both sides have them
    numbered = lambda c: F.expr(f"transform(array_sort({c}), (t, i) -> struct(t AS t, i AS i))")
    first = lambda c: F.expr(f"map_from_entries(filter({c}, (x, i) -> i = 0 OR x.t != get({c}, i - 1).t))")
    rows = rows.withColumns({"__ps": numbered("__p"), "__gs": numbered("__g")})
    rows = rows.withColumns({"__pf": first("__ps"), "__gf": first("__gs")})
    # the length of a token's run is where the next one starts
    ends = lambda s, f: F.expr(f"transform(map_entries({f}), (e, k) -> struct(e.key AS t, coalesce(get(map_values({f}), k + 1), size({s})) - e.value AS n))")
    rows = rows.withColumns({"__pn": F.map_from_entries(ends("__ps", "__pf")), "__gn": F.map_from_entries(ends("__gs", "__gf"))})
    overlap = F.expr("aggregate(map_entries(__pn), 0L, (s, e) -> s + least(e.value, coalesce(try_element_at(__gn, e.key), 0)))")
    rows = rows.withColumns({"n_pred": F.size("__p").cast("long"), "n_gold": F.size("__g").cast("long"), "n_overlap": overlap})
    rows = rows.drop("__p", "__g", "__ps", "__gs", "__pf", "__gf", "__pn", "__gn")
    p, r, f1 = metrics.prf(F.col("n_overlap"), F.col("n_pred"), F.col("n_gold"))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", f1)


def gold_rows(labeled: DataFrame) -> DataFrame:
    """query_id, url, status, gold_unit_ids, gold_text, units of labeled documents; failed ones have no ids."""
    ids = F.coalesce("relevant_unit_ids", F.array().cast("array<int>"))
    return labeled.select("query_id", "url", "status", ids.alias("gold_unit_ids"), render(F.col("units"), ids, None).alias("gold_text"), "units")


def regression(items: DataFrame, current: DataFrame, baseline: DataFrame, queries: DataFrame, documents: DataFrame, order: str = "ord") -> DataFrame:
    """Each item (query_id, doc_id) once, with match: SKIP without a document, OK for equal id sets, else DIFF.

    current and baseline: query_id, doc_id, relevant_unit_ids (of the baseline
    the last of a key counts); an item that isn't in the baseline is DIFF.
    """
    key = ["query_id", "doc_id"]
    last = first_seen(baseline, key, [order], last=True).select(*key, F.lit(True).alias("__in"), F.col("relevant_unit_ids").alias("prior"))
    now = first_seen(current, key, [order], last=True).select(*key, F.col("relevant_unit_ids").alias("now"))
    rows = first_seen(items, key, [order]).select(*key).join(now, key, "left").join(last, key, "left")
    rows = rows.join(queries.select("query_id", "query").dropDuplicates(["query_id"]), "query_id", "left").withColumn("query", F.coalesce("query", F.lit("<unknown>")))
    rows = rows.join(documents.select("doc_id", F.lit(True).alias("__doc")).distinct(), "doc_id", "left")
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<int>"))))
    same = F.col("prior").isNotNull() & (ids("now") == ids("prior"))
    match = F.when(F.col("__doc").isNull(), "SKIP").when(same, "OK").otherwise("DIFF")
    return rows.select("query_id", "doc_id", "query", match.alias("match"), F.col("__in").isNotNull().alias("in_baseline"), F.array_except(ids("now"), ids("prior")).alias("new"), F.array_except(ids("prior"), ids("now")).alias("dropped"))


def regression_counts(diff: DataFrame) -> DataFrame:
    """same, different, skipped and their number."""
    return diff.agg(F.count_if(F.col("match") == "OK").alias("same"), F.count_if(F.col("match") == "DIFF").alias("different"), F.count_if(F.col("match") == "SKIP").alias("skipped"), F.count(F.lit(1)).alias("total"))


def merge_arms(a: DataFrame, b: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of both arms by (query_id as string, doc_id), the last of a key, in the first arm's order: v2_ids, v3_ids, v3_context_ids."""
    key = ["query_id", "doc_id"]
    one, two = (first_seen(x.withColumn("query_id", F.col("query_id").cast("string")), key, [order], last=True) for x in (a, b))
    ids = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<int>")))
    left = one.select(*key, order, "query", "units", F.size("units").alias("n_units"), ids("relevant_unit_ids").alias("v2_ids"), F.col("status").alias("status_a"), F.col("tokens_in").alias("in_a"), F.col("tokens_out").alias("out_a"))
    right = two.select(*key, ids("relevant_unit_ids").alias("v3_ids"), ids("context_unit_ids").alias("v3_context_ids"), F.col("status").alias("status_b"), F.col("tokens_in").alias("in_b"), F.col("tokens_out").alias("out_b"))
    return left.join(right, key)


def arm_report(merged: DataFrame) -> DataFrame:
    """Over pairs that both arms labeled: exact and both-empty pairs, mean Jaccard, mean sizes, context size and expansion, superset violations, tokens."""
    good = (F.col("status_a") == "ok") & (F.col("status_b") == "ok")
    ok = merged.withColumns({"good": good, "m": set_prf(F.col("v2_ids"), F.col("v3_ids"))})
    when = lambda c: F.when(F.col("good"), c)
    context = F.size(F.array_distinct("v3_context_ids"))
    one_sided = (F.size("v2_ids") == 0) != (F.size("v3_ids") == 0)
    return ok.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("good").alias("n_ok"),
        F.count_if(F.col("good") & (F.col("v2_ids") == F.col("v3_ids"))).alias("exact"),
        F.count_if(F.col("good") & (F.size("v2_ids") == 0) & (F.size("v3_ids") == 0)).alias("both_empty"), F.count_if(F.col("good") & one_sided).alias("one_empty"),
        F.round(F.avg(when(F.col("m.jaccard"))), 9).alias("jaccard"), F.round(F.avg(when(F.size("v2_ids").cast("double"))), 9).alias("size_a"), F.round(F.avg(when(F.size("v3_ids").cast("double"))), 9).alias("size_b"),
        F.round(F.avg(when(context.cast("double"))), 9).alias("size_context"), F.round(F.avg(when((context - F.size("v3_ids")).cast("double"))), 9).alias("expansion"),
        F.count_if(F.col("good") & F.col("v3_context_ids").isNotNull() & (F.size(F.array_except("v3_ids", "v3_context_ids")) > 0)).alias("violations"),
        F.coalesce(F.sum(when(F.col("in_a") + F.col("in_b"))), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(when(F.col("out_a") + F.col("out_b"))), F.lit(0)).alias("tokens_out"),
    )


def compare_labelers(gold: DataFrame, predicted: DataFrame, order: str = "ord") -> DataFrame:
    """Rows that both labeled (status ok, ids compared as they are) with precision, recall, f1 and jaccard of their sets."""
    key = ["query_id", "doc_id"]
    one, two = (first_seen(x.filter("status = 'ok'"), key, [order], last=True) for x in (gold, predicted))
    ids = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    both = one.select(*key, ids("relevant_unit_ids").alias("gold_ids")).join(two.select(*key, ids("relevant_unit_ids").alias("pred_ids")), key)
    return both.withColumn("m", set_prf(F.col("pred_ids"), F.col("gold_ids"))).select(*key, "gold_ids", "pred_ids", F.size("pred_ids").cast("long").alias("n_pred"), F.size("gold_ids").cast("long").alias("n_gold"), "m.*")


def labeled_cost(rows: DataFrame, prices: DataFrame, side: str, order: str) -> DataFrame:
    """One row with n_rows, tokens_in, tokens_out and usd, each followed by _``side``.

    Rows with status ok count, of those that repeat a key the last.  The price
    is that of the first row's model (prices: model, price_in, price_out for a
    million tokens); without one it is 0.
    """
    key = ["query_id", "doc_id"]
    good = rows.filter("status = 'ok'").groupBy(*key).agg(F.min(order).alias("first"), F.max_by(F.struct("tokens_in", "tokens_out", "labeler_model"), order).alias("x"))
    tokens = lambda c: F.coalesce(F.sum(f"x.{c}"), F.lit(0)).cast("long")
    total = good.agg(F.count(F.lit(1)).alias("n"), tokens("tokens_in").alias("i"), tokens("tokens_out").alias("o"), F.min_by("x.labeler_model", F.struct("first", *key)).alias("model"))
    rate = lambda c: F.coalesce(c, F.lit(0.0))
    usd = F.round((F.col("i") * rate("price_in") + F.col("o") * rate("price_out")) / 1e6, 9)
    return total.join(prices, "model", "left").select(F.col("n").alias(f"n_rows_{side}"), F.col("i").alias(f"tokens_in_{side}"), F.col("o").alias(f"tokens_out_{side}"), usd.alias(f"usd_{side}"))


def agreement_report(gold: DataFrame, predicted: DataFrame, prices: DataFrame, order: str = "ord") -> DataFrame:
    """How a labeler's rows agree with gold, in one row.

    Over pairs that both labeled: n_shared, exact, both_empty, and empties of one
    side apart (missed: only the prediction is empty; extra: only gold is); mean and median of precision,
    recall, f1 and jaccard; mean, median and maximum of the sets' sizes; f1_buckets, the counts of
    the histogram's six buckets.  Over all rows of each side: rows, tokens
    and cost, and how many times gold's cost the prediction's is in (null where that is 0).
    Medians are exact; the values are ratios of set sizes, of which there are few.  Without a
    shared pair counts are 0 and the rest null.
    """
    both = compare_labelers(gold, predicted, order).withColumns({"g": F.size(F.array_distinct("gold_ids")), "p": F.size(F.array_distinct("pred_ids"))})
    rates, sizes = ("precision", "recall", "f1", "jaccard"), {"g": "gold", "p": "pred"}
    low, high = (0.0, 0.001, 0.25, 0.5, 0.75, 0.999), (0.001, 0.25, 0.5, 0.75, 0.999, 1.0001)
    found = both.agg(
        F.count(F.lit(1)).alias("n_shared"), F.count_if((F.size(F.array_except("gold_ids", "pred_ids")) == 0) & (F.size(F.array_except("pred_ids", "gold_ids")) == 0)).alias("exact"),
        F.count_if((F.col("g") == 0) & (F.col("p") == 0)).alias("both_empty"), F.count_if((F.col("g") > 0) & (F.col("p") == 0)).alias("missed"), F.count_if((F.col("g") == 0) & (F.col("p") > 0)).alias("extra"),
        *(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in rates), *(F.round(F.percentile(c, F.lit(0.5)), 9).alias(f"median_{c}") for c in rates),
        *(F.round(F.avg(F.col(c).cast("double")), 9).alias(f"mean_size_{s}") for c, s in sizes.items()), *(F.percentile(c, F.lit(0.5)).alias(f"median_size_{s}") for c, s in sizes.items()), *(F.max(c).alias(f"max_size_{s}") for c, s in sizes.items()),
        F.array(*(F.count_if((F.col("f1") >= a) & (F.col("f1") < b)) for a, b in zip(low, high, strict=True))).alias("f1_buckets"),
    )
    # three tables of one row each
    one = F.lit(1).alias("__one")
    whole = found.select("*", one).join(labeled_cost(gold, prices, "gold", order).select("*", one), "__one").join(labeled_cost(predicted, prices, "pred", order).select("*", one), "__one").drop("__one")
    return whole.withColumn("usd_ratio", F.when(F.col("usd_pred") > 0, F.round(F.col("usd_gold") / F.col("usd_pred"), 9)))


def predict_rows(units: DataFrame, max_length: int) -> DataFrame:
    """Rows (key columns, n_tokens, means, scores) within ``max_length`` with predicted ids and scores rounded half to even."""
    rows = units.filter(F.col("n_tokens") <= max_length)
    return rows.withColumns({"predicted_unit_ids": F.filter(F.transform("scores", lambda s, i: F.when(s >= 0.5, i.cast("int")).otherwise(-1)), lambda i: i >= 0), "unit_scores": F.transform("means", lambda m: F.bround(m, 4))})


def nearest_rank(values: Column, q: float) -> Column:
    """The element at round(q * (n - 1)), half to even, of a sorted array; null of an empty one."""
    return F.get(values, F.bround(F.lit(q) * (F.size(values) - 1)).cast("int"))


def latency_stats(df: DataFrame, seconds: str, tokens_: str, groups: list[str] | None = None) -> DataFrame:
    """n, mean, median, p90, p99, min, max and tokens a second, over all rows or by group.

    The nearest rank is read from the counts of distinct values, so no group
    has to be in one place; ``seconds`` should be rounded to what is measured.
    """
    by = groups or []
    counted = df.groupBy(*by, seconds).agg(F.count(F.lit(1)).alias("c"), F.sum(tokens_).alias("t"))
    lists = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(seconds).alias("v"), F.col("c").alias("c"), F.col("t").alias("t")))).alias("x"))
    lists = lists.withColumns({"n": F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e["c"]), "total": F.aggregate("x", F.lit(0.0), lambda s, e: s + e["v"] * e["c"]), "tokens": F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e["t"])})

    def rank(q: float) -> Column:
        at = F.bround(F.lit(q) * (F.col("n") - 1)).cast("long")
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda s, e: F.struct((s["seen"] + e["c"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + e["c"] > at, e["v"])).alias("v"))
        return F.aggregate("x", start, step, lambda s: s["v"])

    return lists.select(
        *by, "n", F.round(F.col("total") / F.col("n"), 9).alias("mean"), rank(0.5).alias("median"), rank(0.9).alias("p90"), rank(0.99).alias("p99"),
        F.array_min(F.transform("x", lambda e: e["v"])).alias("min"), F.array_max(F.transform("x", lambda e: e["v"])).alias("max"), F.round(F.col("tokens") / F.greatest(F.col("total"), F.lit(1e-9)), 6).alias("tokens_per_s"),
    )


def length_stats(df: DataFrame, length: str, groups: list[str] | None = None) -> DataFrame:
    """Exact median, maximum and mean of a length."""
    return df.groupBy(*(groups or [])).agg(F.percentile(length, F.lit(0.5)).alias("median"), F.max(length).alias("max"), F.round(F.avg(length), 9).alias("mean"))


def token_rates(df: DataFrame, logit: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall, f1, accuracy and share of positives at logit > 0 over labels other than -100, by group if asked."""
    rows = df.filter(F.col(label) != -100)
    hit, y = F.col(logit) > 0, F.col(label) == 1
    by = rows.groupBy(*(groups or [])).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double"), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)).cast("double")
    n = F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1)).cast("double")
    by = by.withColumns({"precision": p, "recall": r, "accuracy": (F.col("tp") + F.col("tn")) / n, "pos_frac": (F.col("tp") + F.col("fn")) / n})
    return by.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def label_counters(df: DataFrame, seconds: Column | None = None) -> DataFrame:
    """labeled, tokens in and out, and how many a second if a time is given."""
    out = df.agg(F.count_if(F.col("status") == "ok").alias("labeled"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return out if seconds is None else out.withColumns({f"{c}_per_s": F.col(c) / F.greatest(seconds, F.lit(1e-9)) for c in ("labeled", "tokens_in", "tokens_out")})
