"""Fragments aligned to units by shared five-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import plain, shingles, tokens
from siftline.operators.heads import containing
from siftline.sources.shared import small


def overlap(fragments: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """Shared shingles of every fragment and unit with equal ``key``: (key, frag_id, unit_id, n).

    An equi-join on (key, shingle) and a count, so only pairs that share a
    shingle are ever formed.
    """
    f = fragments.select(*key, "frag_id", F.explode(shingles(tokens(F.col("fragment")))).alias("g"))
    u = units.select(*key, "unit_id", F.explode(shingles(tokens(F.col("unit")))).alias("g"))
    return f.join(u, [*key, "g"]).groupBy(*key, "frag_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))


def ranking(n: str, common: str, of: Column) -> Column:
    """The units that share shingles with a fragment, by descending overlap, ties by position; ``of`` is the unit's number of shingles."""
    return F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("k"), F.col("unit_id").alias("u"), F.col(common).alias("common"), (F.col(n) / of).alias("share")))).alias("ranked")


def choose(strong: float, cover: float, ranked: Column | None = None, size: Column | None = None) -> Column:
    """Of the ``ranked`` units (a column's, if not given) the strong ones, and those of the greedy cover where it reaches its share of ``size``."""
    ranked, size = F.col("ranked") if ranked is None else ranked, F.col("size") if size is None else size
    start = F.struct(F.array().cast("array<string>").alias("got"), F.array().cast("array<int>").alias("ids"))

    def step(s, x):
        open_ = F.size(s["got"]) < F.lit(cover) * size
        brings = open_ & (F.size(F.array_except(x["common"], s["got"])) > 0)
        return F.struct(F.when(brings, F.array_union(s["got"], x["common"])).otherwise(s["got"]).alias("got"), F.when(brings, F.concat(s["ids"], F.array(x["u"].cast("int")))).otherwise(s["ids"]).alias("ids"))

    def finish(s):
        return F.when(F.size(s["got"]) >= F.lit(cover) * size, s["ids"]).otherwise(F.array().cast("array<int>"))

    strong_ids = F.transform(F.filter(ranked, lambda x: x["share"] >= strong), lambda x: x["u"].cast("int"))
    return F.array_union(strong_ids, F.aggregate(ranked, start, step, finish))


def align(fragments: DataFrame, units: DataFrame, key: list[str], strong: float = 0.5, cover: float = 0.5, least: int = 6, prefix: int = 80) -> DataFrame:
    """(key, unit_ids, n_fragments, n_matched): the units that the fragments of each key come from.

    Units that share half their shingles with a fragment are taken.  Besides,
    units are taken by descending overlap (ties by position) while they bring
    new shingles, until half of the fragment is covered; if that is never
    reached these don't count.  A fragment that shares nothing takes the first
    unit that contains its start.  Fragments of under six tokens are ignored
    but counted.
    """
    words = fragments.withColumn("g", shingles(tokens(F.col("fragment")))).filter(F.size(tokens(F.col("fragment"))) >= least)
    own = units.withColumn("ug", shingles(tokens(F.col("unit"))))
    hits = overlap(words.select(*key, "frag_id", "fragment"), units, key)
    rows = hits.join(words.select(*key, "frag_id", "g"), [*key, "frag_id"]).join(own.select(*key, "unit_id", "ug"), [*key, "unit_id"])
    rows = rows.withColumn("common", F.array_intersect("g", "ug"))
    grouped = rows.groupBy(*key, "frag_id").agg(F.max(F.size("g")).alias("size"), ranking("n", "common", F.size("ug")))
    chosen = grouped.select(*key, "frag_id", choose(strong, cover).alias("ids"))
    rest = words.join(hits.select(*key, "frag_id").distinct(), [*key, "frag_id"], "left_anti")
    held = rest.join(units, key).filter(F.contains(plain(F.col("unit")), F.substring(plain(F.col("fragment")), 1, prefix)))
    fallback = held.groupBy(*key, "frag_id").agg(F.array(F.min("unit_id").cast("int")).alias("ids"))
    found = chosen.union(fallback).groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("unit_ids"), F.count_if(F.size("ids") > 0).alias("n_matched"))
    counts = fragments.groupBy(*key).agg(F.count(F.lit(1)).alias("n_fragments"))
    out = counts.join(found, key, "left")
    return out.select(*key, F.coalesce("unit_ids", F.array().cast("array<int>")).alias("unit_ids"), "n_fragments", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def align_across(fragments: DataFrame, units: DataFrame, item: str, doc: str, strong: float = 0.5, cover: float = 0.5, least: int = 6, prefix: int = 80) -> DataFrame:
    """(item, doc, unit_ids, n_fragments, n_matched): ``align`` of each item's fragments to each document's units, for the pairs in which a fragment matches.

    Only pairs that share a shingle are formed, and the units' shingles stay
    where they are if those of the fragments are few enough for a broadcast.  A
    start that holds five whole tokens inside shares a shingle with each unit
    that contains it, so only fragments with fewer are searched for by their
    start, all of them in one pass over the units.
    """
    words = fragments.withColumn("t", tokens(F.col("fragment"))).filter(F.size("t") >= least).select(item, "frag_id", shingles(F.col("t")).alias("g"), F.substring(plain(F.col("fragment")), 1, prefix).alias("head"))
    sought = words.select(item, "frag_id", F.size("g").alias("size"), "g").select(item, "frag_id", "size", F.explode_outer("g").alias("g"))
    # one column at a time: nested, the tokens would be found again for each shingle, and the array go with each of its elements;
    # a plain explode would bring the nested form back in a filter for size
    own = units.select(doc, "unit_id", tokens(F.col("unit")).alias("t")).select(doc, "unit_id", shingles(F.col("t")).alias("ug"))
    own = own.select(doc, "unit_id", F.size("ug").alias("of"), "ug").select(doc, "unit_id", "of", F.explode_outer("ug").alias("g"))
    hits = own.join(small(sought), "g").groupBy(item, doc, "frag_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("g").alias("common"), F.max("of").alias("of"), F.max("size").alias("size"))
    inside = F.size(F.regexp_extract_all("head", F.lit("(?<=[^a-z0-9])([a-z0-9]+)(?=[^a-z0-9])"), F.lit(1)))
    rest = words.filter(inside < 5).select(item, "frag_id", "head")
    held = containing(units.select(doc, "unit_id", plain(F.col("unit")).alias("plain")), "plain", rest, "head").join(small(rest), "head")
    held = held.select(item, doc, "frag_id", "unit_id", F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("common"), F.lit(1).alias("of"), F.lit(0).alias("size"))
    grouped = hits.unionByName(held).groupBy(item, doc, "frag_id").agg(F.max("size").alias("size"), F.min("unit_id").alias("first"), ranking("n", "common", F.col("of")))
    ids = F.when(F.col("size") == 0, F.array(F.col("first").cast("int"))).otherwise(choose(strong, cover))
    found = grouped.select(item, doc, ids.alias("ids")).filter(F.size("ids") > 0)
    found = found.groupBy(item, doc).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("unit_ids"), F.count(F.lit(1)).alias("n_matched"))
    counts = fragments.groupBy(item).agg(F.count(F.lit(1)).alias("n_fragments"))
    return found.join(small(counts), item).select(item, doc, "unit_ids", "n_fragments", "n_matched")


def align_rows(df: DataFrame, fragments: str, units: str, strong: float = 0.5, cover: float = 0.5, least: int = 6, prefix: int = 80) -> DataFrame:
    """``df`` with unit_ids, n_fragments and n_matched: ``align`` where fragments and units are two arrays of one row.

    Nothing is shuffled and no row is looked up, so ids may repeat and a hot
    key costs nothing; a row costs its fragments times its units.  Null arrays
    are empty ones.
    """
    none = F.array().cast("array<string>")
    rows = df.withColumns({"__f": F.coalesce(fragments, none), "__p": F.transform(F.coalesce(units, none), plain)})
    words = lambda p: F.regexp_extract_all(p, F.lit("([a-z0-9]+)"), F.lit(1))
    rows = rows.withColumn("__g", F.transform(F.transform("__p", words), lambda t: shingles(t)))
    asked = F.transform(F.transform("__f", plain), lambda p: F.struct(p.alias("p"), words(p).alias("t")))
    asked = F.transform(F.filter(asked, lambda x: F.size(x["t"]) >= least), lambda x: F.struct(F.substring(x["p"], 1, prefix).alias("head"), shingles(x["t"]).alias("g")))

    def of_units(x):
        common = F.transform("__g", lambda g: F.struct(F.array_intersect(x["g"], g).alias("common"), F.size(g).alias("of")))
        hits = F.transform(common, lambda y, i: F.struct((-F.size(y["common"])).alias("k"), i.alias("u"), y["common"].alias("common"), (F.size(y["common"]) / F.greatest(y["of"], F.lit(1))).alias("share")))
        return F.struct(F.size(x["g"]).alias("size"), x["head"].alias("head"), F.array_sort(F.filter(hits, lambda y: y["k"] < 0)).alias("ranked"))

    def ids(x):
        first = F.slice(F.filter(F.transform("__p", lambda p, i: F.when(F.contains(p, x["head"]), i.cast("int"))), lambda i: i.isNotNull()), 1, 1)
        return F.when(F.size(x["ranked"]) == 0, first).otherwise(choose(strong, cover, x["ranked"], x["size"]))

    # sizes are asked for as well: a column that is used twice is worked out before a lambda, not again in each of its steps
    some = (F.size("__p") > 0) & (F.size("__g") > 0)
    rows = rows.withColumn("__ids", F.when(some, F.transform(F.transform(asked, of_units), ids)).otherwise(F.array().cast("array<array<int>>")))
    found = F.array_sort(F.array_distinct(F.flatten("__ids")))
    rows = rows.withColumns({"unit_ids": found, "n_fragments": F.size("__f"), "n_matched": F.size(F.filter("__ids", lambda x: F.size(x) > 0))})
    return rows.drop("__f", "__p", "__g", "__ids")
