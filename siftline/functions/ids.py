"""Functions on arrays of unit ids, and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(ids: Column, n: Column) -> Column:
    """The ids from 0 to n - 1."""
    return F.filter(ids, lambda i: (i >= 0) & (i < n))


def merge_anchor(ids: Column, anchor: Column, n: Column) -> Column:
    """Valid ids, with the anchor if it is valid and any id is; sorted, distinct."""
    valid = in_range(F.coalesce(ids, F.array().cast("array<int>")), n)
    add = (F.size(valid) > 0) & (anchor >= 0) & (anchor < n)
    return F.array_sort(F.array_distinct(F.when(add, F.concat(valid, F.array(anchor))).otherwise(valid)))


def superset(context: Column, relevant: Column) -> Column:
    """The union, sorted: a context always holds what is relevant."""
    return F.array_sort(F.array_union(context, relevant))


def set_prf(predicted: Column, gold: Column) -> Column:
    """precision, recall, f1 and jaccard of two id sets; both empty is 1, one empty side gives 1 and 0."""
    both = F.size(F.array_intersect(predicted, gold)).cast("double")
    p_n, g_n = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    precision = F.when(p_n == 0, 1.0).otherwise(both / p_n)
    recall = F.when(g_n == 0, 1.0).otherwise(both / g_n)
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)).alias("f1"),
        F.when((p_n == 0) & (g_n == 0), 1.0).otherwise(both / F.size(F.array_union(predicted, gold))).alias("jaccard"),
    )


def render(units: Column, kept: Column, gap: str | None = "[...]") -> Column:
    """Kept units joined by spaces; a gap mark between units that weren't neighbours (none: no mark)."""
    if gap is None:
        return F.array_join(F.transform(kept, lambda j: F.get(units, j)), " ")
    mark = lambda j, p: (p > 0) & (F.get(kept, (p - 1).cast("int")) + 1 != j)
    return F.array_join(F.transform(kept, lambda j, p: F.when(mark(j, p), F.concat(F.lit(gap + " "), F.get(units, j))).otherwise(F.get(units, j))), " ")


def ratio(units: Column, kept: Column) -> Column:
    """Characters kept of all characters; 0 for no units."""
    total = F.aggregate(units, F.lit(0), lambda s, u: s + F.length(u))
    chosen = F.aggregate(kept, F.lit(0), lambda s, j: s + F.length(F.get(units, j)))
    return chosen / F.greatest(total, F.lit(1)).cast("double")


def prompt(query: Column, units: Column) -> Column:
    """What a labeler is asked: the query, then the numbered units."""
    lines = F.transform(units, lambda u, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), u))
    return F.concat(F.lit("QUERY:\n"), query, F.lit("\n\nDOCUMENT UNITS:\n"), F.array_join(lines, "\n"))
