"""The library's functions under names of their own in ``spark.sql``.

Scalar functions are SQL functions: Catalyst puts their bodies in place, so a
query over them is planned as one over built-in functions.  Two table functions
run in Python: ``sift_segment`` (a text's units as rows) and ``sift_budget``
(rows of a partition that a budget still pays for).

    sift_plain(text), sift_tokens(text), sift_tokens_each(texts), sift_token_count(text), sift_sentences(text),
    sift_scores(words, unit_tokens), sift_kept(scores, least), sift_render(units, kept), sift_ratio(units, kept),
    sift_segment(text) -> (unit_id, unit),
    sift_budget(TABLE (...) PARTITION BY ... ORDER BY ..., budget) -> the table's columns
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siftline.functions.segment import units
from siftline.functions.text import folding

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def literal(text: str) -> str:
    """A text as an SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies() -> dict[str, str]:
    """Signature and result -> body of each scalar function.

    None calls another, as SQL functions aren't allowed in a lambda; what is
    shared is put together here.
    """
    source, target, many, ranges = folding()
    ascii_only = literal(r"[^\x00-\x7F]")
    several = f"map_from_arrays(split({literal(chr(10).join(many))}, '\\n'), split({literal(chr(10).join(many.values()))}, '\\n'))"

    def plain(text: str) -> str:
        text = f"coalesce({text}, '')"
        spelled = f"array_join(transform(split({text}, ''), c -> coalesce(try_element_at({several}, c), c)), '')"
        wide = f"CASE WHEN {text} RLIKE {literal(ranges)} THEN {spelled} ELSE {text} END"
        return f"lower(CASE WHEN {text} RLIKE {ascii_only} THEN regexp_replace(translate({wide}, {literal(source)}, {literal(target)}), {ascii_only}, '') ELSE {text} END)"

    def tokens(text: str) -> str:
        return f"regexp_extract_all({plain(text)}, '([a-z0-9]+)', 1)"

    words, gap = literal(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), "CASE WHEN p > 0 AND get(kept, p - 1) + 1 != j THEN '[...] ' ELSE '' END"
    cut = "split(regexp_replace(coalesce(text, ''), '([.!?]) ', '$1\\n'), '\\n')"
    share = "CASE WHEN size(t) = 0 OR size(words) = 0 THEN 0.0D ELSE size(filter(t, w -> array_contains(words, w))) / CAST(size(t) AS DOUBLE) END"
    return {
        "sift_plain(text STRING) RETURNS STRING": plain("text"),
        "sift_tokens(text STRING) RETURNS ARRAY<STRING>": tokens("text"),
        "sift_tokens_each(texts ARRAY<STRING>) RETURNS ARRAY<ARRAY<STRING>>": f"transform(texts, u -> {tokens('u')})",
        "sift_token_count(text STRING) RETURNS INT": f"regexp_count(text, {words})",
        "sift_sentences(text STRING) RETURNS ARRAY<STRING>": f"filter(transform({cut}, u -> trim(u)), u -> u != '')",
        "sift_scores(words ARRAY<STRING>, unit_tokens ARRAY<ARRAY<STRING>>) RETURNS ARRAY<DOUBLE>": f"transform(unit_tokens, t -> {share})",
        "sift_kept(scores ARRAY<DOUBLE>, least DOUBLE) RETURNS ARRAY<INT>": "filter(transform(scores, (s, i) -> CASE WHEN s >= least THEN i ELSE -1 END), i -> i >= 0)",
        "sift_render(units ARRAY<STRING>, kept ARRAY<INT>) RETURNS STRING": f"array_join(transform(kept, (j, p) -> concat({gap}, get(units, j))), ' ')",
        "sift_ratio(units ARRAY<STRING>, kept ARRAY<INT>) RETURNS DOUBLE": "aggregate(kept, 0, (s, j) -> s + length(get(units, j))) / CAST(greatest(aggregate(units, 0, (s, u) -> s + length(u)), 1) AS DOUBLE)",
    }


@udtf(returnType="unit_id int, unit string")
class Segment:
    """The units of a text, one a row; a null or blank text has none."""

    def eval(self, text: str):
        yield from enumerate(units(text))


@udtf
class Budget:
    """Rows of a partition, in its order, whose ``cost`` still fits what is left of the budget; the others are passed over.

    A task holds one number a partition, whatever the partition's size.  A row
    without cost is free; without a budget no row fits.
    """

    def __init__(self):
        self.used = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "cost" not in rows.dataType.names:
            raise ValueError("the first argument is a table with a column named cost")
        return AnalyzeResult(schema=rows.dataType)

    def eval(self, rows: Row, budget: int):
        cost = rows["cost"] or 0
        if budget is not None and self.used + cost <= budget:
            self.used += cost
            yield tuple(rows)


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session; doing it again changes nothing."""
    for signature, body in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("sift_segment", Segment)
    spark.udtf.register("sift_budget", Budget)
    return spark
