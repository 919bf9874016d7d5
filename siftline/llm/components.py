"""Connected components of a table of links, by large-star and small-star steps.

Every round is two shuffles over the links; labels fall to the least node of
a component in about log(n) rounds, whatever its shape.  No component and no
list of links is ever brought together in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the least node it reaches.

    Nulls and loops are left out.  No links: no rows.
    """
    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.expr("xxhash64(u, v) >> 16")), F.sum(F.expr("xxhash64(v, u) >> 16"))).first())

    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} != {b}").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        # large star: the greater neighbours of a node link to its least neighbour (or itself)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        discard(edges)
        edges, last, before = after, before, mark(after)
        if before == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
