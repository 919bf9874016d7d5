"""Dense numbers for the rows of a table in an order, without one task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.sources.shared import kept


def unused(df: DataFrame, name: str, *others: str) -> str:
    """A column name that ``df`` has in no spelling of upper and lower case, and that isn't among ``others``."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Every row with its place in the order of the columns ``order``, from 0 without gaps.

    Rows are dealt out by ranges of the order, sorted there and written; a
    part's first number is the sum of the counts of the parts in front, of
    which the driver gets one row a part.  Rows that tie in all of ``order`` are
    numbered in any order, the same one at every reading.
    """
    at, part, first = (unused(df, n, out) for n in ("__at", "__part", "__first"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(ranged.withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))  # the id is made of the part and the row's place there
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())
    starts = accumulate((n for _, n in counts), initial=0)
    firsts = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], f"{part} long, {first} long")
    placed = rows.join(F.broadcast(firsts), part)
    return placed.withColumn(out, F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, first)
