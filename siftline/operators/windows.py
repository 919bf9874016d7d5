"""Spans, windows and budgets of units.

The folds over a row's units run in Arrow functions that get numbers alone,
never texts; a fold in SQL would copy its result at every step.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.numbering import numbered, unused
from siftline.sources.shared import kept


# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def body(units: Column) -> Column:
    """Units joined by one space."""
    return F.array_join(units, " ")


def numbers(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column (null: empty, null elements 0) and the n + 1 offsets into them."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    values = np.asarray(pa.compute.fill_null(lists.flatten(), 0))
    return values, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def before(lengths: pa.Array) -> pa.Array:
    """The sum of what is in front of each element."""
    values, offsets = numbers(lengths)
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    own = sums[:-1] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own, pa.int64()))


def spans(units: Column) -> Column:
    """Half-open character spans of the units within their body."""
    starts = before(F.transform(units, lambda u: F.length(u) + 1))
    zipped = F.arrays_zip(starts.alias("at"), units.alias("u"))
    return F.transform(zipped, lambda x: F.struct(x["at"].cast("int").alias("start"), (x["at"] + F.length(x["u"])).cast("int").alias("end")))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _labels(middles: pa.Array, starts: pa.Array, ends: pa.Array, relevant: pa.Array) -> pa.Array:
    points, offsets = numbers(middles)
    begins, at = numbers(starts)
    stops, marks, marked = numbers(ends)[0], *numbers(relevant)
    out = np.empty(len(points), np.int32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        begin, stop, mark = begins[at[k] : at[k + 1]], stops[at[k] : at[k + 1]], marks[marked[k] : marked[k + 1]]
        ids = np.flatnonzero(begin < stop)
        ids = ids[np.argsort(begin[ids], kind="stable")]
        # of disjoint spans the last begun is the only one that can hold a point; -1 where none has begun
        found = np.append(ids, -1)[np.searchsorted(begin[ids], points[a:b], "right") - 1]
        labels = np.full(len(begin) + 1, -100, np.int32)
        labels[: min(len(begin), len(mark))] = mark[: len(begin)]
        out[a:b] = np.where(points[a:b] < np.append(stop, -1)[found], labels[found], -100)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def span_labels(points: Column, units: Column, relevant: Column) -> Column:
    """For every point the label of the unit whose span holds its midpoint: 1 if the unit is relevant, 0 if not, -100 outside of all.

    Points and units are arrays of [start, end) in one row, units disjoint, in
    any order, ``relevant`` has a boolean for each.  Positions aren't negative;
    null arrays are empty, points and units with a null end lie nowhere.
    """
    middles = F.transform(points, lambda p: F.coalesce(F.floor((p["start"] + p["end"]) / 2), F.lit(-1)).cast("long"))
    starts = F.transform(units, lambda u: u["start"].cast("long"))
    ends = F.transform(units, lambda u: F.when(u["start"] < u["end"], u["end"]).otherwise(0).cast("long"))
    return _labels(middles, starts, ends, F.transform(relevant, lambda r: F.coalesce(r.cast("int"), F.lit(-100))))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _windows(lengths: pa.Array, capacity: pa.Array) -> pa.Array:
    values, offsets = numbers(lengths)
    out, room = np.zeros(len(values), np.int32), np.asarray(capacity)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        sums, at, window = np.cumsum(values[a:b], dtype=np.int64), 0, 0
        while at < b - a:
            used = int(sums[at - 1]) if at else 0
            # as many as fit, one at least
            stop = max(at + 1, int(np.searchsorted(sums, used + room[k], "right")))
            out[a + at : a + stop] = window
            at, window = stop, window + 1
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def pack_windows(lengths: Column, capacity: int | Column) -> Column:
    """The window number of every unit, greedily: a window closes when the next unit doesn't fit.

    A unit above the capacity is alone in its window.  The capacity must be
    positive; lengths aren't negative, a null one counts as 0.
    """
    if isinstance(capacity, int) and capacity <= 0:
        raise ValueError("the capacity must be positive")
    return _windows(lengths, (F.lit(capacity) if isinstance(capacity, int) else capacity).cast("long"))


def window_capacity(max_length: int, query_tokens: Column, specials: int = 3, margin: int = 8) -> Column:
    """What a window can hold next to the query; 64 at least."""
    return F.greatest(F.lit(64), F.lit(max_length - specials - margin) - query_tokens)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _taken(scores: pa.Array, costs: pa.Array, budget: pa.Array, least: pa.Array) -> pa.Array:
    values, offsets = numbers(scores)
    prices, at = numbers(costs)
    room, floor, out = np.asarray(budget), np.asarray(least), []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own, price, left, kept = values[a:b], prices[at[k] : at[k + 1]].tolist(), room[k], []
        for i in np.argsort(-own, kind="stable")[: int((own >= floor[k]).sum())].tolist():
            if price[i] <= left:
                left -= price[i]
                kept.append(i)
        out.append(sorted(kept))
    return pa.array(out, pa.list_(pa.int32()))


def select_under_budget(scores: Column, costs: Column, budget: int | Column, least: float = 0.1) -> Column:
    """Ids of units taken by descending score while they fit; those that don't fit are passed over.

    Ties go to the earlier unit; scores under ``least`` are never taken; ids come back in document order.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return _taken(scores, costs, budget.cast("long"), F.lit(float(least)))


def split_words(text: Column, most: int = 250, cut: int = 100) -> Column:
    """Text of more than ``most`` words in parts of ``cut`` words; else the text as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / cut).cast("int")), lambda k: F.array_join(F.slice(words, k * cut + 1, cut), " "))
    return F.when(F.size(words) > most, parts).otherwise(F.array(text))


def reindex(relevant: Column, start: Column, end: Column) -> Column:
    """Relevant ids of a window [start, end), counted from its start."""
    return F.array_sort(F.transform(F.filter(relevant, lambda r: (r >= start) & (r < end)), lambda r: r - start))


def merge_windows(df: DataFrame, key: str, start: str, scores: str) -> DataFrame:
    """One row per key: the scores of its windows one after another."""
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(start, scores))), lambda x: x[scores])).alias(scores))


def length_buckets(df: DataFrame, length: str, capacity: int, order: list[str]) -> DataFrame:
    """Every row with its bucket: lengths of [2**k, 2**(k+1)) share k, so padding stays under half.

    Rows of a bucket can be batched by tasks on their own; nothing is gathered in one place.
    """
    return df.withColumn("bucket", F.floor(F.log2(F.greatest(F.col(length), F.lit(1)))).cast("int")).withColumn("rows_per_batch", F.greatest(F.lit(1), F.floor(capacity / F.pow(2, F.col("bucket") + 1))).cast("int"))


def fill_plan(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple], int]:
    """How rows of each length are filled, for ascending (length, rows) up to the capacity, and the number of batches.

    (length, first, joining, open, start, size): the first ``joining`` rows of a length
    join the batch ``open``, the others make batches of ``size`` from number ``start``; ``first``
    rows are shorter.
    """
    plan, batch, held, first = [], 0, 0, 0
    for length, count in histogram:
        most = capacity // length if length else held + count
        joining = min(count, max(0, most - held)) if held else 0
        size, start = max(1, most), batch + (held > 0)
        plan.append((length, first, joining, batch, start, size))
        first, rest = first + count, count - joining
        if rest:
            batch = start + (rest - 1) // size
            held = rest - (rest - 1) // size * size
        else:
            held += joining
    return plan, batch + (held > 0)


def fill_batches(df: DataFrame, length: str, capacity: int, key: str) -> DataFrame:
    """Rows with their batch, from 0, by the greedy fill of all rows in order of length: longest * rows stays in ``capacity``.

    Rows are taken by ascending length (null counts as 0), ties in the order of
    ``key``; one joins while it fits, and a batch has one row at least.  What a row's
    batch is follows from its length, its number among all rows, and how the
    shorter lengths fill: of each length up to the capacity, so at most
    ``capacity`` of them, the driver gets the number of rows.  Longer rows are alone.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    n, at = unused(df, "__n"), unused(df, "__at")
    rows = numbered(df.withColumn(n, F.coalesce(F.col(length).cast("long"), F.lit(0))), [n, key], at)
    fits = rows.filter(F.col(n) <= capacity)
    plan, total = fill_plan(sorted(tuple(r) for r in fits.groupBy(n).count().collect()), capacity)
    names = [n, "first", "joining", "open", "start", "size"]
    steps = df.sparkSession.createDataFrame(plan, ", ".join(f"`{c}` long" for c in names)).select(n, F.struct(*names[1:]).alias("__p"))
    rank = F.col(at) - F.col("__p.first")
    batch = F.when(F.col("__p").isNull(), F.col(at) - fits.count() + total).when(rank < F.col("__p.joining"), F.col("__p.open")).otherwise(F.col("__p.start") + F.floor((rank - F.col("__p.joining")) / F.col("__p.size")))
    return rows.join(F.broadcast(steps), n, "left").select(*df.columns, batch.alias("batch"))


def sliced(df: DataFrame, group: str, length: str, order: list[str], batch_size: int, max_tokens: int | None) -> DataFrame:
    """Rows with ``slice``: those of a group, by length and order, cut into batches of at most so many rows and longest * rows."""
    dealt = df.repartition(group).sortWithinPartitions(group, length, *order)
    schema, names = df.withColumn("slice", F.lit(0).cast("long")).schema, [*df.columns, "slice"]

    def run(batches):
        now, number, held = None, 0, 0
        for batch in batches:
            out = []
            for g, size in zip(batch.column(group).to_pylist(), batch.column(length).to_pylist(), strict=True):
                if g != now:
                    now, number, held = g, 0, 0
                elif held == batch_size or (max_tokens is not None and (held + 1) * size > max_tokens):
                    number, held = number + 1, 0
                held += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=names)

    return dealt.mapInArrow(run, schema)


def sampler_batches(df: DataFrame, length: str, key: str, *, batch_size: int, bucket_size: int = 50, seed: int = 42, epoch: int = 0, replicas: int = 1, max_tokens: int | None = None, drop_last: bool = False, shuffle: bool = True) -> DataFrame:
    """Rows with (batch, replica, step): shuffled by hash, cut into mega-batches, sorted by length there, cut into batches.

    A mega-batch is ``bucket_size * batch_size`` rows of the shuffled order.  A batch
    has at most ``batch_size`` rows, and with ``max_tokens`` at most so much of longest *
    rows (one row at least).  With ``drop_last`` smaller batches go.  Batches are
    shuffled again and dealt to replicas in turn; those at the end that would give
    some replicas more than others go, with their rows.  Without ``shuffle`` both orders
    are those of ``key``.  A null length counts as 0; keys must be unique.
    """
    n, at, mega = (unused(df, c) for c in ("__n", "__at", "__mega"))
    mixed = lambda *c: F.sha1(F.concat_ws("\0", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(x).cast("string") for x in c)))
    rows = df.withColumn(n, F.coalesce(F.col(length).cast("long"), F.lit(0)))
    rows = numbered(rows.withColumn("__h", mixed(key)), ["__h", key], at).drop("__h") if shuffle else numbered(rows, [key], at)
    rows = rows.withColumn(mega, F.floor(F.col(at) / (bucket_size * batch_size)))
    rows = kept(sliced(rows, mega, n, [at], batch_size, max_tokens), "sliced")
    order = rows.groupBy(mega, "slice").agg(F.count(F.lit(1)).alias("__rows"))
    if drop_last:
        order = order.filter(F.col("__rows") == batch_size)
    order = numbered(order.withColumn("__h", mixed(mega, "slice") if shuffle else F.lit("")), ["__h", mega, "slice"], "batch").drop("__h", "__rows")
    usable = order.count() // replicas * replicas
    out = rows.join(order.filter(F.col("batch") < usable), [mega, "slice"]).select(*df.columns, "batch")
    return out.withColumns({"replica": (F.col("batch") % replicas).cast("int"), "step": F.floor(F.col("batch") / replicas).cast("int")})


def padded(values: Column, to: Column, fill: int) -> Column:
    """An array lengthened to ``to`` elements by ``fill``."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), to - F.size(values)).cast("int")))


def collate(df: DataFrame, batch: list[str], fills: dict[str, int]) -> DataFrame:
    """Array columns padded to the longest of their batch, each with its own fill (ids 0, labels -100, sentence ids -1)."""
    longest = df.groupBy(*batch).agg(*(F.max(F.size(c)).alias(f"__{c}") for c in fills))
    joined = df.join(longest, batch)
    return joined.withColumns({c: padded(F.col(c), F.col(f"__{c}"), v) for c, v in fills.items()}).select(*df.columns)
