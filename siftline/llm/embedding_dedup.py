"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors of a label are one class from the start.
2. A pass hashes every vector to the signs of its products with random planes,
   one after another in one key, and orders each label's vectors by that key.
   A vector is compared with the ``window`` vectors in front of it, in double
   precision.  Where the window ends follows from dense numbers of the order, not
   from how Spark deals rows out.  Verified pairs of all passes are united to
   components; a task hands on a tree of what it links, not all pairs.
3. The number of passes follows from the size of the largest label, so that a
   pair at the threshold itself comes into some window with chance ``recall``.
4. Links are then counted within components, over all members and not only
   those that met in a window.  A component of at most ``tile`` classes is one matrix
   in a task.  In a larger one, members within half the threshold's angle of its mean
   are linked to each other by the triangle inequality; they are counted without
   comparing, and only the others meet all members, tile by tile.  So a large group
   of near copies costs as much as it has members.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow
from siftline.llm.components import components
from siftline.llm.storage import discard, written
from siftline.operators.numbering import numbered

#: Classes, and components, that are broadcast at most.
FEW = 100_000


@dataclass(frozen=True)
class Search:
    """Threshold of the cosine; neighbours of a vector; chance that a pair at the threshold is met; rows of a block; members of a tile."""

    threshold: float = 0.93
    window: int = 128
    recall: float = 0.999
    seed: int = 0
    block: int = 4096
    tile: int = 2048
    passes_at_once: int = 4

    def __post_init__(self):
        if not (0 < self.threshold <= 1 and 0 < self.recall < 1 and 0 < self.window <= self.block):
            raise ValueError("threshold and recall lie between 0 and 1, and a block holds a window at least")

    @property
    def angle(self) -> float:
        return math.acos(self.threshold)


def n_passes(largest: int, how: Search) -> int:
    """Passes for labels of at most ``largest`` vectors.

    Vectors at the threshold's angle agree in a sign with chance p, and in the
    first d signs with p ** d; d signs split a label into parts of about a window.
    """
    depth = max(0.0, math.log2(max(largest, 1) / how.window))
    met = (1 - how.angle / math.pi) ** depth
    return 1 if met >= 1 else max(1, math.ceil(math.log(1 - how.recall) / math.log(1 - met)))


def unit_rows(column: pa.Array, start: int, stop: int) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision."""
    part = column.slice(start, stop - start)
    x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(stop - start, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is beyond the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the stretches in which no column changes."""
    n = len(columns[0])
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    at = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(at[:-1], at[1:], strict=True))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def classes(rows: DataFrame) -> DataFrame:
    """(node, label, vec, least, m, h1, h2): each distinct vector of a label once, with its least id and its number of rows; written."""
    found = rows.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "label", "vec", "least", "m", *hashes()), "classes")


def hashes() -> list:
    return [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]


def keys(vectors: DataFrame, first: int, stop: int, how: Search) -> DataFrame:
    """(pass, label, dim, key, node): the signs of 64 random projections for each of the passes, as a number that sorts like them."""

    def run(batches):
        planes: dict[tuple, np.ndarray] = {}
        weights = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))
        for batch in batches:
            dims = ints(batch, "dim")
            for start, stop_ in runs(dims):
                dim, x = int(dims[start]), unit_rows(batch.column("vec"), start, stop_)
                part = batch.slice(start, stop_ - start)
                for k in range(first, stop):
                    if (dim, k) not in planes:
                        planes[dim, k] = np.random.default_rng([how.seed, k, dim]).standard_normal((dim, 64))
                    signs = (x @ planes[dim, k]) > 0
                    key = (signs * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), part.column("label"), part.column("dim"), pa.array(key.view(np.int64)), part.column("node")], names=["pass", "label", "dim", "key", "node"])

    return map_arrow(vectors.select("node", "label", F.size("vec").alias("dim"), "vec"), run, "pass int, label string, dim int, key long, node long")


def trees(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, for links between n nodes."""
    top = np.arange(n)
    while True:
        before = top.copy()
        low = np.minimum(top[a], top[b])
        np.minimum.at(top, a, low)
        np.minimum.at(top, b, low)
        top = top[top]
        if (top == before).all():
            return top


def window_links(rows: DataFrame, how: Search) -> DataFrame:
    """(a, b): trees of the pairs of at least the threshold among each row and the window in front of it.

    rows: block, number, pass, label, dim, node, vec; those at the end of a block come to the next one too.
    """
    dealt = rows.repartition("block").sortWithinPartitions("block", "number")

    def run(batches):
        key, tail, tail_nodes = None, None, None
        for batch in batches:
            block, number, passes, dims, nodes = (ints(batch, c) for c in ("block", "number", "pass", "dim", "node"))
            label = batch.column("label").dictionary_encode()
            for start, stop in runs(block, passes, dims, label.indices.to_numpy(zero_copy_only=False)):
                now = (int(block[start]), int(passes[start]), int(dims[start]), label[start].as_py())
                if now != key:
                    key, tail, tail_nodes = now, np.zeros((0, now[2])), nodes[:0]
                x = unit_rows(batch.column("vec"), start, stop)
                for at in range(0, stop - start, how.window):
                    own = x[at : at + how.window]
                    seen, ids = np.concatenate((tail, own)), np.concatenate((tail_nodes, nodes[start + at : start + at + len(own)]))
                    i, j = np.nonzero(own @ seen.T >= how.threshold)
                    i += len(tail)
                    ok = (j < i) & (i - j <= how.window)
                    ok &= number[start + at + i - len(tail)] // how.block == now[0]  # guests have been compared in their own block
                    if ok.any():
                        top = trees(i[ok], j[ok], len(ids))
                        linked = np.flatnonzero(top != np.arange(len(ids)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[top[linked]])], names=["a", "b"])
                    tail, tail_nodes = seen[-how.window :], ids[-how.window :]

    return map_arrow(dealt, run, "a long, b long")


def linked_in_passes(vectors: DataFrame, how: Search) -> list[DataFrame]:
    """(a, b) links of the passes, a few passes at a time, written."""
    largest = vectors.groupBy("label", F.size("vec")).count().agg(F.max("count")).first()[0] or 0
    found, total = [], n_passes(largest, how)
    for first in range(0, total, how.passes_at_once):
        order = ["pass", "label", "dim", "key", "node"]
        placed = numbered(keys(vectors, first, min(first + how.passes_at_once, total), how), order)
        block = F.floor(F.col("number") / how.block)
        late = F.col("number") % how.block >= how.block - how.window
        placed = placed.withColumn("block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
        rows = placed.drop("key").join(vectors.select("node", "vec"), "node")
        found.append(written(window_links(rows, how), "links"))
    return found


def small_counts(members: DataFrame, how: Search) -> DataFrame:
    """(node, n): links of each class in components that a task holds whole; members: component, node, m, vec."""
    dealt = members.repartition("component").sortWithinPartitions("component", "node")

    def count(held):
        x, nodes, m = (np.concatenate([h[k] for h in held]) for k in range(3))
        near = x @ x.T >= how.threshold
        np.fill_diagonal(near, False)
        return nodes, near @ m + m - 1

    def run(batches):
        key, held = None, []
        for batch in batches:
            component, nodes, m = (ints(batch, c) for c in ("component", "node", "m"))
            out = []
            for start, stop in runs(component):
                if held and component[start] != key:
                    out.append(count(held))
                    held = []
                key = component[start]
                held.append((unit_rows(batch.column("vec"), start, stop), nodes[start:stop], m[start:stop]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["node", "n"])
        if held:
            nodes, n = count(held)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    return map_arrow(dealt, run, "node long, n long")


def centres(members: DataFrame) -> DataFrame:
    """(component, centre): the sums of the members' unit vectors, added up in tasks first."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            component = ints(batch, "component")
            for start, stop in runs(component):
                own = unit_rows(batch.column("vec"), start, stop).sum(axis=0)
                sums[int(component[start])] = sums[int(component[start])] + own if int(component[start]) in sums else own
            if len(sums) > 1000:
                yield emit(sums)
                sums = {}
        if sums:
            yield emit(sums)

    def emit(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["component", "sum"])

    parts = map_arrow(members, run, "component long, sum array<double>").select("component", F.posexplode("sum").alias("i", "x"))
    added = parts.groupBy("component", "i").agg(F.sum("x").alias("x"))
    return added.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def with_core(members: DataFrame, how: Search) -> DataFrame:
    """Members with whether they are within half the angle of their component's mean; such ones are linked to each other."""
    middle = written(centres(members), "centres")
    few = middle.count() <= FEW // 100
    rows = members.join(F.broadcast(middle) if few else middle, "component")
    least = math.cos(max(0.0, how.angle / 2 - 1e-6))

    def run(batches):
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            for start, stop in runs(ints(batch, "component")):
                centre = batch.column("centre")[start].values.to_numpy()
                length = np.sqrt((centre * centre).sum())
                if length > 0:
                    core[start:stop] = unit_rows(batch.column("vec"), start, stop) @ (centre / length) >= least
            kept = [batch.column(c) for c in ("component", "node", "m", "vec")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(core)], names=["component", "node", "m", "vec", "core"])

    vec = dict(members.dtypes)["vec"]
    return map_arrow(rows, run, f"component long, node long, m long, vec {vec}, core boolean")


def tile_counts(marked: DataFrame, how: Search) -> DataFrame:
    """(node, n): what links with members outside the core add to each node; marked: component, node, m, vec, core."""
    sizes = marked.groupBy("component").agg(F.count_if(~F.col("core")).alias("n_outer"), F.count(F.lit(1)).alias("n_all"))
    tiles = lambda c: F.ceil(F.col(c) / how.tile).cast("int")
    placed = marked.join(sizes.filter("n_outer > 0").select("component", tiles("n_outer").alias("k_outer"), tiles("n_all").alias("k_all")), "component")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outer = placed.filter("NOT core").withColumns({"i": own("k_outer"), "side": F.lit(0)}).withColumn("j", every("k_all"))
    whole = placed.withColumns({"j": own("k_all"), "side": F.lit(1)}).withColumn("i", every("k_outer"))
    names = ["component", "i", "j", "side", "node", "m", "core", "vec"]
    dealt = outer.select(*names).union(whole.select(*names)).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "node")

    def result(nodes, n):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    def run(batches):
        key, held, sums = None, [], None
        for batch in batches:
            component, i, j, side, nodes, m, core = (ints(batch, c) for c in ("component", "i", "j", "side", "node", "m", "core"))
            for start, stop in runs(component, i, j, side):
                now = (int(component[start]), int(i[start]), int(j[start]))
                if now != key:
                    if sums is not None:
                        yield result(held[1], sums)
                    key, held, sums = now, [], None
                part = (unit_rows(batch.column("vec"), start, stop), nodes[start:stop], m[start:stop])
                if side[start] == 0:
                    held.append(part)
                    continue
                if sums is None:
                    if not held:
                        continue  # no member outside the core fell into this tile
                    held = [np.concatenate([h[k] for h in held]) for k in range(3)]
                    sums = np.zeros(len(held[1]), np.int64)
                for at in range(0, stop - start, how.tile):
                    x, ids, weight = (p[at : at + how.tile] for p in part)
                    near = (x @ held[0].T >= how.threshold) & (ids[:, None] != held[1][None, :])
                    sums += weight @ near
                    inner = core[start:stop][at : at + how.tile].astype(bool)
                    yield result(ids[inner], (near @ held[2])[inner])
        if sums is not None:
            yield result(held[1], sums)

    return map_arrow(dealt, run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def link_counts(vectors: DataFrame, labels: DataFrame, how: Search) -> DataFrame:
    """(node, component, n): the links of every class of a component, written; labels: node, component."""
    sized = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = written(labels.join(sized, "component").join(vectors.select("node", "vec", "m"), "node"), "members")
    counted = small_counts(members.filter(F.col("size") <= how.tile).select("component", "node", "m", "vec"), how)
    large = members.filter(F.col("size") > how.tile).select("component", "node", "m", "vec")
    if not large.isEmpty():
        marked = written(with_core(large, how), "marked")
        inner = marked.filter("core").groupBy("component").agg(F.sum("m").alias("weight"))
        base = marked.select("component", "node", "m", "core").join(inner, "component", "left").select("node", F.when(F.col("core"), F.col("weight") - 1).otherwise(F.col("m") - 1).alias("base"))
        counted = counted.union(base.join(tile_counts(marked, how), "node", "left").select("node", (F.col("base") + F.coalesce("n", F.lit(0))).alias("n")))
    out = written(labels.join(counted, "node"), "counted")
    discard(members)
    return out


def near_vectors(df: DataFrame, how: Search = Search(), *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``.

    Two rows link when their labels are equal and not null and the cosine of their
    vectors is at least the threshold, in double precision; only vectors of one
    length link.  ``n_links`` counts the other rows linked to a row,
    ``component_id`` is the least id reachable by links, and a row is kept where
    that is its own id.  A null, empty or zero vector, one with a null or
    non-finite component, and a row without label or id stand alone: no links, their
    own id (null without one), kept.  Rows that repeat an id are vectors of their
    own; equal ones link.  No pair below the threshold is counted; pairs that
    never meet in a window and aren't in one component otherwise are missed, at the
    threshold itself with chance 1 - recall.  Other columns, whatever their
    names, aren't read; no rows: no rows.
    """
    kind = "double" if dict(df.dtypes)[vec_col] == "array<double>" else "float"
    vec = F.transform(F.col(vec_col).cast(f"array<{kind}>"), lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # one zero
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("able", able)
    alone = rows.filter("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    vectors = classes(rows.filter("able"))
    passes = linked_in_passes(vectors, how)
    pairs = passes[0]
    for more in passes[1:]:
        pairs = pairs.union(more)
    labels = written(components(pairs).select("node", "component").distinct(), "labels")
    discard(*passes)
    counted = link_counts(vectors, labels, how)

    named = vectors.select("node", "label", "h1", "h2", "m", "least").join(counted, "node", "left")
    tops = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("top"))
    found = named.join(tops, "component", "left").select("label", "h1", "h2", "m", F.coalesce("n", F.col("m") - 1).alias("n_links"), F.coalesce("top", "least").alias("component_id"))
    found = written(found, "found")
    # a class of so many rows is one of FEW at most, and goes to the rows; the other classes have few rows each
    most = max(1000, vectors.agg(F.sum("m")).first()[0] or 0) // FEW + 1000
    on = ["label", "h1", "h2"]
    placed = rows.filter("able").select("vec_id", "label", *hashes()).join(F.broadcast(found.filter(F.col("m") > most).drop("m")), on, "left")
    large = placed.filter("n_links IS NOT NULL").select("vec_id", "n_links", "component_id")
    rest = placed.filter("n_links IS NULL").drop("n_links", "component_id").join(found.filter(F.col("m") <= most).drop("m"), on).select("vec_id", "n_links", "component_id")
    out = alone.union(large).union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
