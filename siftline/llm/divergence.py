"""How the sources of a language differ in their words, by tiles of group blocks.

1. A pass over the texts counts each group's terms and the documents they are in.
   A task adds up in tables of bounded size before anything is shuffled.
2. A language keeps the terms that are in enough of its documents and numbers
   them densely; its groups are numbered too.  Groups go in blocks, terms
   in chunks.  The counts of a block in a chunk are one packed row.
3. A packed row is sent to every pair of blocks that its block is in.  A task
   has a pair of blocks and a stretch of chunks, and reads them one after
   another; what it holds is one chunk of two blocks and the sums of the pairs.
   Sums of the stretches are added up.

A count that isn't there is 0 and has its share all the same, so chunks without
a row are added by their number of terms.  All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.storage import discard, written
from siftline.operators.numbering import numbered

#: Shares are whole numbers, this many to one.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Sizes:
    """Groups of a block, terms of a chunk, chunks of a task; distinct terms that a task adds up before it hands them on.

    They bound memory; results don't depend on them.
    """

    groups: int = 16
    chunk: int = 4096
    chunks: int = 64
    held: int = 200_000


# Letters of A-Z in lower case, a blank for all other ASCII; bytes of longer characters as they are.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def term_counts(rows: DataFrame, held: int) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): occurrences and documents of each term of a group.

    A group has a row with a null term besides, so that one without terms is there too.
    """
    schema = "lang string, source string, term string, n long, docs long"
    names = ["lang", "source", "term", "n", "docs"]

    def emit(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            found = pa.array([*own, None], pa.binary()).cast(pa.string())
            n = [*own.values(), 0]
            seen = docs[lang, source]
            d = [*(seen[t] for t in own), 0]
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), found, pa.array(n, pa.int64()), pa.array(d, pa.int64())]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=50_000)

    def run(batches):
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        for part, data, offsets in text_slices(batches, "text"):
            raw, at = data.tobytes(), offsets.tolist()
            words: dict[tuple, list] = {}
            once: dict[tuple, list] = {}
            for k, group in enumerate(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)):
                found = terms(raw[at[k] : at[k + 1]])
                words.setdefault(group, []).extend(found)
                once.setdefault(group, []).extend(set(found))
            for group, found in words.items():
                counts.setdefault(group, Counter()).update(found)
                docs.setdefault(group, Counter()).update(once[group])
            if sum(map(len, counts.values())) > held:
                yield from emit(counts, docs)
                counts, docs = {}, {}
        yield from emit(counts, docs)

    found = map_arrow(rows, run, schema)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_sql(count: str, total: str, terms: str, smoothing: int) -> str:
    """1 + floor(SCALE * (count + smoothing) / (total + smoothing * terms)), exact beyond 64 bits."""
    top = f"CAST({SCALE} AS DECIMAL(11, 0)) * CAST({count} + {smoothing} AS DECIMAL(20, 0))"
    return f"1 + (({top}) div CAST({total} + {smoothing} * {terms} AS DECIMAL(20, 0)))"


def shares(counts: np.ndarray, below: np.ndarray, smoothing: int) -> np.ndarray:
    """1 + floor(SCALE * (count + smoothing) / below), by long division in three steps; below: under 2 ** 53."""
    quotient, rest = np.divmod(counts + smoothing, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + digits
    return quotient + 1


class Tile:
    """The sums of |p - q| of a pair of blocks over a stretch of chunks, as they come in."""

    def __init__(self, n_left: list[int], n_right: list[int], n_terms: int, stretch: int, smoothing: int, sizes: Sizes):
        self.chunk = sizes.chunk
        self.smoothing = smoothing
        self.below = [np.array(n, np.int64).reshape(-1, 1) + smoothing * n_terms for n in (n_left, n_right)]
        self.sums = np.zeros((len(n_left), len(n_right)), np.int64)
        first = stretch * sizes.chunks * sizes.chunk
        self.n_terms = n_terms
        self.open = max(0, min(first + sizes.chunks * sizes.chunk, n_terms) - first)  # terms not added yet

    def add(self, chunk: int, sides: list[tuple[np.ndarray, np.ndarray] | None]) -> None:
        """The chunk of given (place, count) of both blocks; a place is slot * chunk size + term."""
        size = min(self.chunk, self.n_terms - chunk * self.chunk)
        p = []
        for side, below in zip(sides, self.below, strict=True):
            counts = np.zeros((len(below), self.chunk), np.int64)
            if side is not None:
                counts.reshape(-1)[side[0]] = side[1]
            p.append(shares(counts[:, :size], below, self.smoothing))
        for a in range(len(p[0])):
            self.sums[a] += np.abs(p[1] - p[0][a]).sum(axis=1)
        self.open -= size

    def result(self) -> np.ndarray:
        if self.open:
            left, right = (shares(np.zeros_like(b), b, self.smoothing) for b in self.below)
            self.sums += self.open * np.abs(left - right.T)
            self.open = 0
        return self.sums


def tile_sums(rows: DataFrame, smoothing: int, sizes: Sizes) -> DataFrame:
    """(lang, a, b, value) of pairs of groups from rows (lang, i, j, stretch, chunk, block, n_left, n_right, n_terms, places, counts).

    A task's tile begins with a row of chunk -1, which has the totals of the groups; packed rows follow by chunk.
    """
    keys = ["lang", "i", "j", "stretch"]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, "chunk", "block")

    def run(batches):
        key, tile, chunk, sides = None, None, None, [None, None]

        def close_chunk():
            nonlocal chunk, sides
            if chunk is not None:
                tile.add(chunk, sides)
            chunk, sides = None, [None, None]

        def close_tile():
            if tile is None:
                return
            close_chunk()
            lang, i, j, _ = key
            sums = tile.result()
            a, b = np.indices(sums.shape)
            mine = (a < b) if i == j else np.ones(sums.shape, bool)
            a, b, value = a[mine] + i * sizes.groups, b[mine] + j * sizes.groups, sums[mine]
            n = 2 * len(value)
            columns = [pa.array([lang] * n, pa.string()), *(pa.array(np.concatenate(x), pa.int64()) for x in ((a, b), (b, a), (value, value)))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

        for batch in batches:
            for k in range(batch.num_rows):  # a row is a packed block, not a count
                row = {c: batch.column(c)[k] for c in ("lang", "i", "j", "stretch", "chunk", "block")}
                row = {c: v.as_py() for c, v in row.items()}
                if row["chunk"] < 0:
                    yield from close_tile()
                    key = tuple(row[c] for c in keys)
                    tile = Tile(batch.column("n_left")[k].as_py(), batch.column("n_right")[k].as_py(), batch.column("n_terms")[k].as_py(), row["stretch"], smoothing, sizes)
                    continue
                if chunk != row["chunk"]:
                    close_chunk()
                    chunk = row["chunk"]
                packed = batch.column("places")[k].values.to_numpy(), batch.column("counts")[k].values.to_numpy()
                if row["block"] == row["i"]:
                    sides[0] = packed
                if row["block"] == row["j"]:
                    sides[1] = packed
        yield from close_tile()

    found = map_arrow(sorted_rows, run, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smoothing: int = 5, top: int = 50, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, source, part, item, value, rank): by language, how far each source's words are from the others'.

    Null text, language and source are ''.  A language keeps the terms in at
    least ``least_docs`` of its documents; p is a term's share of a group's kept
    terms, smoothed.  Part ``pair`` has every other source of the language with
    the sum of |p - q| over the kept terms (0 if there are none); part ``term``
    the ``top`` kept terms that the group has and uses more than its language,
    with p - q.  Ranks begin at 1, by value descending, then item ascending in
    bytes.  Rows that repeat are documents of their own.  Other columns aren't
    read; no rows: no rows.
    """
    as_text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = df.select(as_text(lang_col, "lang"), as_text(source_col, "source"), as_text(text_col, "text"))
    counted = written(term_counts(rows, sizes.held), "counted")

    vocabulary = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    vocabulary = numbered(vocabulary.drop("docs"), ["lang", "term"])
    langs = written(vocabulary.groupBy("lang").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total")), "langs")
    entries = counted.drop("docs").join(vocabulary, ["lang", "term"]).join(langs.select("lang", "first"), "lang")
    entries = written(entries.select("lang", "source", "term", "n", "lang_n", (F.col("number") - F.col("first")).alias("t")), "entries")

    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered(counted.filter("term IS NULL").select("lang", "source"), ["lang", "source"])
    starts = groups.groupBy("lang").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n_groups"))
    groups = groups.join(totals, ["lang", "source"], "left").join(starts, "lang").join(langs.drop("first"), "lang", "left")
    g = F.col("number") - F.col("start")
    groups = groups.select("lang", "source", g.alias("g"), F.floor(g / sizes.groups).cast("int").alias("block"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.ceil(F.col("n_groups") / sizes.groups).cast("int").alias("n_blocks"))
    groups = written(groups, "groups")
    discard(counted)

    # a tile for each pair of blocks of a language and each stretch of its chunks
    blocks = groups.groupBy("lang", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "total"))), lambda x: x["total"]).alias("ns"), F.max("n_terms").alias("n_terms"), F.max("n_blocks").alias("n_blocks"))
    stretch = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / (sizes.chunk * sizes.chunks)).cast("int"))
    left = blocks.select("lang", F.col("block").alias("i"), F.col("ns").alias("n_left"), "n_terms", F.explode(F.expr("sequence(block, n_blocks - 1)")).alias("j"))
    right = blocks.select("lang", F.col("block").alias("j"), F.col("ns").alias("n_right"))
    tiles = left.join(right, ["lang", "j"]).withColumn("stretch", F.explode(F.sequence(F.lit(0), stretch - 1)))
    tiles = tiles.select("lang", "i", "j", "stretch", F.lit(-1).cast("long").alias("chunk"), F.lit(-1).alias("block"), "n_left", "n_right", "n_terms", F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("counts"))

    placed = entries.join(groups.select("lang", "source", "g", "block", "n_blocks"), ["lang", "source"])
    place = (F.col("g") % sizes.groups) * sizes.chunk + F.col("t") % sizes.chunk
    packed = placed.groupBy("lang", "block", "n_blocks", F.floor(F.col("t") / sizes.chunk).alias("chunk")).agg(F.collect_list(F.struct(place.cast("int").alias("place"), "n")).alias("x"))
    sent = packed.withColumn("k", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    none = F.array().cast("array<long>")
    sent = sent.select("lang", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.floor(F.col("chunk") / sizes.chunks).cast("int").alias("stretch"), "chunk", "block", none.alias("n_left"), none.alias("n_right"), F.lit(0).cast("long").alias("n_terms"), F.col("x.place").alias("places"), F.col("x.n").alias("counts"))
    sums = tile_sums(tiles.union(sent), smoothing, sizes)
    named = lambda c, out: groups.select("lang", F.col("g").alias(c), F.col("source").alias(out))
    pairs = sums.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    used = entries.join(groups.select("lang", "source", "total", "n_terms", "lang_total"), ["lang", "source"])
    p, q = share_sql("n", "total", "n_terms", smoothing), share_sql("lang_n", "lang_total", "n_terms", smoothing)
    more = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f"({p}) - ({q})").alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).cast("int")
    return pairs.withColumn("rank", rank).union(more.withColumn("rank", rank).filter(F.col("rank") <= top))
