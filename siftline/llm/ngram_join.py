"""Exact Jaccard self-join on word n-grams: size-banded tiles with bitmap signatures.

1. A pass over the texts gives each document its number of shingles, a hash of
   its whole set and a bitmap: bit b is the parity of the shingles that hash
   to b.  Documents with equal sets are one class from the start.  The pass
   also counts shingles in a sketch; a task reports counters that are far above
   its mean.
2. Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of
   either, in any common order.  Frequent shingles (by the sketch) come last in
   the order, so that lists of documents under a shingle stay short; a list that
   is long all the same is dealt out to tiles.  Documents without a partner of
   fitting size go, of equal lists one stays, and from here on a class of equal
   sets is one document.
3. The documents of a tile are sorted by size and compared in size bands.
   Differing bits of two bitmaps are a lower bound of the symmetric difference,
   hence an upper bound of the overlap; only pairs that the bound lets through
   go on, to an exact intersection of sorted arrays.
4. The first round looks within tiles, for pairs that connect them.  The second
   takes lists whose documents are still in different components, and compares
   all of their pairs across components.  So every link between two components
   is found, yet copies are not expanded into pairs.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices, utf8_buffer
from siftline.llm.components import components
from siftline.llm.segments import mix
from siftline.llm.shingles import shingle_sets
from siftline.llm.storage import discard, written

PERCENT, WIDTH = 75, 5
#: Least and most bits of a bitmap, bits of a sketch counter's number, documents of a tile, and of a band.
BITMAP, WIDEST, SKETCH, TILE, BAND = 1024, 1 << 16, 22, 4096, 256
#: Classes that are broadcast at most, ids that are, and keys that a task remembers.
CLASSES, IDS, SEEN = 100_000, 2_000_000, 200_000


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets of n shingles: a power of two, at least twice n within the limits."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64), BITMAP, WIDEST)


def bitmaps(docs: np.ndarray, hashes: np.ndarray, n: int) -> list[bytes]:
    """Parity bitmaps of n sets; one folded in half is the bitmap of half the bits."""
    bits = widths(np.bincount(docs, minlength=n))
    out: list = [b""] * n
    for width in np.unique(bits).tolist():
        members = np.flatnonzero(bits == width)
        row = np.full(n, -1)
        row[members] = np.arange(len(members))
        own = row[docs] >= 0
        at = row[docs[own]] * width + (hashes[own] >> np.uint64(40)).astype(np.int64) % width
        parity = (np.bincount(at, minlength=len(members) * width) & 1).astype(np.uint8).reshape(-1, width)
        for i, packed in zip(members.tolist(), np.packbits(parity, axis=1), strict=True):
            out[i] = packed.tobytes()
    return out


def stacked(raw: list[bytes], width: int) -> np.ndarray:
    """Bitmaps folded to ``width`` bits, as rows of 64-bit words."""
    out = np.empty((len(raw), width // 64), np.uint64)
    for size in {len(x) for x in raw}:
        members = [i for i, x in enumerate(raw) if len(x) == size]
        rows = np.frombuffer(b"".join(raw[i] for i in members), np.uint64).reshape(len(members), -1)
        while rows.shape[1] > out.shape[1]:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[members] = rows
    return out


def profile(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document (id, n, k1, k2, bits), and rows of frequent counters (bucket, n) without id."""
    schema = "id long, n long, k1 long, k2 long, bits binary, bucket int"

    def run(batches):
        sketch, total = np.zeros(1 << SKETCH, np.int32), 0
        names = [x.split()[0] for x in schema.split(", ")]
        for batch, data, offsets in text_slices(batches, "text"):
            n = batch.num_rows
            docs, hashes = shingle_sets(data, offsets)
            sketch += np.bincount((hashes >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.int32) if len(hashes) > 1 << (SKETCH - 3) else 0
            if 0 < len(hashes) <= 1 << (SKETCH - 3):
                np.add.at(sketch, (hashes >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
            total += len(hashes)
            count = np.bincount(docs, minlength=n)
            keys = []
            for salt in (0x51, 0xA7):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)))
                ends = np.cumsum(count)
                keys.append(pa.array((sums[ends] - sums[ends - count]).view(np.int64)))
            bits = pa.array(bitmaps(docs, hashes, n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), *keys, bits, pa.nulls(n, pa.int32())], names=names)
        heavy = np.flatnonzero(sketch > max(16, 8 * total >> SKETCH))
        n = len(heavy)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(sketch[heavy], pa.int64()), *(pa.nulls(n, pa.int64()),) * 2, pa.nulls(n, pa.binary()), pa.array(heavy, pa.int32())], names=names)

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL"), run, schema)


def classes(documents: DataFrame) -> DataFrame:
    """The documents (id, n) with the least id of equal sets as class, and whether the class is a large one.

    Equal sets have equal sums of two hashes of every shingle, 128 bits, and
    equal sizes.  Classes above one in CLASSES of all rows, so less than
    CLASSES of them, are broadcast; the others are joined in a shuffle.
    """
    keys = ["k1", "k2", "n"]
    sets = written(documents.filter("n > 0").groupBy(*keys).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "classes")
    least = max(1000, documents.count() // CLASSES)
    marked = documents.select("id", *keys).join(F.broadcast(sets.filter(F.col("c") > least).drop("c")), keys, "left")
    rest = marked.filter("class IS NULL AND n > 0").drop("class").join(sets.filter(F.col("c") <= least).drop("c"), keys, "left")
    own = [
        marked.filter("class IS NOT NULL").select("id", "n", "class", F.lit(True).alias("large")),
        rest.select("id", "n", F.coalesce("class", "id").alias("class"), F.lit(False).alias("large")),
        marked.filter("n = 0").select("id", "n", F.col("id").alias("class"), F.lit(False).alias("large")),
    ]
    out = written(own[0].union(own[1]).union(own[2]), "members")
    discard(sets)
    return out


def postings(df: DataFrame, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(shingle, tile, tiles, id, n) for the first shingles of each document; equal sets within a task once.

    A shingle that the sketch tells to be frequent has a power of two of
    tiles.  A document's tile is one of two hashes of its id, by a bit of the
    shingle: lists with the same documents have nearly the same tiles, and
    tiles of the two kinds cross.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # of the sketch's fixed size at most

    def run(batches):
        weights, seen = np.zeros(1 << SKETCH, np.int64), set()
        weights[shared.value[0]] = shared.value[1]
        for batch, data, offsets in text_slices(batches, "text"):
            docs, hashes = shingle_sets(data, offsets)
            n = np.bincount(docs, minlength=batch.num_rows)
            ends = np.cumsum(n)
            keep = np.zeros(batch.num_rows, bool)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64))) for salt in (0, 0x51)]
            for i, key in enumerate(zip(n.tolist(), *((s[ends] - s[ends - n]).tolist() for s in sums), strict=True)):
                if key[0] and key not in seen:
                    seen.add(key)
                    keep[i] = True
            if len(seen) > SEEN:
                seen.clear()
            weight = weights[(hashes >> np.uint64(64 - SKETCH)).astype(np.int64)]
            order = np.lexsort((hashes, weight, docs))
            rank = np.arange(len(docs)) - np.repeat(ends - n, n)
            first = n - -(-PERCENT * n // 100) + 1
            chosen = (rank < first[docs]) & keep[docs]
            docs, hashes, weight = docs[chosen], hashes[order][chosen], weight[order][chosen]
            tiles = np.where(weight > TILE, 1 << np.ceil(np.log2(np.maximum(weight, 1) / TILE)).astype(np.int64), 1)
            ids = batch.column("id").to_numpy()[docs]
            tile = (mix(ids.view(np.uint64) + (hashes & np.uint64(1)) + np.uint64(0x5F)) >> np.uint64(8)).astype(np.int64) % tiles
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tile, pa.int32()), pa.array(tiles, pa.int32()), pa.array(ids), pa.array(n[docs], pa.int64())], names=["shingle", "tile", "tiles", "id", "n"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL"), run, "shingle long, tile int, tiles int, id long, n long")


def grouped(batches, names: tuple[str, ...]):
    """(table, edges): runs of rows with equal ``names``, as they come sorted; the runs of a table are whole."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        last = int(edges[-1]) if len(edges) else 0
        if last:
            yield table.slice(0, last), np.concatenate(([0], edges))
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def lists_of(posted: DataFrame) -> DataFrame:
    """(shingle, tile, ids): the documents of every tile that can have a partner.

    A list of one tile keeps documents with a partner of fitting size; of such
    lists with equal documents one stays.  Tiles of longer lists stay as they
    are, and an unexpectedly long one is cut on.
    """
    schema = "shingle long, tile long, ids array<long>, ns array<long>, h1 long, h2 long"
    sorted_ = posted.repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "n", "id")

    def run(batches):
        seen: set = set()
        for table, edges in grouped(batches, ("shingle", "tile")):
            shingle, tile, tiles, ids, n = (table.column(c).to_numpy() for c in ("shingle", "tile", "tiles", "id", "n"))
            sizes = np.diff(edges)
            number = np.repeat(np.arange(len(sizes)), sizes)
            one = (tiles == 1) & (sizes[number] <= 2 * TILE)
            before, after = np.zeros(len(n), bool), np.zeros(len(n), bool)
            same = number[1:] == number[:-1]
            fits = same & (100 * n[:-1] >= PERCENT * n[1:])
            before[1:], after[:-1] = fits, fits
            keep = ~one | before | after
            # long lists are cut into tiles of their own
            within = np.arange(len(n)) - np.repeat(edges[:-1], sizes)
            part = np.where(one, 0, within // (2 * TILE))
            shingle, tile, ids, n, number, part, one = (x[keep] for x in (shingle, tile, ids, n, number, part, one))
            if not len(ids):
                continue
            cut = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (part[1:] != part[:-1]))))
            count = np.diff(np.append(cut, len(ids)))
            keys = []
            for salt in (0x33, 0x9D):
                h = np.add.reduceat(mix(mix(ids.view(np.uint64) + np.uint64(salt)) + np.uint64(salt)), cut) + count.astype(np.uint64)
                alone = mix(mix(shingle[cut].view(np.uint64) + np.uint64(salt)) + (tile[cut].astype(np.uint64) << np.uint64(32)) + part[cut].astype(np.uint64))
                keys.append(np.where(one[cut], h, alone).view(np.int64))
            new = np.ones(len(cut), bool)
            for i, key in enumerate(zip(keys[0].tolist(), keys[1].tolist(), strict=True)):
                new[i] = key not in seen
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            offsets = pa.array(np.append(cut, len(ids)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, n)]
            # parts of a tile are tiles: numbered above any tile that a hash gives
            name = tile[cut].astype(np.int64) + (part[cut] << 20)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[cut]), pa.array(name, pa.int64()), *arrays, *map(pa.array, keys)], names=["shingle", "tile", "ids", "ns", "h1", "h2"]).filter(pa.array(new))

    lists = map_arrow(sorted_, run, schema)
    return lists.groupBy("h1", "h2").agg(F.min_by(F.struct("shingle", "tile", "ids", "ns"), "shingle").alias("x")).select("x.*")


def passing(n_a, bits_a, n_b, bits_b) -> np.ndarray:
    """Which pairs the sizes and the bitmaps let through; shapes broadcast, bits in the last axis."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    both = n_a + n_b
    overlap = np.minimum((both - differ) // 2, np.minimum(n_a, n_b))
    return 100 * overlap >= PERCENT * (both - overlap)


def bands(n: np.ndarray, width: np.ndarray, rows: np.ndarray):
    """Stretches of ``rows`` (ascending in n) with bitmaps of one width, of at most BAND rows."""
    cuts = np.concatenate(([0], np.flatnonzero(width[rows][1:] != width[rows][:-1]) + 1, [len(rows)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for i in range(a, b, BAND):
            yield rows[i : min(i + BAND, b)]


def tile_pairs(n: np.ndarray, raw: list[bytes], left: np.ndarray, right: np.ndarray):
    """Row indices (i of left, j of right, i != j) of passing pairs, size band against size band.

    n ascends; left and right are ascending rows.  Of two widths the wider
    bitmap is folded.
    """
    width = np.array([8 * len(x) for x in raw])
    others = list(bands(n, width, right))
    for rows in bands(n, width, left):
        for columns in others:
            if 100 * n[columns[-1]] < PERCENT * n[rows[0]]:
                continue
            if 100 * n[rows[-1]] < PERCENT * n[columns[0]]:
                break
            size = int(min(width[rows[0]], width[columns[0]]))
            x, y = (stacked([raw[k] for k in at.tolist()], size) for at in (rows, columns))
            ok = passing(n[rows, None], x[:, None, :], n[None, columns], y[None, :, :])
            ok &= rows[:, None] != columns[None, :]
            i, j = np.nonzero(ok)
            yield rows[i], columns[j]


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect: stars around the rows of least id.

    Lists that share most of their documents so give mostly the same edges.
    """
    if len(a) <= 1:
        return list(zip(a.tolist(), b.tolist(), strict=True))
    ends, other = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((ids[other], ends))
    other, start = other[order], np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=len(ids)))))
    seen, out = np.zeros(len(ids), bool), []
    for centre in np.argsort(ids, kind="stable").tolist():
        if seen[centre] or start[centre] == start[centre + 1]:
            continue
        seen[centre] = True
        queue = deque([centre])
        while queue:
            node = queue.popleft()
            near = other[start[node] : start[node + 1]]
            near = near[~seen[near]]
            seen[near] = True
            out += [(node, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def links_within(ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect most of what passes in a tile.

    The row of least id is compared with all others and takes with it what
    passes; so a cluster of near copies costs one comparison a row.  When
    several rows in turn found nothing, the rest is compared band by band.
    """
    rest, a, b, vain = np.arange(len(ids)), [], [], 0
    while len(rest) > BAND // 4 and vain < 8:
        centre = rest[ids[rest].argmin()]
        rest = rest[rest != centre]
        found = [p[1] for p in tile_pairs(n, raw, np.array([centre]), rest)]
        hits = np.concatenate(found) if found else rest[:0]
        vain = 0 if len(hits) else vain + 1
        a.append(np.full(len(hits), centre))
        b.append(hits)
        rest = np.setdiff1d(rest, hits, assume_unique=True)
    pairs = [(i[i < j], j[i < j]) for i, j in tile_pairs(n, raw, rest, rest)]
    if pairs:
        edges = forest(ids, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        a.append(np.array([e[0] for e in edges], np.int64))
        b.append(np.array([e[1] for e in edges], np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links_across(n: np.ndarray, raw: list[bytes], label: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All passing pairs of rows with different labels, but for pairs of guests."""
    values, at = np.unique(label[~guest], return_inverse=True)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = values[np.bincount(at).argmax()]
    some, own = np.flatnonzero(guest | (label != common)), np.flatnonzero(~guest)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in tile_pairs(n, raw, some, own):
        apart = label[i] != label[j]
        a.append(i[apart])
        b.append(j[apart])
    return np.concatenate(a), np.concatenate(b)


def candidates(entries: DataFrame, bits: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that the bound lets through: connecting ones of each tile, or all across labels.

    ``entries``: shingle, tile, id (of a class), n.  Across labels the rows of
    a list that don't have its most frequent label visit all of its tiles; so
    a list whose documents are of one component sends nothing, and one of two
    tiles and more sends its few others.
    """
    across = labels is not None
    rows = entries
    if across:
        rows = entries.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        spread = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("tile").alias("t"), F.max("tile").alias("u"))
        mixed = written(rows.join(spread.filter("x != y").select("shingle", F.expr("t != u").alias("wide")), "shingle"), "mixed")
        many = mixed.filter("wide")
        common = many.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("common"))
        visitors = many.join(common, "shingle").filter("label != common").select("shingle", F.col("tile").alias("home"), "id", "n", "label")
        visits = visitors.join(many.select("shingle", "tile").distinct(), "shingle").filter("tile != home")
        names = ["shingle", "tile", "id", "n", "label"]
        rows = mixed.select(*names, F.lit(False).alias("guest")).union(visits.select(*names, F.lit(True).alias("guest")))
    else:
        rows = rows.withColumns({"label": F.lit(0).cast("long"), "guest": F.lit(False)})
    rows = rows.join(bits, "id").select("shingle", "tile", "id", "n", "bits", "label", "guest")
    rows = rows.repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "n", "id")

    def run(batches):
        for table, edges in grouped((b.slice(i, 8192) for b in batches for i in range(0, b.num_rows, 8192)), ("shingle", "tile")):
            ids, n, label, guest = (table.column(c).to_numpy() for c in ("id", "n", "label", "guest"))
            raw = table.column("bits").to_pylist()
            sizes = np.diff(edges)
            found_a, found_b = [], []
            two = edges[:-1][sizes == 2]  # most lists: one pair each
            if len(two):
                least = np.array([min(len(raw[k]), len(raw[k + 1])) for k in two.tolist()])
                for size in np.unique(least).tolist():
                    at = two[least == size]
                    ok = passing(n[at], stacked([raw[k] for k in at.tolist()], 8 * size), n[at + 1], stacked([raw[k + 1] for k in at.tolist()], 8 * size))
                    ok &= (label[at] != label[at + 1]) | (not across)
                    found_a.append(ids[at[ok]])
                    found_b.append(ids[at[ok] + 1])
            for k in np.flatnonzero(sizes > 2).tolist():
                own = slice(edges[k], edges[k + 1])
                a, b = links_across(n[own], raw[own], label[own], guest[own]) if across else links_within(ids[own], n[own], raw[own])
                found_a.append(ids[own][a])
                found_b.append(ids[own][b])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    out = written(map_arrow(rows, run, "a long, b long").filter("a != b").distinct(), "pairs")
    if across:
        discard(mixed)
    return out


def texts_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents of the pairs, written.

    Their ids are broadcast where they are at most IDS; beyond, texts and ids
    meet in a shuffle.
    """
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    few = needed.count() <= IDS
    out = written(rows.join(F.broadcast(needed) if few else needed, "id", "left_semi").dropDuplicates(["id"]), "texts")
    discard(needed)
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets link, by exact intersection; texts: id, text (unique ids)."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = []
                for column in ("text_a", "text_b"):
                    docs, hashes = shingle_sets(*utf8_buffer(batch.column(column)))
                    sets.append((hashes, np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=batch.num_rows)))).tolist()))
                (ha, ea), (hb, eb) = sets
                keep = []
                for k in range(batch.num_rows):
                    x, y = ha[ea[k] : ea[k + 1]], hb[eb[k] : eb[k + 1]]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(bool(both) and 100 * both >= PERCENT * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    return map_arrow(rows, run, "a long, b long")


def links(rows: DataFrame, entries: DataFrame, bits: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The verified pairs of a round, written; what led to them is deleted."""
    pairs = candidates(entries, bits, labels)
    texts = texts_of(rows, pairs)
    out = written(verified(pairs, texts), "links")
    discard(pairs, texts)
    return out


def ids_repeat(rows: DataFrame) -> bool:
    """Whether an id of ``rows`` (id, text) has different texts."""
    texts = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y"))
    return not texts.filter("x != y").isEmpty()


def node(id_col: str, text_col: str) -> Column:
    """The key of a distinct (id, text); null without an id."""
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), text_col))


def linked(rows: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the rows (id, text) with an id, each id with one text; ``same``: further links (a, b)."""
    profiled = written(profile(rows, "id", "text"), "profile")
    documents = profiled.filter("bucket IS NULL")
    heavy = profiled.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most the sketch: two numbers a counter
    frequent = np.stack([heavy.column(c).to_numpy().astype(np.int64) for c in ("bucket", "n")])

    members = classes(documents)
    class_of = members.groupBy("id").agg(F.min("class").alias("class"))
    lists = written(lists_of(postings(rows, frequent, "id", "text")), "lists")
    placed = lists.select("shingle", "tile", F.explode(F.arrays_zip("ids", "ns")).alias("x")).select("shingle", "tile", F.col("x.ids").alias("id"), F.col("x.ns").alias("n"))
    entries = written(placed.join(class_of, "id").select("shingle", "tile", F.col("class").alias("id"), "n").distinct(), "entries")
    bits = written(documents.join(entries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("bits").alias("bits")), "bits")
    discard(lists, profiled)

    first = links(rows, entries, bits, None)
    known = first
    if same is not None:  # links of rows are links of their classes
        x, y = (class_of.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}")) for c in ("a", "b"))
        known = first.union(same.join(x, "a").join(y, "b").select("class_a", "class_b"))
    labels = written(components(known).selectExpr("node AS id", "component AS label"), "labels")
    second = links(rows, entries, bits, labels)
    discard(entries, bits, first)
    joined = second.join(labels.selectExpr("id AS a", "label AS la"), "a", "left").join(labels.selectExpr("id AS b", "label AS lb"), "b", "left")
    over = components(joined.selectExpr("coalesce(la, a) AS a", "coalesce(lb, b) AS b")).selectExpr("node AS label", "component AS top")
    found = labels.union(over.selectExpr("label AS id", "label")).distinct().join(over, "label", "left")
    tops = found.select(F.col("id").alias("class"), F.coalesce("top", "label").alias("top")).filter("class != top")
    # members of a large class, of which there are few, get their component without a shuffle
    large = tops.join(members.filter("large").select("class").distinct(), "class", "left_semi")
    whole = members.filter("large").join(F.broadcast(large), "class", "left").union(members.filter("NOT large").join(tops, "class", "left"))
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("top", "class").alias("component_id"))


def ngram_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``.

    Two documents link when 100 * intersection >= PERCENT * union of their
    sets of WIDTH-word shingles; component_id is the least id reachable.  Null
    and empty texts have no shingles and stand alone.  A row whose id is null
    stands alone with a null component and no count.  Rows that repeat an id
    share a component, and each of their texts links.  Other columns are not
    read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if ids_repeat(rows):
        # a node for each (id, text); nodes of one id are linked, and components go back to the least id
        nodes = written(rows.filter("id IS NOT NULL").select(node("id", "text").alias("key"), "id"), "nodes")
        same = nodes.join(nodes.groupBy("id").agg(F.min("key").alias("b")), "id").select(F.col("key").alias("a"), "b")
        found = linked(rows.select(node("id", "text").alias("id"), "text"), same).distinct()
        placed = written(nodes.join(found, F.col("key") == F.col("doc_id")).select("id", "n_shingles", "component_id"), "placed")
        least = placed.groupBy("component_id").agg(F.min("id").alias("least"))
        whole = placed.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    else:
        whole = linked(rows)
    alone = df.filter(F.col(id_col).isNull()).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS BIGINT) AS n_shingles", "CAST(NULL AS BIGINT) AS component_id")
    return whole.union(alone)
