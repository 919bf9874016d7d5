"""Exact removal of repeated byte strings by deep-shallow suffix ordering.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere
else, in the same document or another.

Suffixes of a corpus can't be sorted in one place.  Every window of LENGTH
bytes is therefore assigned to its anchor: the GRAM-byte string in it with
the least hash, the leftmost of equals.  Equal windows have equal anchors at
the same offset, so windows can be dealt out by anchor.  Windows in a row that
share an anchor form a fragment, which is stored once; fragments whose anchor
occurs once cannot repeat and are left behind before any text moves.  Of equal
fragments one goes on, with their number.  Suffixes of the fragments that go
on are ordered within anchor and offset, and neighbours tell which windows
repeat; a join brings that back to all places of a fragment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, slices, utf8_buffer
from siftline.llm.segments import mix
from siftline.llm.storage import free_name
from siftline.llm.suffix_sort import repeated

LENGTH, GRAM = 200, 64
#: A document is looked at in stretches of so many windows; about so many bytes of fragments are ordered at a time.
STRETCH, SORTED = 1 << 19, 2 << 20
#: Fragments of an anchor above which they are dealt out further, by so many bytes next to it.
SPLIT, NEXT = 1000, 48
_INDEX = 24
# Grams only choose anchors and deal fragments out: a hash that two of them share costs time, never a result.
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def overlapping_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of at least eight bytes that may overlap.

    Modulo 2**64 a polynomial cancels out on texts of a regular build, such as
    the Thue-Morse word, so spans are told apart by their eight-byte words,
    each mixed with its place before it is added.
    """
    size = stops - starts
    per = -(-size // 8)
    out = np.empty(len(starts), np.uint64)
    words = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
    for a, b in slices(per.tolist(), 1 << 17):
        number = np.arange(int(per[a:b].sum())) - np.repeat(np.cumsum(per[a:b]) - per[a:b], per[a:b])
        # the last word ends with the span
        step = np.minimum(8 * number, np.repeat(size[a:b] - 8, per[a:b]))
        terms = mix(words[np.repeat(starts[a:b], per[a:b]) + step] + _place(number))
        out[a:b] = mix(np.add.reduceat(terms, np.cumsum(per[a:b]) - per[a:b]) + size[a:b].astype(np.uint64))
    return out


def _place(number: np.ndarray) -> np.ndarray:
    return mix((number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def fragments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, first window, windows, anchor hash, offset of the anchor, fragment hash) of all fragments.

    Documents are the spans [begin, end) of ``data``, ascending; fewer than
    2**24 bytes in all.
    """
    n = len(data)
    count = np.maximum(0, ends - begins - length + 1)
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    power, inverse = powers(n + 1)
    terms = _BYTE[data]
    terms *= power[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    del terms, sums
    low = np.uint64((1 << _INDEX) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # least of every window of grams: from the right within blocks, and from the left
    width = length - gram + 1
    blocks = -(-len(ranked) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    tiles = padded.reshape(blocks, width)
    left = np.minimum.accumulate(tiles, 1).ravel()
    right = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - length + 1], left[width - 1 : width - 1 + n - length + 1])
    del ranked, padded, tiles, left, right
    doc = np.repeat(np.arange(len(begins)), count)
    window = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(total)
    anchor = (least[window] & low).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))))
    size = np.diff(np.append(starts, total))
    at, anchor, doc = window[starts], anchor[starts], doc[starts]
    stop = at + size + length - 1
    return doc, at, size, grams[anchor], anchor - at, overlapping_hashes(data, at, stop)


def stretches(column: pa.Array, length: int):
    """(buffer, document, base, begin, end) slices of a text column; long documents in overlapping stretches."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).tolist()
    for start, stop in slices(sizes, STRETCH // 4):
        data, offsets = utf8_buffer(column.slice(start, stop - start))
        if len(data) < STRETCH + length:
            yield data, np.arange(start, stop), np.zeros(stop - start, np.int64), offsets[:-1], offsets[1:]
            continue
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for s in range(a, max(a + 1, b - length + 1), STRETCH):
                part = data[s : min(b, s + STRETCH + length - 1)]
                yield part, np.array([start + i]), np.array([s - a]), np.array([0]), np.array([len(part)])


def places(dealt: DataFrame, row: str, mark: str, text_col: str, *, once: bool) -> DataFrame:
    """Fragments of all texts: anchor, frag, id, k, at, size, off, n.

    ``once``: equal fragments within a slice are one row with their number.
    """
    schema = "anchor long, frag long, id long, k int, at int, size int, off int, n long"

    def run(batches):
        for batch in batches:
            ids, k = batch.column(row).to_numpy(), batch.column(mark).to_numpy()
            for data, index, base, begins, ends in stretches(batch.column(text_col), LENGTH):
                doc, at, size, anchor, off, frag = fragments(data, begins, ends)
                n = np.ones(len(doc), np.int64)
                at = at - begins[doc] + base[doc]
                if once and len(doc):
                    order = np.lexsort((frag, anchor))
                    new = np.flatnonzero(np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (frag[order][1:] != frag[order][:-1]))))
                    n = np.diff(np.append(new, len(order)))
                    keep = order[new]
                    doc, at, size, anchor, off, frag = (x[keep] for x in (doc, at, size, anchor, off, frag))
                of = index[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(frag.view(np.int64)), pa.array(ids[of]), pa.array(k[of], pa.int32()), *(pa.array(x, pa.int32()) for x in (at, size, off)), pa.array(n)],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return map_arrow(dealt, run, schema)


def ordered(found: DataFrame) -> DataFrame:
    """anchor, frag, runs [(from, to)]: the windows of each fragment that repeat.

    ``found`` has the bytes of each distinct fragment or part of one (raw),
    its number n, the offset of its anchor (off) and its first window (base);
    it is sorted by anchor and part within partitions.
    """
    schema = "anchor long, frag long, runs array<struct<a: int, b: int>>"

    def settle(rows):
        anchors, parts, frags, offs, bases, numbers, raws = rows
        data = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws]) - LENGTH + 1
        begins = np.concatenate(([0], np.cumsum(sizes + LENGTH - 1)[:-1]))
        group = np.cumsum(np.concatenate(([0], ((anchors[1:] != anchors[:-1]) | (parts[1:] != parts[:-1])).astype(np.int64))))
        many, alone = numbers > 1, np.bincount(group)[group] == 1
        flags = np.repeat(many, sizes)
        # of a fragment that has its anchor to itself no other window can be equal
        take = np.flatnonzero(~np.repeat(alone, sizes))
        of = np.repeat(np.arange(len(raws)), sizes)
        within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if len(take):
            bucket = group[of[take]] * LENGTH + (offs[of[take]] - within[take])
            flags[take] |= repeated(data, begins[of[take]] + within[take], bucket, LENGTH)
        padded = np.concatenate(([False], flags, [False]))
        edge = np.concatenate(([False], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        first = np.flatnonzero(flags & (~padded[:-2] | edge))
        last = np.flatnonzero(flags & (~padded[2:] | np.append(edge[1:], True)))
        counts = np.bincount(of[first], minlength=len(raws))
        runs = pa.StructArray.from_arrays([pa.array(bases[of[first]] + within[first], pa.int32()), pa.array(bases[of[last]] + within[last] + 1, pa.int32())], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), runs)
        return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(frags), lists], names=["anchor", "frag", "runs"]).filter(pa.array(counts > 0))

    def run(batches):
        held, weight = [], 0

        def cut(last: bool):
            """What is held up to the last anchor and part, which may go on in the next batch."""
            nonlocal held, weight
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("anchor", "part")], 1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            stop = len(keys) if last else int(new[-1]) if len(new) else 0
            part, rest = table.slice(0, stop), table.slice(stop)
            held, weight = rest.to_batches(), rest.nbytes
            if part.num_rows:
                yield settle((*(part.column(c).to_numpy() for c in ("anchor", "part", "frag", "off", "base", "n")), part.column("raw").to_pylist()))

        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                held.append(whole.slice(start, 4096))
                weight += held[-1].column("raw").nbytes * held[-1].num_rows // max(1, whole.num_rows)
                if weight > SORTED:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return map_arrow(found, run, schema)


def repeats(df: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``df`` with ``out``: what to remove of each row, as [(start, stop)] in bytes.

    Spans may overlap; null stands for none.  Two rows that are the same in id
    and text repeat each other like any two documents.  Texts are shuffled
    once, and read from that shuffle by all steps.

    A row is known by its id and 32 bits of its text's hash; where its id is
    null, or ids repeat, 64 bits of a hash of both stand for the id.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, mark, spans_, asked_ = (free_name(df, c) for c in ("row", "mark", "spans", "asked"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL")
    unique = ids.groupBy("id").count().filter("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(F.col(id_col).cast("long"), text, F.lit(1))
    keyed = df.withColumns({row: F.coalesce(F.col(id_col).cast("long"), hashed) if unique else hashed, mark: F.hash(text)})
    dealt = keyed.repartition(n, row, mark)

    # every step takes all columns of the shuffle, else there would be several
    some = places(dealt, row, mark, text_col, once=True).repartition("anchor")
    distinct = some.groupBy("anchor", "frag").agg(F.sum("n").alias("n"), F.min(F.struct("id", "k", "at", "size", "off")).alias("r"))
    by = Window.partitionBy("anchor")
    several = distinct.withColumns({"all": F.sum("n").over(by), "split": F.count(F.lit(1)).over(by) > SPLIT}).filter("`all` > 1")
    wanted = several.select("anchor", "split", "frag", "n", F.col("r.id").alias(row), F.col("r.k").alias(mark), F.col("r.at").alias("at"), F.col("r.size").alias("size"), F.col("r.off").alias("off"))

    # the bytes of one of each, from any row with its id and text
    asked = wanted.groupBy(row, mark).agg(F.collect_list(F.struct("anchor", "split", "frag", "n", "at", "size", "off")).alias(asked_))

    def bytes_of(batches):
        names = ["anchor", "part", "frag", "n", "off", "base", "raw"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                out = []
                for t, fs in zip(batch.column(text_col).to_pylist(), batch.column(asked_).to_pylist(), strict=True):
                    raw = t.encode()
                    for f in fs:
                        own = raw[f["at"] : f["at"] + f["size"] + LENGTH - 1]
                        cuts = halves(own, f["off"], f["size"]) if f["split"] else [(0, 0, own)]
                        out += [(f["anchor"], part, f["frag"], f["n"], f["off"] - base, base, piece) for part, base, piece in cuts]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    found = map_arrow(dealt.join(asked, [row, mark]), bytes_of, "anchor long, part long, frag long, n long, off int, base int, raw binary")
    # rows of the same id and text give the same fragments
    result = ordered(found.repartition("anchor", "part").dropDuplicates(["anchor", "part", "frag"]).sortWithinPartitions("anchor", "part", "frag"))

    back = places(dealt, row, mark, text_col, once=False).select("anchor", "frag", "id", "k", "at").join(result, ["anchor", "frag"])
    spans = (
        back.select(F.col("id").alias(row), F.col("k").alias(mark), F.expr(f"transform(runs, r -> struct(at + r.a AS a, at + r.b + {LENGTH - 1} AS b))").alias("s"))
        .groupBy(row, mark)
        .agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias(spans_))
    )
    return dealt.join(spans, [row, mark], "left").select(*(dealt[c] for c in df.columns), F.col(spans_).alias(out))


def halves(raw: bytes, off: int, size: int) -> list[tuple[int, int, bytes]]:
    """(part, first window, bytes) of a fragment of an anchor with very many.

    Equal windows have their anchor at the same offset.  Where half of the
    rest lies in front of the anchor they agree in the NEXT bytes in front of
    it, else in those behind it; windows are dealt out by a hash of these.
    """
    middle = (LENGTH - GRAM) // 2
    cut = min(max(0, off - middle + 1), size)  # windows before this one have the anchor far on
    out = []
    for side, base, stop, near in ((b"<", 0, cut, raw[off - NEXT : off]), (b">", cut, size, raw[off + GRAM : off + GRAM + NEXT])):
        if base < stop:
            part = int.from_bytes(hashlib.blake2b(side + near, digest_size=8).digest(), "little", signed=True)
            out.append((part, base, raw[base : stop + LENGTH - 1]))
    return out


def covered(spans) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join((*kept, raw[at:]))


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Every row of ``df`` with its text free of repeated strings in ``out`` (default: the text column).

    Where a cut falls within a character its remaining bytes go too.  Null and
    empty texts stay; a text that is repeated all through becomes empty.
    """
    out = out or text_col
    spans_ = free_name(df.withColumn(out, F.lit(None)), "spans")
    rows = repeats(df, spans_, id_col=id_col, text_col=text_col)
    names = [*(c for c in df.columns if c != out), out]

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(spans_).to_pylist(), strict=True):
                texts.append(text if not spans else remove(text.encode(), covered(spans)).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(texts, pa.string())], names=names)

    schema = df.drop(out).withColumn(out, F.lit(None).cast("string")).schema
    return map_arrow(rows, run, schema)


def repeat_digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for every row of ``df``.

    Null texts are empty; null ids are kept; texts under LENGTH bytes lose
    nothing; other columns are not read.
    """
    rows = repeats(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "__spans")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = []
                for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__spans")), strict=True):
                    raw = (text or "").encode()
                    runs = covered(spans)
                    out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(remove(raw, runs)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
