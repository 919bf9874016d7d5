"""Document fingerprints from prefix polynomial hashes.

Of a text, H[i] is the polynomial hash of its first i code points modulo a
prime, for two bases.  From the arrays the hash of any span follows in
constant time, so two spans are compared at once, and the longest common
extension of two positions is found by binary search.

The fingerprint string holds the length, the hash of the whole text, hashes of
prefixes and suffixes of lengths that all texts have in common (a geometric
ladder), and the least hashes of all spans of SPAN code points.  Likeness of
two fingerprints is 1 for equal ones; else the larger of the common prefix and
suffix, found by binary search on the ladders, in relation to the longer text,
and of the resemblance of the least span hashes.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, slices

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 741_103_597)
SPAN, LEAST = 24, 32
_P = np.uint64(PRIME)


#: Texts are worked on in blocks of so many code points.
BLOCK = 1 << 18


@cache
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its first BLOCK powers and those of its inverse; what is beyond is a product of two."""
    out = []
    for base in BASES:
        both = []
        for b in (base, pow(base, -1, PRIME)):
            powers = np.ones(1, np.uint64)
            while len(powers) < BLOCK:
                powers = np.concatenate((powers, powers * np.uint64(pow(b, len(powers), PRIME)) % _P))
            both.append(powers)
        out.append(tuple(both))
    return out


def _inverse(at: np.ndarray, k: int) -> np.ndarray:
    """base**-at for each place."""
    small = _powers()[k][1][at % BLOCK]
    if not len(at) or int(at.max()) < BLOCK:
        return small
    blocks = at // BLOCK
    whole = np.array([pow(BASES[k], -BLOCK * int(b), PRIME) for b in range(int(blocks.max()) + 1)], np.uint64)
    return small * whole[blocks] % _P


@cache
def rungs(bits: int) -> np.ndarray:
    """The ladder's lengths up to 2**bits: four to each doubling."""
    return np.unique(np.floor(2 ** (np.arange(4 * bits + 1) / 4)).astype(np.int64))


class Prefixes:
    """The prefix arrays of a text: four bytes a code point and base."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.bits = max(1, self.n.bit_length())
        self.sums = []
        for k, (powers, _) in enumerate(_powers()):
            sums, last = np.zeros(self.n + 1, np.uint32), np.uint64(0)
            for a in range(0, self.n, BLOCK):
                part = points[a : a + BLOCK].astype(np.uint64) + np.uint64(1)
                # a term is below 2**31, so the sum of a block fits
                part = np.cumsum(part * powers[: len(part)] % _P) % _P * np.uint64(pow(BASES[k], a, PRIME)) % _P
                part = (part + last) % _P
                sums[a + 1 : a + 1 + len(part)] = part
                last = part[-1]
            self.sums.append(sums)

    def spans(self, starts, stops, base: int = 0) -> np.ndarray:
        """Hashes of the spans [start, stop); equal spans have equal hashes, in any text."""
        sums = self.sums[base]
        return (sums[stops].astype(np.uint64) + _P - sums[starts]) % _P * _inverse(starts, base) % _P

    def span(self, start: int, stop: int) -> tuple[int, int]:
        return tuple(int(self.spans(np.array([start]), np.array([stop]), b)[0]) for b in (0, 1))

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """The largest k for which k code points from i equal k from j of the other text."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        whole = "".join(f"{h:08x}" for h in self.span(0, self.n))
        ladder = rungs(self.bits)
        ladder = ladder[ladder <= self.n]
        zero = np.zeros(len(ladder), np.int64)
        up = self.spans(zero, ladder).astype(">u4").tobytes().hex()
        down = self.spans(self.n - ladder, zero + self.n).astype(">u4").tobytes().hex()
        least = b""
        if self.n >= SPAN:
            # a multiplier spreads the hashes, so that the least are a random choice of spans
            mixed = np.zeros(0, np.uint64)
            for a in range(0, self.n - SPAN + 1, BLOCK):
                starts = np.arange(a, min(a + BLOCK, self.n - SPAN + 1))
                found = self.spans(starts, starts + SPAN) * np.uint64(1_588_635_695) % _P
                if len(found) > 8 * LEAST:
                    few = np.unique(np.partition(found, 4 * LEAST)[: 4 * LEAST])
                    found = few if len(few) >= LEAST else np.unique(found)[:LEAST]
                mixed = np.unique(np.concatenate((mixed, found)))[: 4 * LEAST]
            least = np.unique(mixed)[:LEAST].astype(">u4").tobytes()
        return f"{self.n:x}.{whole}.{up}.{down}.{least.hex()}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    na, _, up_a, down_a, least_a = a.split(".")
    nb, _, up_b, down_b, least_b = b.split(".")
    longer, shorter = max(int(na, 16), int(nb, 16)), min(int(na, 16), int(nb, 16))
    if not shorter:
        return 0.0
    ladder = rungs(max(1, longer.bit_length()))

    def common(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y)) // 8
        while low < high:  # equality of prefixes can only end once
            middle = (low + high + 1) // 2
            if x[8 * middle - 8 : 8 * middle] == y[8 * middle - 8 : 8 * middle]:
                low = middle
            else:
                high = middle - 1
        return int(ladder[low - 1]) if low else 0

    edges = min(common(up_a, up_b) + common(down_a, down_b), shorter) / longer
    set_a, set_b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (least_a, least_b))
    union = sorted(set_a | set_b)[: max(len(set_a), len(set_b))]
    spans = sum(x in set_a and x in set_b for x in union) / len(union) if union else 0.0
    return min(max(edges, spans), 1.0)


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows id, text, halo dealt out in descending order of id, each part followed by the next part's first row.

    Null ids are last; ties are in the order of their texts.  Bounds are
    quantiles of the ids; what reaches the driver is two numbers for each
    part.  The text is shuffled once.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    found = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(max(1, n - 1))], 10 * n).alias("q")).first()["q"]
    bounds = sorted(set(found or []), reverse=True)
    own = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda b: b >= F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", own.cast("int"))
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("key").alias("head")).collect()}
    parts = sorted(heads)
    follows = [(heads[p], parts[i - 1]) for i, p in enumerate(parts)]  # the first part follows the last
    halo = spark.createDataFrame(follows, "key long, target int")
    both = rows.join(F.broadcast(halo), "key", "left").select(
        "id", "text", "key", F.explode(F.expr("filter(array(struct(part AS part, false AS halo), struct(target AS part, true AS halo)), x -> x.part IS NOT NULL)")).alias("to")
    )
    both = both.select("id", "text", "key", F.col("to.part").alias("part"), F.col("to.halo").alias("halo"))
    return both.repartitionById(max(parts, default=0) + 1, F.col("part")).sortWithinPartitions("halo", F.desc("key"), "text").select("id", "text", "halo")


def fingerprint_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``df``.

    The edited text ends in the start of the next document, in descending
    order of id, instead of the text's own second half.  Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_next (code points that text and next document start
    with).  Null texts are empty; a lone row is its own next document; other
    columns are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def pair(doc, text, prefixes, print_, after, after_prefixes, after_print):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        other = print_ if edited == text else Prefixes(edited).fingerprint()
        return (doc, n, hashlib.sha256(edited.encode()).hexdigest(), print_, other, likeness(print_, other), likeness(print_, after_print), prefixes.common_extension(0, after_prefixes, 0))

    def run(batches):
        held = None
        for batch in (b.slice(x, y - x) for b in batches for x, y in slices([len(t or "") for t in b.column("text").to_pylist()])):
            out = []
            for doc, text, halo in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "halo")), strict=True):
                text = text or ""
                prefixes = Prefixes(text)
                row = (doc, text, prefixes, prefixes.fingerprint())
                if held is not None:
                    out.append(pair(*held, *row[1:]))
                held = row
                if halo:
                    held = None
                    break
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            if held is None and batch.num_rows:
                break
        for _ in batches:  # further rows of the same id as the first of the next part
            pass

    return map_arrow(in_order(df, id_col, text_col), run, schema)
