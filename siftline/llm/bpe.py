"""Byte-level BPE by length-bucketed padded matrices.

Pieces (matches of the pre-tokenizer's pattern) of similar length form the
rows of a matrix of token ids, padded at the end.  In every round each row
merges its leftmost pair of least rank; ranks of pairs come from a hash table
held in arrays, and rows that have no pair left are taken out.  Each distinct
cut of running text is encoded once per worker while it is remembered.

A piece above ROW bytes is several rows.  The ids of a text are right exactly
if every two neighbours are what their own bytes are encoded to: a merge across
the seam of two ids would be the first one to cross it among their bytes as
well, and a text's own seams are crossed by no merge.  So where two rows meet
the ids around a seam that isn't right are encoded again, as rows of a matrix,
until all seams are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.segments import CutTable, Memo
from siftline.llm.vocab import pretoken_pattern, read_ranks, runs_of

NONE = np.int32(2**31 - 1)
#: Bytes of a row of a piece that is longer.
ROW = 256


class PairTable:
    """Open addressing from (left id, right id) to the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] == -1
            take = left[free]
            # of several keys for one slot the first is placed
            _, first = np.unique(slots[take], return_index=True)
            placed = take[first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = values[placed]
            left = np.setdiff1d(left, placed)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; NONE where there is none (a negative id pairs with nothing)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        flat = keys.ravel()
        out = np.full(flat.shape, NONE, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(flat[open_])
        while len(open_):
            held = self.keys[slots]
            hit = held == flat[open_]
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (held != -1)
            open_, slots = open_[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)


class ByteBpe:
    """Encodes byte strings by the ranks of a .tiktoken file, and decodes ids."""

    def __init__(self, path: str, pattern: str, capacity: int = 800_000):
        import regex

        self.ranks = read_ranks(path)
        self.table = PairTable(self.ranks)
        self.single = np.full(256, -1, np.int32)
        for byte in range(256):
            self.single[byte] = self.ranks.get(bytes([byte]), -1)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array(list(map(len, self.tokens)), np.int64)
        self.right: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(pattern).findall
        self.pieces = Memo(self._encode_pieces, capacity // 4)
        self.cuts = CutTable(self._encode_cuts, "<u4", capacity)

    def _encode_cuts(self, cuts: list[str], _first: list[bool]) -> list[np.ndarray]:
        found = []
        for t in cuts:
            runs = runs_of(t)
            found.append(runs if len(runs) > 1 else self.find(t))
        # a run may still hold several matches (digits next to marks)
        found = [[p for r in f for p in ((r,) if r.strip().isalpha() else self.find(r))] if len(f) > 1 else f for f in found]
        get = self.pieces.need(set(chain.from_iterable(found))).__getitem__
        return [np.frombuffer(b"".join(map(get, f)), "<u4") for f in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [x.astype("<u4").tobytes() for x in self.encode_bytes([p.encode() for p in pieces])]

    def encode_bytes(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces, each by itself."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is None:
                rest.append(i)
            else:
                out[i] = np.array([whole], np.int32)
        for i, ids in zip(rest, self._merged([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _merged(self, pieces: list[bytes], *, cut: bool = True) -> list[np.ndarray]:
        """Ids of pieces by merges alone; ``cut``: long ones as several rows."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if not p:
                out[i] = np.zeros(0, np.int32)
            elif cut and len(p) > ROW:
                out[i] = self._rows(p)
            else:
                buckets.setdefault(max(3, (len(p) - 1).bit_length()), []).append(i)
        for bits, members in sorted(buckets.items()):
            rows = max(1, (1 << 20) >> bits)
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _wrong(self, ids: np.ndarray, seams: np.ndarray) -> np.ndarray:
        """Of the seams (an index is that of the id behind it) those whose two ids their bytes aren't encoded to."""
        pairs = list(zip(ids[seams - 1].tolist(), ids[seams].tolist(), strict=True))
        new = list({p for p in pairs if p not in self.right})
        if len(self.right) + len(new) > 1 << 18:
            self.right.clear()
            new = list(set(pairs))
        for pair, found in zip(new, self._merged([self.tokens[a] + self.tokens[b] for a, b in new], cut=False), strict=True):
            self.right[pair] = found.tolist() == list(pair)
        return seams[[not self.right[p] for p in pairs]]

    def _rows(self, piece: bytes) -> np.ndarray:
        """One piece as rows of ROW bytes, with the seams between them put right."""
        rows = self._merged([piece[i : i + ROW] for i in range(0, len(piece), ROW)])
        ids, reach = np.concatenate(rows), 4
        wrong = self._wrong(ids, np.cumsum(list(map(len, rows)))[:-1])
        while len(wrong):
            # the ids around each wrong seam; where two such stretches touch they are one
            low, high = np.maximum(wrong - reach, 0), np.minimum(wrong + reach, len(ids))
            new = np.flatnonzero(np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1])))
            low, high = low[new], np.maximum.reduceat(high, new)
            at = np.concatenate(([0], np.cumsum(self.sizes[ids])))
            raw = [piece[a:b] for a, b in zip(at[low].tolist(), at[high].tolist(), strict=True)]
            settled = iter(self._merged([r for r in raw if len(r) <= ROW]))
            found = [self._wide(r) if len(r) > ROW else next(settled) for r in raw]
            parts, seams, done, n = [], [], 0, 0
            for a, b, f in zip(low.tolist(), high.tolist(), found, strict=True):
                parts += [ids[done:a], f]
                n += a - done
                seams += [n, n + len(f)]
                n, done = n + len(f), b
            ids = np.concatenate((*parts, ids[done:]))
            seams = np.unique(seams)
            wrong = self._wrong(ids, seams[(seams > 0) & (seams < len(ids))])
            reach *= 2
        return ids

    def _wide(self, raw: bytes) -> np.ndarray:
        """Ids of a row of any length; a round merges all pairs of the least rank where that is the same as one after another.

        One after another they are merged from the left, and a merged token that
        makes a pair of no greater rank with a neighbour has its turn next; so a
        round ends with the first merge that makes such a pair.
        """
        ids = self.single[np.frombuffer(raw, np.uint8)]
        pairs = self.table(ids[:-1], ids[1:])
        while len(pairs) and (rank := pairs.min()) != NONE:
            at = np.flatnonzero(pairs == rank)
            # of pairs that overlap each other the first, third, fifth
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            # the neighbours when its turn comes: all before it merged, none behind it
            before, behind = np.where(at > 0, ids[at - 1], -1), np.append(ids, np.int32([-1, -1]))[at + 2]
            before[1:][np.diff(at) == 2] = rank
            token = np.full(len(at), rank, np.int32)
            early = np.flatnonzero((self.table(before, token) <= rank) | (self.table(token, behind) <= rank))
            if len(early):
                at = at[: early[0] + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = rank
            ids, pairs = ids[keep], np.append(pairs, NONE)[keep][:-1]
            place = at - np.arange(len(at))
            for i in (place[place > 0] - 1, place[place < len(pairs)]):
                pairs[i] = self.table(ids[i], ids[i + 1])
        return ids

    def _matrix(self, pieces: list[bytes], width: int) -> Iterable[np.ndarray]:
        lengths = np.array(list(map(len, pieces)))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.single[raw]
        columns = np.arange(width)
        ids[columns[None, :] >= lengths[:, None]] = -1
        pairs = np.full(ids.shape, NONE, np.int32)
        pairs[:, :-1] = self.table(ids[:, :-1], ids[:, 1:])
        result: list = [None] * len(pieces)
        row_of = np.arange(len(pieces))
        while len(row_of):
            at = pairs.argmin(1)  # the first of equal ranks is the leftmost
            rows = np.arange(len(row_of))
            rank = pairs[rows, at]
            over = rank == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    row = ids[i]
                    result[row_of[i]] = row[: lengths[row_of[i]]].copy()
                live = ~over
                ids, pairs, row_of, at, rank = ids[live], pairs[live], row_of[live], at[live], rank[live]
                rows = np.arange(len(row_of))
                if not len(row_of):
                    break
                width = int(lengths[row_of].max())
                ids, pairs, columns = ids[:, :width], pairs[:, :width], columns[:width]
            # compaction: what is right of the merged pair moves one to the left
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), len(columns) - 1)
            ids = np.take_along_axis(ids, source, 1)
            pairs = np.take_along_axis(pairs, source, 1)
            ids[rows, at] = rank
            lengths[row_of] -= 1
            past = columns[None, :] >= lengths[row_of][:, None]
            ids[past] = -1
            right = ids[rows, np.minimum(at + 1, len(columns) - 1)]
            pairs[rows, at] = self.table(ids[rows, at], np.where(at + 1 < lengths[row_of], right, -1))
            before = np.maximum(at - 1, 0)
            pairs[rows, before] = np.where(at > 0, self.table(ids[rows, before], ids[rows, at]), pairs[rows, before])
            pairs[columns[None, :] >= lengths[row_of][:, None] - 1] = NONE
        return result

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each document of a UTF-8 buffer, without special tokens."""
        ids, bounds = self.cuts(data, offsets)
        bounds = bounds.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@cache
def _decimal(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def encode(df: DataFrame, path: str, *, pattern: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Every row with the BPE ids of its text as an array of integers ``out``.

    Null and empty texts have an empty array.  A column named ``out`` is
    replaced; rows, repeated ones too, stay as and where they are.
    """
    pattern = pattern or pretoken_pattern()
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch, data, starts in text_slices(batches, text_col):
            found = bpe.encode(data, starts)
            offsets = np.concatenate(([0], np.cumsum(list(map(len, found))))).astype(np.int32)
            values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*batch.schema.names, out])

    return map_arrow(kept, run, schema)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the bytes of its ids as binary ``out``; null ids give null."""
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema
    pattern = pretoken_pattern()

    def run(batches):
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            found = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return map_arrow(kept, run, schema)


def round_trip(df: DataFrame, path: str, *, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; digests of both instead of the ids themselves.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes).  Null texts are empty; rows are
    neither dropped nor moved; other columns are not read.
    """
    pattern = pattern or pretoken_pattern()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = byte_bpe(path, pattern)
        decimal = _decimal(len(bpe.tokens))
        for batch, data, offsets in text_slices(batches, "text"):
            counts, coded, decoded = [], [], []
            for ids in bpe.encode(data, offsets):
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
