"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

Every text is encoded and cut into pieces of a full window and one remainder.
Full pieces are windows of their own.  Remainders are gathered in blocks; the
multiway differencing method splits a block into k near-equal windows: each
partial partition is a tuple of k loads, the two with the largest spread are
merged with the heaviest load of one against the lightest of the other, until
one is left.  k starts from the block's total and rises whenever a window
would pass its capacity.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.vocab import tokenizer_ids

WINDOW, BLOCK = 1024, 256


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of ``sizes`` in k groups of near-equal sums (Karmarkar-Karp).

    Groups may be empty.  Equal spreads are taken in the order they arose, so
    the result depends on nothing but the arguments.
    """
    # a partial partition: loads in descending order (their least taken off) and the indices of each
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        # tuples hold their nonzero loads only; the rest of the k are zeros at the end
        if len(a) + len(b) <= k:
            loads, groups = a + b, ga + gb
        else:
            over = len(a) + len(b) - k
            loads, groups = a[: len(a) - over], ga[: len(ga) - over]
            # the lightest ``over`` of a meet the lightest of b, opposed; heavier ones meet zeros
            tail_a, tail_ga = a[len(a) - over :], ga[len(ga) - over :]
            tail_b, tail_gb = b[len(b) - over :], gb[len(gb) - over :]
            loads = loads + b[: len(b) - over] + [x + y for x, y in zip(tail_a, reversed(tail_b), strict=True)]
            groups = groups + gb[: len(gb) - over] + [x + y for x, y in zip(tail_ga, reversed(tail_gb), strict=True)]
        order = sorted(range(len(loads)), key=lambda j: -loads[j])
        least = loads[order[-1]] if len(loads) == k else 0
        loads, groups = [loads[j] - least for j in order], [groups[j] for j in order]
        heapq.heappush(heap, (-loads[0], made, loads, groups))
        made += 1
    groups = heap[0][3] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indices, none above the capacity; as few as differencing allows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        excess = max((sum(sizes[i] for i in g) for g in groups), default=0) - capacity
        if excess <= 0:
            return [g for g in groups if g]
        k += max(1, k // 100)


def pack(df: DataFrame, path: str, *, window: int = WINDOW, end_id: int = 0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text is encoded whole (null: empty) and ``end_id`` appended.  Pieces
    of one sequence fill it from offset 0 without gaps.  Repeated rows are
    packed again, null document ids are kept, other columns are not read.  An
    empty table gives no rows.  Blocks are formed within a task in the order
    of its rows, so nothing is shuffled, and memory holds one block.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encode = tokenizer_ids(path)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        done: list[tuple] = []

        def settle():
            nonlocal sequence
            for group in windows_of([p[2] for p in waiting], window):
                at = 0
                for i in group:
                    done.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting.clear()

        def flush():
            columns = list(zip(*done, strict=True)) or [()] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, data, offsets in text_slices(batches, "text"):
            for doc, ids in zip(batch.column("id").to_pylist(), encode(data, offsets), strict=True):
                ids = np.append(ids, encode.dtype.type(end_id)).astype("<u4")
                n = len(ids)
                for start in range(0, n, window):
                    piece = ids[start : start + window]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), n)
                    if len(piece) == window:
                        done.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(row)
                if len(waiting) >= block:
                    settle()
            yield flush()
        if waiting:
            settle()
        yield flush()

    return map_arrow(rows, run, schema)
