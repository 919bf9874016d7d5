"""Token counts of whole texts, without keeping the tokens.

Texts go to the library in Arrow batches that are cut to about equal bytes;
only lengths come back.  Long texts are split at safe boundaries: before a
space that follows another character, where no piece of the vocabulary can
cross.  Each distinct split is counted once per worker while it is remembered.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.segments import CutTable

_MARK = "▁"


class PieceCounter:
    """Token counts by a sentencepiece .model file.

    The split before a space is exact if no piece has the space mark after
    another character and normalisation does nothing but mark spaces; both are
    checked here, and whole texts are counted where they don't hold.
    """

    def __init__(self, path: str, capacity: int = 800_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        inner = any(_MARK in p.lstrip(_MARK) for p in pieces)
        kept = all(self.library.normalize(x) == _MARK + x.replace(" ", _MARK) for x in ("a  b", "ﬁ", "é", "Ａ", "a\n\tb "))
        self.whole = inner or not kept
        self.table = CutTable(self._counts, np.int32, capacity, marked=True)

    def _counts(self, cuts: list[str], first: list[bool]) -> list[np.ndarray]:
        # the library puts a mark in front; it stands for the space of a cut that isn't the first of its text
        asked = [t if f else t[1:] for t, f in zip(cuts, first, strict=True)]
        found = iter(self.library.encode([t for t in asked if t], num_threads=1))
        # a lone space at the end of a text is one mark
        return [np.array([len(next(found)) if t else 1], np.int32) for t in asked]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each document of a UTF-8 buffer."""
        if self.whole:
            raw, at = data.tobytes(), offsets.tolist()
            return np.array([len(x) for x in self.library.encode([raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)], num_threads=1)], np.int64)
        counts, bounds = self.table(data, offsets)
        sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]


class JsonCounter:
    """Token counts by a tokenizers .json file; whole texts, lengths only."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw, at = data.tobytes(), offsets.tolist()
        texts = [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]
        return np.array([len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)], np.int64)


@cache
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Every row of ``df`` with the number of tokens of its text as ``out``.

    Null and empty texts have 0 tokens.  Repeated rows are each counted.  A
    column of ``df`` named as ``out`` is replaced.  No row is dropped and
    none moves to another partition.
    """
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        count = counter(path)
        for batch, data, offsets in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(data, offsets), pa.int64())], names=[*batch.schema.names, out])

    return map_arrow(kept, run, schema)
