"""Helpers shared by the operators that run on Arrow record batches."""

from __future__ import annotations

import ctypes
import os
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from tempfile import gettempdir

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Texts are handed to vectorised code in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers of another machine.

    Does nothing where PYTHONPATH already leads to it; else the package is
    zipped once a session and sent along with the tasks.
    """
    package = Path(__file__).resolve().parents[1]
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(package.parent) in known or getattr(context, "_siftline_shipped", False):
        return
    target = os.path.join(gettempdir(), f"siftline-{context.applicationId}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._siftline_shipped = True


def slices(lengths: Iterable[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [start, stop) ranges whose lengths add up to about ``most``."""
    start, held, stop = 0, 0, 0
    for stop, size in enumerate(lengths, 1):
        held += size
        if held >= most:
            yield start, stop
            start, held = stop, 0
    if start < stop:
        yield start, stop


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets into it.

    Null counts as the empty text.
    """
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches cut into slices of about SLICE_BYTES of text, each with its buffer and offsets."""
    for batch in batches:
        column = batch.column(text_col)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        for start, stop in slices(sizes.tolist()):
            part = batch.slice(start, stop - start)
            yield part, *utf8_buffer(part.column(text_col))


def trim() -> None:
    """Give memory that is free back to the machine; a worker that is used again would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def map_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow after making the package importable by the workers; free memory is given back before and after a task."""
    ship(df.sparkSession)

    def run(batches):
        trim()
        try:
            yield from make(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)
