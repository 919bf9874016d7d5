"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A data set is a folder.  Part p has ``ids-p.bin`` (little-endian unsigned
integers of one width, all documents one after another, each with the end id),
``offsets-p.bin`` (64-bit: where each document starts in the part, and the
total) and ``docs-p.bin`` (64-bit document ids, and a byte each that tells
whether the id is null).  Parts follow each other in ascending document id;
the base of a part is the sum of the ids of the parts before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.storage import Store, shared_folder
from siftline.llm.vocab import tokenizer_ids

PARTS = "part long, n_docs long, n_tokens long, width int"


def write_token_files(df: DataFrame, folder: str, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[dict]:
    """Encode every text, append ``end_id``, write the parts; returns the parts with their bases.

    Documents are dealt out by ranges of their id (null ids first) and sorted
    within a part; ties keep the order of their texts.  Null texts are empty
    and hold the end id alone.  A repeated row is written again.  Other
    columns are not read.  A task that is run again writes the same files.
    What reaches the driver is one row for each part.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches):
        encode = tokenizer_ids(path)
        store, part = Store(folder), TaskContext.get().partitionId()
        end = np.array([end_id], encode.dtype).tobytes()
        offsets, docs, nulls, at = [0], [], [], 0
        with store.create(f"ids-{part}.bin") as out:
            for batch, data, starts in text_slices(batches, "text"):
                for ids in encode(data, starts):
                    out.write(ids.tobytes())
                    out.write(end)
                    at += len(ids) + 1
                    offsets.append(at)
                column = batch.column("id")
                docs.append(np.asarray(pa.compute.fill_null(column, 0), "<i8"))
                nulls.append(np.asarray(pa.compute.is_null(column)).astype(np.uint8))
        with store.create(f"offsets-{part}.bin") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        with store.create(f"docs-{part}.bin") as out:
            out.write(np.concatenate(docs).tobytes() if docs else b"")
            out.write(np.concatenate(nulls).tobytes() if nulls else b"")
        row = [[part], [len(offsets) - 1], [at], [encode.dtype.itemsize]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "n_docs", "n_tokens", "width"])

    found = sorted((r.asDict() for r in map_arrow(dealt, run, PARTS).collect()), key=lambda r: r["part"])
    base = 0
    for r in found:
        r["base"] = base
        base += r["n_tokens"]
    return found


def _mapped(store: Store, name: str, dtype: str) -> np.ndarray:
    local = store.local_path(name)
    if local is None:
        with store.open(name) as file:
            return np.frombuffer(file.read(), dtype)
    try:
        return np.memmap(local, dtype, "r")
    except ValueError:  # an empty file can't be mapped
        return np.zeros(0, dtype)


def read_token_files(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """One row per document: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32.

    The checksum is over the document's ids as little-endian unsigned 32-bit
    integers, whatever the width in the file.  No parts: no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    table = spark.createDataFrame([(p["part"], p["n_docs"], p["width"], p["base"]) for p in parts if p["n_docs"]], "part long, n_docs long, width int, base long")

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids = _mapped(store, f"ids-{r['part']}.bin", f"<u{r['width']}")
                offsets = np.asarray(_mapped(store, f"offsets-{r['part']}.bin", "<u8")).astype(np.int64)
                with store.open(f"docs-{r['part']}.bin") as file:
                    raw = file.read()
                n = r["n_docs"]
                docs, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
                crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=nulls), pa.array(offsets[:-1] + r["base"], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(table.repartition(max(1, len(parts)), "part"), run, schema)


def token_file_digests(df: DataFrame, path: str, *, end_id: int = 0) -> DataFrame:
    """Write the token files of ``df`` to a new shared folder and read them back."""
    spark = df.sparkSession
    folder = shared_folder(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(df, folder, path, end_id=end_id))
