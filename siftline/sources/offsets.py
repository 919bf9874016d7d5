"""Byte offsets of the lines of text files, and documents read by them.

A split of a file doesn't know where its first line begins, but every line
belongs to one split and the splits' lines add up to the file: so tasks count
bytes from the start of their split, and a split begins where the lines of the
splits in front of it end.  The index is sorted by id in small row groups with
least and greatest value and a Bloom filter, so that a look-up of a few ids
reads the groups that may hold them.
"""

from __future__ import annotations

import sys
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.sources.shared import kept, shared_folder, small

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a row group of the index; ids up to which they are sought in it one by one; bytes of a file that a task reads from.
GROUP, FEW, STRETCH = 1 << 20, 256, 64 << 20
FIELDS = ("docid", "url", "title", "body")


def running(batches):
    """Bytes from the start of the split to each line; a split's lines come one after another."""
    split, at = None, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        names = pa.compute.binary_join_element_wise(batch.column("file"), batch.column("block").cast(pa.string()), " ")
        codes = names.dictionary_encode()
        change = np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1
        local = np.empty(len(size), np.int64)
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(size)], strict=True):
            if a == b:
                continue
            name = names[a].as_py()
            if name != split:
                split, at = name, 0
            ends = at + np.cumsum(size[a:b])
            local[a:b] = ends - size[a:b]
            at = int(ends[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "local"])


def line_offsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, docid, offset, size (bytes, with the line end) of every line of tab-separated files; docid is the first field.

    docid is null in a line without a tab and in one that begins with a tab.
    Files whose lines don't add up to their size (compressed ones) raise.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    tab = F.instr("value", "\t")
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"),
        (F.octet_length("value") + 1).cast("long").alias("size"), F.when(tab > 1, F.substring("value", F.lit(1), tab - 1)).alias("docid"),
    )
    rows = kept(rows.mapInArrow(running, "file string, block long, whole long, size long, docid string, local long"), "lines")
    splits = rows.groupBy("file", "block").agg(F.sum("size").alias("n"), F.max("whole").alias("whole"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = F.col("whole") - F.sum("n").over(Window.partitionBy("file"))
    # the last line may lack its end (-1); a byte order mark at the start is no part of the first line (3)
    mark = F.when(short.isin(0, -1), 0).when(short.isin(3, 2), 3).otherwise(F.raise_error(F.concat(F.lit("lines and size differ: "), "file")).cast("int"))
    starts = splits.select("file", "block", (before + mark).alias("start"))
    return rows.join(small(starts), ["file", "block"]).select("file", "docid", (F.col("start") + F.col("local")).alias("offset"), "size")


def build_index(spark: SparkSession, path: str | list[str], folder: str) -> DataFrame:
    """Writes docid, file, offset, size to ``folder``, sorted by docid; of lines with one docid the last one (by file, then offset) stays."""
    rows = line_offsets(spark, path).filter("docid IS NOT NULL")
    last = rows.groupBy("docid").agg(F.max(F.struct("file", "offset", "size")).alias("x")).select("docid", "x.*")
    out = last.repartitionByRange("docid").sortWithinPartitions("docid").write.option("parquet.block.size", GROUP).option("parquet.bloom.filter.enabled#docid", "true")
    out.parquet(folder)
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("docid string, file string, offset long, size long").parquet(folder)


def found_in(index: DataFrame, needed: DataFrame) -> DataFrame:
    """The index rows of the needed docids; a few are sought by value, which reaches the scan, more meet in a join."""
    wanted = needed.filter("docid IS NOT NULL").select("docid").distinct()
    few = [r.docid for r in wanted.limit(FEW + 1).collect()]
    if not few:
        return index.limit(0)
    if len(few) <= FEW:
        terms = [F.col("docid") == d for d in sorted(few)]
        while len(terms) > 1:  # in pairs, so that the expression isn't deep
            terms = [reduce(lambda a, b: a | b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return index.filter(terms[0])
    return index.join(small(wanted), "docid", "left_semi")


def opened(file: str):
    """A file to read at any place; other than local ones through pyarrow's file systems."""
    parsed = urlparse(file)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path), "rb", buffering=0)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def read_at(batches):
    """The four fields of the line at each place; lines of another form, or of another id, give no row."""
    name, file = None, None
    for batch in batches:
        out, held = [], 0
        for docid, path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("docid", "file", "offset", "size")), strict=True):
            if path != name:
                if file:
                    file.close()
                name, file = path, opened(path)
            file.seek(offset)
            raw = b""
            while len(raw) < size and (more := file.read(size - len(raw))):
                raw += more
            parts = raw.decode("utf-8", "replace").rstrip("\n").split("\t")
            if len(parts) == len(FIELDS) and parts[0] == docid:
                out.append((*parts, len(raw)))
                held += len(raw)
            if held > 8 << 20:
                yield rows_of(out)
                out, held = [], 0
        yield rows_of(out)
    if file:
        file.close()


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], names=[*FIELDS, "n_bytes"])


def fetch(index: DataFrame, needed: DataFrame) -> DataFrame:
    """docid, url, title, body and n_bytes (bytes read) of each needed docid that the index has.

    Only the lines sought are read, in the order of their places, each stretch
    of a file by one task.  Null and unknown docids give no row, repeated
    ones one; other columns of ``needed`` are not read.
    """
    hits = found_in(index, needed).select("docid", "file", "offset", "size").withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    dealt = hits.repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read_at, "docid string, url string, title string, body string, n_bytes long")


def written_tsv(df: DataFrame) -> str:
    """The folder of tab-separated files with docid, url, title, body of every row; tabs and line feeds inside become spaces."""
    path = shared_folder(df.sparkSession, "tsv")
    df.select(F.concat_ws("\t", *(F.translate(F.coalesce(c, F.lit("")), "\t\n", "  ") for c in FIELDS)).alias("value")).write.text(path)
    return path
