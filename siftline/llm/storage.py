"""Shared folders for files that tasks write and later tasks read."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent on a single machine, as in tests, a folder in
    /tmp is set as checkpoint folder first; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"/tmp/siftline-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again.

    Cuts lineage: a lost executor costs no recomputation of what led here.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of what ``written`` gave; nothing may be read from it later."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


class Store:
    """Binary files under a folder that may be local, shared, or remote.

    ``file:`` paths and paths without a scheme are opened directly; others
    through pyarrow's file systems.  ``create`` writes to a name of its own
    and renames at the end, so that a task that is run twice, or dies half
    way, leaves no partial file under the final name.
    """

    def __init__(self, folder: str):
        parsed = urlparse(folder)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = parsed.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextmanager
    def create(self, name: str):
        path = self._path(name)
        partial = f"{path}.{uuid.uuid4().hex}.part"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            try:
                with open(partial, "wb", buffering=1 << 20) as out:
                    yield out
                os.replace(partial, path)
            finally:
                if os.path.exists(partial):
                    os.remove(partial)
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(partial) as out:
                yield out
            self.fs.move(partial, path)

    def open(self, name: str):
        if self.local:
            return open(self._path(name), "rb", buffering=1 << 20)
        return self.fs.open_input_file(self._path(name))

    def local_path(self, name: str) -> str | None:
        """The path for memory mapping, or None where the store is remote."""
        return self._path(name) if self.local else None
