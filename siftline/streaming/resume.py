"""Append-only input, each key taken once, across runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def resume(spark: SparkSession, source: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Take what is new in a file stream: the first row of each key, appended to Parquet in ``out``.

    The checkpoint remembers the files read and the keys seen, so a run that
    is started again goes on where the last ended.
    """
    stream = source.dropDuplicates(keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def first_of_keys(spark: SparkSession, folder: str, table: str, keys: list[str]) -> DataFrame:
    """The distinct keys of a table read as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder).select(*keys)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/siftline-streams"
    run = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return resume(spark, source, keys, f"{run}/out", f"{run}/checkpoint")
